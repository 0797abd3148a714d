"""From positioned text lines to structured paragraphs.

Lines are rows (doc, page, pos, y, x, x_end, text, is_bold, is_italic, is_non_black, font_size): pos orders a document's
lines. All operators are windows and joins within a document, except the one whose rule looks back at where the current
paragraph began (`consolidate_by_start`), which folds each document's lines in order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.functions.numbering import bucket, paragraph_class

#: Geometry of a paragraph start: left edge, gap above, right edge of a short line; how many of five signs
#: are needed. Width of a page, and how far the middle of a centred line may be off, twice.
EDGE, GAP, SHORT, SIGNS = 80, 15, 530, 4
PAGE_WIDTH, CENTRE_TOLERANCE = 612, 50


def by_document(*partition: str) -> Window:
    return Window.partitionBy(*(partition or ("doc",))).orderBy("pos")


def lines_from_characters(chars: DataFrame) -> DataFrame:
    """Lines from positioned characters (doc, page, top, x, width, char, bold, italic): rows whose tops round to one
    multiple of 5 (halves to even) form a line; it is bold if all characters but spaces are, italic if more than half."""
    solid = F.col("char") != " "
    own = chars.groupBy("doc", "page", bucket(F.col("top"), 5).alias("y")).agg(
        F.sort_array(F.collect_list(F.struct("x", "char"))).alias("c"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("x_end"),
        F.coalesce(F.bool_and(F.when(solid, F.col("bold"))), F.lit(False)).alias("is_bold"), (F.avg(F.when(solid, F.col("italic").cast("int"))) > 0.5).alias("is_italic"))
    return own.withColumn("text", F.array_join(F.transform("c", lambda x: x["char"]), "")).drop("c").where(F.trim("text") != "")


def lines_from_spans(spans: DataFrame, least: float = 0.8) -> DataFrame:
    """Lines from spans of text (doc, page, y, x, x_end, text, bold), as rule documents have them: a line is bold if more
    than `least` of its characters are, white space at the ends of spans not counted."""
    size = F.length(F.trim("text"))
    own = spans.groupBy("doc", "page", "y").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("s"), F.min("x").alias("x"), F.max("x_end").alias("x_end"), F.sum(size).alias("n"), F.coalesce(F.sum(F.when(F.col("bold"), size)), F.lit(0)).alias("b"))
    line = F.array_join(F.transform("s", lambda r: r["text"]), "")
    return own.select("doc", "page", "y", "x", "x_end", line.alias("text"), ((F.col("n") > 0) & (F.col("b") / F.col("n") > least)).alias("is_bold")).where(F.trim("text") != "")


def listing(registry: DataFrame, key: str = "source") -> DataFrame:
    """The sources that a registry has, in order, in capitals."""
    return registry.select(F.upper(key).alias(key)).distinct().orderBy(key)


def registered(names: DataFrame, registry: DataFrame, key: str = "source") -> DataFrame:
    """Rows with what a registry (key, ...) says of their source; letters' case of the key is ignored. A source that the
    registry lacks raises when its row is read."""
    known = registry.withColumn("_k", F.upper(key)).drop(key).withColumn("_known", F.lit(True))
    found = names.withColumn("_k", F.upper(key)).join(known, "_k", "left")
    sure = F.when(F.col("_known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not configured: "), F.coalesce(F.col(key), F.lit("null")))).cast("string"))
    return found.withColumn(key, sure).drop("_k", "_known")


def global_y(lines: DataFrame, first_page: Column, height: int = 800) -> DataFrame:
    """y over all pages, as if they were one long one."""
    return lines.withColumn("y_global", F.col("y") + height * (F.col("page") - first_page))


def starts_paragraph(lines: DataFrame) -> DataFrame:
    """is_new of each line: the first, one that begins with an identifier, or one with four of five signs: not left of
    the edge, a gap above, a short line before, a capital first, a full stop before."""
    w = by_document()
    y = F.col("y_global") if "y_global" in lines.columns else F.col("y")
    text = F.ltrim("text")
    signs = [F.col("x") >= EDGE, y - F.lag(y).over(w) > GAP, F.lag("x_end").over(w) < SHORT, F.regexp_like(text, F.lit(r"^\p{Lu}")), F.rtrim(F.lag("text").over(w)).endswith(".")]
    score = sum((F.coalesce(s.cast("int"), F.lit(0)) for s in signs[1:]), F.coalesce(signs[0].cast("int"), F.lit(0)))
    first = F.row_number().over(w) == 1
    return lines.withColumn("is_new", first | (paragraph_class(text)["kind"] != "texto") | (score >= SIGNS))


def consolidate(lines: DataFrame) -> DataFrame:
    """Paragraphs (doc, number, text, kind, identifier, x, y_end) from lines: gaps and islands over is_new."""
    numbered = starts_paragraph(lines).withColumn("number", F.sum(F.col("is_new").cast("int")).over(by_document()))
    own = numbered.groupBy("doc", "number").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("p"), F.min_by("x", "pos").alias("x"), F.max_by("y", "pos").alias("y_end"))
    text = F.array_join(F.transform("p", lambda r: F.trim(r["text"])), " ")
    return own.withColumn("text", text).withColumn("c", paragraph_class(F.col("text"))).select("doc", "number", "text", "c.kind", "c.identifier", "x", "y_end")


def attach_parents(paragraphs: DataFrame) -> DataFrame:
    """Parent of each paragraph: the last one before it that begins further left (edges rounded to 10, by more than 10).

    Only incisos, numerals and indented text have one. A document's edges have few multiples of 10: each paragraph asks
    at all of them that lie further left, and the last paragraph there is the running one of that edge.
    """
    key = bucket(F.col("x"), 10)
    can = F.col("kind").isin("inciso", "numeral") | ((F.col("kind") == "texto") & (F.col("x") >= 95))
    there = paragraphs.select("doc", key.alias("edge"), "number", F.lit(False).alias("asks"))
    asked = paragraphs.where(can).join(there.select("doc", "edge").distinct(), "doc").where(F.col("edge") < F.col("x") - 10).select("doc", "edge", "number", F.lit(True).alias("asks"))
    w = Window.partitionBy("doc", "edge").orderBy("number")
    last = there.unionByName(asked).withColumn("last", F.last(F.when(~F.col("asks"), F.col("number")), ignorenulls=True).over(w))
    found = last.where("asks").groupBy("doc", "number").agg(F.max("last").alias("parent_number"))
    return paragraphs.join(found, ["doc", "number"], "left")


def attach_references(paragraphs: DataFrame, notes: DataFrame) -> DataFrame:
    """Reference lines (doc, note, y) with the paragraph that ends last above them; those with none above are dropped,
    and of paragraphs that end at the same height the first counts."""
    near = notes.join(paragraphs.select("doc", "number", "y_end"), "doc").where("y_end < y")
    return near.groupBy("doc", "note").agg(F.max_by("number", F.struct("y_end", -F.col("number"))).alias("number"))


def assign_to_cuts(articles: DataFrame, cuts: DataFrame) -> DataFrame:
    """As-of join: each article (doc, article, page, y) with the last cut (doc, cut, page, y) at or before it; those
    before the first go to the first. One sort of both tables together; an article without y stands at the page's end."""
    a = articles.select("doc", "page", F.coalesce("y", F.lit(99999)).alias("y"), F.lit(1).alias("is_article"), "article", F.lit(None).cast("long").alias("cut"))
    c = cuts.select("doc", "page", "y", F.lit(0).alias("is_article"), F.lit(None).cast("long").alias("article"), "cut")
    w = Window.partitionBy("doc").orderBy("page", "y", "is_article", "cut", "article")
    whole = Window.partitionBy("doc").orderBy("page", "y", "is_article", "cut", "article").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = a.unionByName(c).withColumn("last", F.last("cut", ignorenulls=True).over(w)).withColumn("first", F.first("cut", ignorenulls=True).over(whole))
    return both.where("is_article = 1").select("doc", "article", F.coalesce("last", "first").alias("cut"))


def first_in_scan(rows: DataFrame, key: str) -> DataFrame:
    """Each key's first row in a document's order; later ones are repeats."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc", key).orderBy("pos"))).where("_r = 1").drop("_r")


def running_context(lines: DataFrame, is_title: Column, is_chapter: Column) -> DataFrame:
    """Each line with the title and chapter in force: a new title ends the chapter."""
    w = by_document()
    titled = lines.withColumn("title", F.last(F.when(is_title, F.col("text")), ignorenulls=True).over(w)).withColumn("_t", F.sum(is_title.cast("int")).over(w))
    inside = Window.partitionBy("doc", "_t").orderBy("pos")
    return titled.withColumn("chapter", F.last(F.when(is_chapter & ~is_title, F.col("text")), ignorenulls=True).over(inside)).drop("_t")


#: Lines of page heads and feet, and lines that are no division's name (letters' case is ignored).
NOISE_LINE = r"(?iu)^(LEY\s|CÁMARA|Secretaría|Últim|CÓDIGO|CONSTITUCIÓN|\d+\s+de\s+\d+|\[)"
NO_NAME = r"(?iu)^(ART|CAP|TITULO|TÍTULO|SECC|[IVX]+\.\s|[a-z]\)\s)"


def division_names(lines: DataFrame, is_heading: Column) -> DataFrame:
    """Headings of divisions with their name: the first line after them that isn't noise (heads and feet of pages, three
    characters or fewer), on their page or the next, unless it begins something else; null then."""
    text = F.trim("text")
    noise = (F.length(text) <= 3) | F.regexp_like(text, F.lit(NOISE_LINE))
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(~noise, F.struct(text.alias("text"), "page")), ignorenulls=True).over(w)
    found = lines.withColumns({"_h": is_heading, "_f": following}).where("_h")
    fits = (F.col("_f.page") <= F.col("page") + 1) & ~F.regexp_like("_f.text", F.lit(NO_NAME))
    return found.withColumn("name", F.when(fits, F.col("_f.text"))).drop("_h", "_f")


def segments(lines: DataFrame, is_start: Column, is_end: Column) -> DataFrame:
    """Lines of each article: from its heading to the next heading or the first end marker, markers left out."""
    w = by_document()
    numbered = lines.withColumn("segment", F.sum(is_start.cast("int")).over(w)).where("segment > 0")
    inside = Window.partitionBy("doc", "segment").orderBy("pos")
    return numbered.withColumn("_e", F.sum(is_end.cast("int")).over(inside)).where("_e = 0").drop("_e")


def until_marker(rows: DataFrame, is_marker: Column) -> DataFrame:
    """A document's rows before its first marker."""
    return rows.withColumn("_m", F.max(is_marker.cast("int")).over(by_document())).where("_m = 0").drop("_m")


def page_ranges(articles: DataFrame, spare: int = 5) -> DataFrame:
    """First and last page of each article: the last is where the next one begins, and for the last article the page of
    the transitory part (end_page) or `spare` pages on."""
    following = F.lead("page").over(Window.partitionBy("doc").orderBy("pos"))
    return articles.withColumn("last_page", F.coalesce(following, "end_page", F.col("page") + spare))


def without_noise(lines: DataFrame, noise: DataFrame) -> DataFrame:
    """Lines that hold none of their source's noise strings (source, noise: array of strings)."""
    own = lines.join(noise, "source", "left")
    return own.where(~F.exists(F.coalesce("noise", F.array().cast("array<string>")), lambda n: F.contains("text", n))).drop("noise")


def centred_headings(lines: DataFrame, page_width: int = PAGE_WIDTH, tolerance: int = CENTRE_TOLERANCE) -> DataFrame:
    """Bold lines whose middle lies near the page's middle."""
    return lines.where(F.col("is_bold") & (F.abs(2 * F.col("x") + (F.col("x_end") - F.col("x")) - page_width) < tolerance))


def reference_lines(lines: DataFrame, largest: float = 8.0) -> DataFrame:
    """Lines that are citations by their font: italic, not black, small."""
    return lines.where(F.col("is_italic") & F.col("is_non_black") & (F.col("font_size") <= largest))


def article_headings(lines: DataFrame, pattern: str, low: int = 80, high: int = 95, chars: int = 50) -> DataFrame:
    """Bold lines near the left edge whose first characters match; in documents without any font information on their
    first five pages, the text alone decides. Repeats of a number are dropped."""
    flagged = Window.partitionBy("doc")
    known = F.coalesce(F.max(F.when(F.col("page") <= 5, F.coalesce("is_bold", F.lit(False)).cast("int"))).over(flagged), F.lit(0)) == 1
    match = F.regexp_extract(F.substring("text", 1, chars), pattern, 1)
    found = lines.withColumns({"_known": known, "number": match}).where(F.col("number") != "")
    found = found.where(~F.col("_known") | (F.coalesce("is_bold", F.lit(False)) & F.col("x").between(low, high)))
    return first_in_scan(found.drop("_known"), "number")


def repealed(lines: DataFrame, is_heading: Column) -> DataFrame:
    """Headings with whether they or the two lines after say that the article is repealed."""
    w = by_document()
    said = F.lower(F.concat_ws(" ", "text", F.lead("text", 1).over(w), F.lead("text", 2).over(w)))
    marked = F.contains(said, F.lit("se deroga")) | F.contains(said, F.lit("(derogado)"))
    return lines.withColumns({"_h": is_heading, "repealed": marked}).where("_h").drop("_h")


def outline_or_content(outline: DataFrame, content: DataFrame) -> DataFrame:
    """Outline entries, and the content's articles for documents without an outline."""
    return outline.unionByName(content.join(outline.select("doc").distinct(), "doc", "left_anti"))


def with_virtual_chapters(titles: DataFrame, chapters: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Chapters (doc, title, chapter), and UNICO for titles without any; UNICO / UNICO for those of documents (doc), if
    given, that have neither."""
    lone = titles.join(chapters.select("doc", "title").distinct(), ["doc", "title"], "left_anti").select("doc", "title", F.lit("UNICO").alias("chapter"))
    out = chapters.select("doc", "title", "chapter").unionByName(lone)
    if documents is None:
        return out
    bare = documents.select("doc").distinct().join(out.select("doc").distinct(), "doc", "left_anti")
    return out.unionByName(bare.select("doc", F.lit("UNICO").alias("title"), F.lit("UNICO").alias("chapter")))


def rule_chapters(rules: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rules numbered a.b.c with the chapter numbered a.b; null if there is none."""
    return rules.withColumn("chapter", F.substring_index("number", ".", 2)).join(chapters.select(F.col("number").alias("chapter"), "chapter_id"), "chapter", "left")


#: Left edges of the levels of a rule document, and how far a line may be off.
BANDS, BAND = (156, 198, 241, 269), 10


def rule_paragraphs(lines: DataFrame, gap: float = 12.5) -> DataFrame:
    """Paragraphs of rule documents: a gap above or another band of the left edge begins one; its level is its band."""
    w = by_document()
    band = F.lit(None).cast("int")
    for k, edge in enumerate(BANDS):
        band = F.when(F.abs(F.col("x") - edge) <= BAND, k).otherwise(band)
    marked = lines.withColumn("band", band)
    new = F.coalesce((F.col("y") - F.lag("y").over(w) > gap) | ~F.col("band").eqNullSafe(F.lag("band").over(w)), F.lit(True)) | (F.lag("pos").over(w).isNull())
    numbered = marked.withColumn("number", F.sum(new.cast("int")).over(w))
    own = numbered.groupBy("doc", "number").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("p"), F.first("band").alias("band"))
    return own.select("doc", "number", "band", F.array_join(F.transform("p", lambda r: F.trim(r["text"])), " ").alias("text"))


def pending_titles(lines: DataFrame, number_pattern: str) -> DataFrame:
    """Rules with the bold heading that stands just before their number: the last bold line since the rule before."""
    w = by_document()
    number = F.nullif(F.regexp_extract("text", number_pattern, 1), F.lit(""))
    marked = lines.withColumn("number", number).withColumn("_s", F.coalesce(F.sum(F.col("number").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("doc", "_s").orderBy("pos")
    title = F.last(F.when(F.col("is_bold") & F.col("number").isNull(), F.col("text")), ignorenulls=True).over(inside)
    return marked.withColumn("title", title).where("number is not null").select("doc", "pos", "number", "title")


#: Left edge of rule numbers, headings, numbers, and lines that begin with the name of a law.
RULE_EDGE = 99
TITLE_LINE, CHAPTER_LINE, RULE_LINE = r"^Título\s+(\d+)\.\s+(.+)$", r"^Capítulo\s+(\d+\.\d+)\.\s+(.+)$", r"^(\d+\.\d+\.\d+(?:\.\d+)?)\.\s*"
LAW_LINE = r"^(CFF|LISR|LIVA|LIEPS|LIF|RCFF|RMF|RISR|RLISR|Ley|CPEUM|LCF|LSS|Convención)\s"


def _found(text: Column, pattern: str) -> Column:
    """What the pattern's first group matches; null if nothing."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def rule_headings(lines: DataFrame) -> DataFrame:
    """Titles and chapters of rule documents (doc, pos, page, kind, number, name, title): bold and centred lines. title is
    the number of the title in force, 0 for chapters before the first."""
    own = centred_headings(lines).withColumn("text", F.trim("text"))
    title, chapter = _found(F.col("text"), TITLE_LINE), _found(F.col("text"), CHAPTER_LINE)
    name = F.trim(F.coalesce(F.nullif(F.regexp_extract("text", TITLE_LINE, 2), F.lit("")), F.regexp_extract("text", CHAPTER_LINE, 2)))
    own = own.withColumns({"number": F.coalesce(title, chapter), "kind": F.when(title.isNotNull(), "titulo").otherwise("capitulo"), "name": name}).where("number is not null")
    in_force = F.last(F.when(F.col("kind") == "titulo", F.col("number")), ignorenulls=True).over(by_document())
    return own.withColumn("title", F.coalesce(in_force, F.lit("0"))).select("doc", "pos", "page", "kind", "number", "name", "title")


def rule_contents(lines: DataFrame, gap: float = 12.5) -> DataFrame:
    """Rules with their paragraphs (doc, pos, rule, name, paragraph, kind, identifier, text), a row per paragraph, and one
    with null paragraph for a rule that has none.

    A rule begins at its number by the left margin, if a bold line there gives that number somewhere in the document; of
    repeats the last counts. Its name is what bold lines at the text's edge say since the rule or heading before, or else
    the rest of its line. Fractions, incisos and numerals begin a paragraph at their edges, the number itself left out, and
    of fractions the rest of the line, too; so does a text line after a gap, if the paragraph has a text. Lines at the
    text's edge that name a law or are italic are citations, paragraphs of their own (kind referencias). Lines off all
    edges only go on with a text. Every step looks at one document's or rule's lines in order. Lines without text and lines
    before the first rule belong to none; a null font flag counts as not set; an empty table gives no rows.
    """
    at = lambda edge: F.abs(F.col("x") - edge) < BAND
    text, bold, italic = F.col("text"), F.coalesce("is_bold", F.lit(False)), F.coalesce("is_italic", F.lit(False))
    own = lines.select("doc", "pos", "x", "y", F.trim("text").alias("text"), bold.alias("bold"), italic.alias("italic")).where("text <> ''")
    number = F.when(at(RULE_EDGE), _found(text, RULE_LINE))
    own = own.withColumn("rule", number)
    own = own.withColumn("starts", F.col("rule").isNotNull() & F.max("bold").over(Window.partitionBy("doc", "rule")))
    fraction, inciso, numeral = _found(text, r"^([IVX]+)\."), _found(text, r"^([a-z])\)"), _found(text, r"^(\d+)\.")
    first, second, third, fourth = BANDS
    role = (F.when(F.col("starts"), "rule").when(F.regexp_like(text, F.lit(f"{TITLE_LINE}|{CHAPTER_LINE}")), "heading")
            .when(F.col("bold") & at(first) & fraction.isNull(), "name")
            .when(~F.col("bold") & at(first) & (F.regexp_like(text, F.lit(LAW_LINE)) | F.col("italic")), "referencias")
            .when(at(first) & fraction.isNotNull(), "fraccion").when(at(second) & inciso.isNotNull(), "inciso")
            .when(at(third) & numeral.isNotNull(), "numeral").when(at(first), "texto").when(at(second) | at(third) | at(fourth), "more").otherwise("off"))
    w = by_document()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("role", role).withColumns({
        "segment": F.sum(F.col("starts").cast("int")).over(w),
        "since": F.coalesce(F.sum(F.col("role").isin("rule", "heading").cast("int")).over(before), F.lit(0))})

    pending = own.where("role = 'name'").groupBy("doc", "since").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("p"))
    pending = pending.select("doc", "since", F.array_join(F.col("p.text"), " ").alias("pending"))
    rest = F.nullif(F.trim(F.regexp_replace("text", RULE_LINE, "")), F.lit(""))
    rules = own.where("starts").select("doc", "pos", "rule", "segment", "since", rest.alias("rest")).join(pending, ["doc", "since"], "left")
    rules = rules.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "rule").orderBy(F.desc("pos")))).where("_n = 1")
    rules = rules.select("doc", "pos", "rule", "segment", F.coalesce("pending", "rest").alias("name"))

    inside = Window.partitionBy("doc", "segment").orderBy("pos")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = F.col("role").isin("fraccion", "inciso", "numeral")
    said = F.when(F.col("role") == "fraccion", None).when(F.col("role") == "inciso", F.regexp_replace("text", r"^[a-z]\)\s*", "")).when(F.col("role") == "numeral", F.regexp_replace("text", r"^\d+\.\s*", "")).otherwise(text)
    body = own.where("segment > 0 and role not in ('rule', 'heading', 'name')").withColumns({
        "identifier": F.when(F.col("role") == "fraccion", fraction).when(F.col("role") == "inciso", inciso).when(F.col("role") == "numeral", numeral),
        "said": F.nullif(said, F.lit("")),
        "last_y": F.last(F.when(F.col("role") != "referencias", F.col("y")), ignorenulls=True).over(earlier),
        "opens": numbered | (F.col("role") == "referencias") | F.coalesce(F.lag("role").over(inside) == "referencias", F.lit(False))})
    body = body.withColumn("block", F.sum(F.col("opens").cast("int")).over(inside))
    in_block = Window.partitionBy("doc", "segment", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    has_text = F.coalesce(F.max((F.col("said").isNotNull() & (F.col("role") != "off"))).over(in_block), F.lit(False))
    body = body.withColumn("has", has_text).where("role <> 'off' or has or opens").withColumn("said", F.when((F.col("role") != "off") | F.col("has"), F.col("said")))
    soft = (F.col("role") == "texto") & F.col("has") & F.coalesce(F.col("y") - F.col("last_y") > gap, F.lit(False))
    body = body.withColumn("part", F.sum((F.col("opens") | soft).cast("int")).over(inside))
    opener = F.min_by(F.struct("role", "identifier"), "pos")
    parts = body.groupBy("doc", "segment", "part").agg(opener.alias("o"), F.sort_array(F.collect_list(F.struct("pos", "said"))).alias("p"))
    kind = F.when(F.col("o.role").isin("fraccion", "inciso", "numeral", "referencias"), F.col("o.role")).otherwise("texto")
    parts = parts.select("doc", "segment", "part", kind.alias("kind"), F.col("o.identifier").alias("identifier"), F.array_join(F.col("p.said"), " ").alias("text")).where("text <> ''")
    parts = parts.withColumn("paragraph", F.row_number().over(Window.partitionBy("doc", "segment").orderBy("part")))
    return rules.join(parts, ["doc", "segment"], "left").select("doc", "pos", "rule", "name", "paragraph", "kind", "identifier", "text")


def until_end_page(rows: DataFrame, lines: DataFrame, marker: str, extra: str | None = None, least_x: int = 150) -> DataFrame:
    """Rows (doc, page) up to the first page with an end marker, that page included, with end_page (null if there is no
    marker): a bold line that matches `marker` right of least_x, or matches `extra` anywhere."""
    ends = F.regexp_like("text", F.lit(marker)) & (F.col("x") > least_x)
    if extra:
        ends |= F.regexp_like("text", F.lit(extra))
    last = lines.where(F.col("is_bold") & ends).groupBy("doc").agg(F.min("page").alias("end_page"))
    return rows.join(last, "doc", "left").where("end_page is null or page <= end_page")


#: How far a left edge may be off, and the gap above that begins a paragraph.
START_TOLERANCE, START_GAP = 10, 12


def begins_paragraph(x: float, y: float, text: str, start: float, last_y: float, named: bool) -> bool:
    """Whether a line begins a paragraph, after one that began at `start`, has an identifier (named) and a last line at
    last_y. An identifier begins one. A line further right goes on. Else a gap above begins one, a line further left
    does, and so does one at the same edge after a paragraph with an identifier; but after a gap or further left, a line
    that wraps goes on: one that begins with a small letter, a sign, or a digit that numbers nothing."""
    import re

    if re.match(r"(?:[IVXLC]+\.|[a-z]\)|\d+\.)", text):
        return True
    if x > start + START_TOLERANCE:
        return False
    wraps = text[:1].islower() or text[:1] in tuple(",:;.()") or text[:1].isdigit()
    if y - last_y >= START_GAP and not wraps:
        return True
    return not wraps if x < start - START_TOLERANCE else named


def consolidate_by_start(lines: DataFrame) -> DataFrame:
    """Paragraphs (doc, number, x, text) by a fold over each document's lines in order: every decision depends on where the
    paragraph at hand began, so the lines of a document are read one after the other, in Python; the fold holds one
    paragraph at a time. Lines without text are skipped."""
    import re

    import pandas as pd

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc = start = last_y = None
        number, named, text, out = 0, False, [], []
        for f in frames:
            for d, x, y, t in zip(f["doc"], f["x"], f["y"], f["text"].str.strip()):
                if not t:
                    continue
                if not text or d != doc or begins_paragraph(x, y, t, start, last_y, named):
                    if text:
                        out.append((doc, number, start, " ".join(text)))
                    number = number + 1 if d == doc else 1
                    doc, start, text, named = d, x, [], bool(re.match(r"(?:[IVXLC]+\.|[a-z]\)|\d+\.)", t))
                text.append(t)
                last_y = y
            if out:
                yield pd.DataFrame(out, columns=["doc", "number", "x", "text"])
                out = []
        if text:
            yield pd.DataFrame([(doc, number, start, " ".join(text))], columns=["doc", "number", "x", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    rows = lines.where("text is not null").select("doc", "pos", "x", "y", "text").repartition("doc").sortWithinPartitions("doc", "pos")
    return rows.select("doc", "x", "y", "text").mapInPandas(fold, f"doc {kinds['doc']}, number long, x {kinds['x']}, text string")
