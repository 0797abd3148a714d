"""Laws from positioned text lines, as whole jobs: articles with paragraphs, parents and citations; the structure of
titles, chapters and sections, with the articles that belong to each.

Lines are rows (doc, page, pos, y, x, x_end, text, is_bold, is_italic, is_non_black, font_size), as in textlines. Every
window is over one document's lines in order, so that a document is sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.functions.numbering import assemble
from lexatlas.operators.textlines import CENTRE_TOLERANCE, PAGE_WIDTH, assign_to_cuts, attach_parents, attach_references, by_document, consolidate, division_names
from lexatlas.sources.workspace import materialize

#: An article's heading with the parts of its number, any line that looks like one, end markers, where
#: headings may stand, where end markers and other headings must, and the height of a page.
ARTICLE = r"(?iu)^Art[íi]culo\s+(\d+)([oa])?\.?(?:[-–\s]*([A-Z]))?(?:[-–\s]+(Bis|Ter|Quáter|Quinquies|Sexies)(?:[-–\s]+(\d+))?)?\."
NEXT_ARTICLE = r"(?iu)^Art[íi]culo\s+\d+[oa]?(?:[-–_\s]*[A-Z])?(?:[-–_\s]+(?:bis|Ter|Quáter|Quinquies|Sexies)(?:[-–_\s]+\d+)?)?\.[- –\s]"
END_MARKER = r"(?i)TRANSITORI[OA]S?"
HEADING_LEFT, HEADING_RIGHT, END_LEFT, NEXT_LEFT, PAGE_HEIGHT, SPARE_PAGES = 80, 95, 150, 80, 800, 5
#: Headings of titles, chapters and sections.
TITLE = r"(?iu)^T[IÍ]TULO\s+(PRIMERO|SEGUNDO|TERCERO|CUARTO|QUINTO|SEXTO|S[EÉ]PTIMO|OCTAVO|NOVENO|D[EÉ]CIMO|[IVX]+)\s*$"
CHAPTER = r"(?iu)^CAP[IÍ]TULO\s+([IVX]+(?:\s+BIS)?|[UÚ]NICO)\s*$"
SECTION = r"(?iu)^SECCI[OÓ]N\s+([IVX]+)\s*$"
_IDENTIFIER = r"^(?:[IVXLC]+\.|[a-z]\)|\d+\.)\s*"


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def article_number(text: Column) -> Column:
    """The number of an article's heading, null where a line is none."""
    part = lambda k: F.nullif(F.regexp_extract(text, ARTICLE, k), F.lit(""))
    return assemble(part(1), part(2), part(3), part(4), part(5))


def scan_articles(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with what the scan of articles says of them: role (note, line, start, or null for lines of no article), text
    (of a start, the rest of the line), orden and first_page (of the article in force), and heading (orden, article, page,
    last_page), null but for the headings of articles.

    rules: (source, noise: array of strings, largest: font size of citations, ends: pattern of more end markers, null
    if none); a source that has no row has none of them. Tests go in this order, and a line that meets one is not asked
    the next: citations (italic, not black, small), noise, end markers (bold), centred bold headings, starts, lines that
    look like another article's heading; all others belong to the article in force. A heading that is left out by an
    earlier test starts nothing, and its article has no lines. A start is the first line of a
    number that is bold at the left margin, up to the first page with an end marker; in documents without any font flag
    on the first five pages the text alone decides. starts_bold says whether a line begins bold, is_bold stands for it
    where there is no such column. After a stop no article is in force. An article ends on the page of the next one, or
    the last one on the page of the end marker, or SPARE_PAGES on.
    """
    w, whole = by_document(), Window.partitionBy("doc")
    text, bold = F.trim("text"), _flag(F.col("is_bold"))
    begins_bold = _flag(F.col("starts_bold")) if "starts_bold" in lines.columns else bold
    own = lines.withColumn("text", text).where("text <> ''").join(rules, "source", "left")
    small = _flag(F.coalesce("font_size", F.lit(12.0)) <= F.col("largest"))
    ends = F.regexp_like("text", F.lit(END_MARKER))
    more = _flag(F.regexp_like("text", F.col("ends")))
    last_heading = bold & ((ends & (F.col("x") > END_LEFT)) | more)
    known = _flag(F.max(F.col("is_bold").isNotNull() & (F.col("page") <= 5)).over(whole))
    margin = begins_bold & F.col("x").between(HEADING_LEFT, HEADING_RIGHT)
    own = own.withColumns({
        "_note": _flag(F.col("is_italic")) & _flag(F.col("is_non_black")) & small,
        "_noise": _flag(F.exists("noise", lambda n: F.contains("text", n))),
        "_end": bold & (ends | more),
        "_centred": bold & (F.abs(F.col("x") + F.col("x_end") - PAGE_WIDTH) < CENTRE_TOLERANCE),
        "_next": F.regexp_like("text", F.lit(NEXT_ARTICLE)) & (F.col("x") >= NEXT_LEFT),
        "_end_page": F.min(F.when(last_heading, F.col("page"))).over(whole),
        "_number": F.when(margin | ~known, article_number(F.substring("text", 1, 50)))})
    own = own.withColumn("_number", F.when(F.col("_end_page").isNull() | (F.col("page") <= F.col("_end_page")), F.col("_number")))
    again = F.row_number().over(Window.partitionBy("doc", "_number").orderBy("pos"))
    own = own.withColumn("_heading", F.col("_number").isNotNull() & (again == 1))
    following = F.first(F.when(F.col("_heading"), F.col("page")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    own = own.withColumns({"orden": F.sum(F.col("_heading").cast("int")).over(w).cast("long"), "_last_page": F.coalesce(following, "_end_page", F.col("page") + SPARE_PAGES)})
    role = (F.when(F.col("_note"), "note").when(F.col("_noise"), None).when(F.col("_heading") & ~F.col("_centred"), "start").when(F.col("_end"), "stop")
            .when(F.col("_centred"), None).when(F.col("_next"), "stop").otherwise("line"))
    own = own.withColumn("role", role)
    state = F.last(F.when(F.col("role").isin("start", "stop"), F.struct("role", "orden", "page", "_last_page")), ignorenulls=True).over(w)
    rest = F.regexp_replace(F.regexp_replace("text", ARTICLE, ""), "^[- ]+", "")
    own = own.withColumns({"_state": state, "text": F.when(F.col("role") == "start", rest).otherwise(F.col("text"))})
    inside = _flag((F.col("_state.role") == "start") & (F.col("page") <= F.col("_state._last_page")))
    heading = F.when(F.col("_heading"), F.struct("orden", F.col("_number").alias("article"), "page", F.col("_last_page").alias("last_page")))
    return own.select("doc", "pos", "page", "y", "x", "x_end", "text", F.when(inside, F.col("role")).alias("role"), F.col("_state.orden").alias("orden"), F.col("_state.page").alias("first_page"), heading.alias("heading"))


def law_contents(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Articles of laws with their paragraphs: doc, orden, article, page, last_page, number, kind, identifier, content,
    parent_number, x_id, x_text, refs (array of strings); one row with null paragraph for an article that has none.

    Lines are scanned as scan_articles says. Those of an article become paragraphs by the five signs, at heights counted
    on over its pages; content is without the identifier, with single spaces. Citations go to the paragraph that ends
    last above them, those above all paragraphs to none. Lines without text, and lines before the first article, are
    left out; flags that are null count as not set; pos orders a document's lines and doesn't repeat; an empty table
    gives no rows. Lines are scanned once, and those of articles written, as are the paragraphs.
    """
    scanned = materialize(scan_articles(lines, rules).where("role in ('line', 'start', 'note') or heading is not null"), "scanned")
    key = F.struct("doc", "orden").alias("doc")
    height = F.col("y") + PAGE_HEIGHT * (F.col("page") - F.col("first_page"))
    inside = scanned.where("role in ('line', 'start') and text <> ''").select(key, "pos", height.alias("y"), "x", "x_end", "text")
    paragraphs = attach_parents(materialize(consolidate(inside), "law-paragraphs"))
    notes = scanned.where("role = 'note'").select(key, F.col("pos").alias("note"), height.alias("y"), "text")
    placed = attach_references(paragraphs, notes.select("doc", "note", "y")).join(notes.select("doc", "note", "text"), ["doc", "note"])
    refs = placed.groupBy("doc", "number").agg(F.sort_array(F.collect_list(F.struct("note", "text")))["text"].alias("refs"))
    body = F.when(F.col("identifier").isNotNull(), F.regexp_replace("text", _IDENTIFIER, "")).otherwise(F.col("text"))
    content = F.trim(F.regexp_replace(body, r"\s+", " "))
    x_id = F.bround("x").cast("int")
    shown = paragraphs.join(refs, ["doc", "number"], "left").select(
        "doc.doc", "doc.orden", "number", "kind", "identifier", content.alias("content"), "parent_number", x_id.alias("x_id"), F.when(F.col("identifier").isNotNull(), x_id + 22).otherwise(x_id).alias("x_text"), "refs")
    articles = scanned.where("heading is not null").select("doc", "heading.*")
    return articles.join(shown, ["doc", "orden"], "left")


def structure_nodes(lines: DataFrame) -> DataFrame:
    """Titles, chapters and sections of each document (doc, kind, title_no, chapter_pos, pos, number, name, page, y).

    A chapter belongs to the title in force, one before all titles to a title PRELIMINAR (page 1, no name, pos -1); a new
    title ends the chapter; a section belongs to the chapter in force, one without a chapter is left out. A title without
    chapters has one, UNICO, at its own place. title_no counts titles (0 for PRELIMINAR), chapter_pos is the place of a
    section's chapter, or the chapter's own. Lines beyond a document's end_page, if there is such a column, don't count.
    """
    text = F.trim("text")
    found = lambda pattern: F.upper(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))
    own = lines.where("end_page is null or page <= end_page") if "end_page" in lines.columns else lines
    own = own.select("doc", "page", "pos", "y", "text", found(TITLE).alias("_t"), found(CHAPTER).alias("_c"), found(SECTION).alias("_s"))
    kind = F.when(F.col("_t").isNotNull(), "titulo").when(F.col("_c").isNotNull(), "capitulo").when(F.col("_s").isNotNull(), "seccion")
    own = own.withColumn("kind", kind).withColumn("title_no", F.sum(F.when(F.col("kind") == "titulo", 1).otherwise(0)).over(by_document()))
    in_title = Window.partitionBy("doc", "title_no").orderBy("pos")
    own = own.withColumn("chapter_pos", F.last(F.when(F.col("kind") == "capitulo", F.col("pos")), ignorenulls=True).over(in_title))
    named = division_names(own, F.col("kind").isNotNull()).where("kind <> 'seccion' or chapter_pos is not null")
    number = F.coalesce("_t", "_c", "_s")
    nodes = named.select("doc", "kind", "title_no", F.when(F.col("kind") != "titulo", F.col("chapter_pos")).alias("chapter_pos"), "pos", number.alias("number"), "name", "page", "y")
    first = nodes.where("kind = 'capitulo' and title_no = 0").select("doc").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    types = dict(nodes.dtypes)
    preliminary = first.select("doc", F.lit("titulo").alias("kind"), F.lit(0).cast(types["title_no"]).alias("title_no"), none(types["chapter_pos"]).alias("chapter_pos"), F.lit(-1).cast(types["pos"]).alias("pos"), F.lit("PRELIMINAR").alias("number"), none("string").alias("name"), F.lit(1).cast(types["page"]).alias("page"), none(types["y"]).alias("y"))
    chapters = nodes.where("kind = 'capitulo'").select("doc", "title_no").distinct()
    lone = nodes.where("kind = 'titulo'").join(chapters, ["doc", "title_no"], "left_anti")
    only = lone.select("doc", F.lit("capitulo").alias("kind"), "title_no", F.col("pos").alias("chapter_pos"), "pos", F.lit("UNICO").alias("number"), none("string").alias("name"), "page", "y")
    return nodes.unionByName(preliminary).unionByName(only)


def law_map(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles (doc, article, page, y, ...) with their place: title, title_name, chapter, chapter_name, section,
    section_name and place, the order of titles, chapters and sections in the document.

    An article belongs to the last section, or chapter without sections, at or before its page and height; those before
    the first belong to the first; a null height stands at the page's end. In documents without any structure all
    belong to title and chapter UNICO. articles' columns doc, article (a number, distinct in a document), page and y are
    read, others kept.
    """
    nodes = structure_nodes(lines)
    of = lambda kind, name, *more: nodes.where(F.col("kind") == kind).select("doc", *more, F.col("number").alias(name), F.col("name").alias(f"{name}_name"))
    titles = of("titulo", "title", "title_no")
    chapters = of("capitulo", "chapter", "title_no", "chapter_pos", "page", "y").join(titles, ["doc", "title_no"])
    sections = of("seccion", "section", "chapter_pos", "pos", "page", "y")
    plain = chapters.join(sections.select("doc", "chapter_pos").distinct(), ["doc", "chapter_pos"], "left_anti").select("*", F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("section_name"), F.lit(-1).cast("long").alias("section_pos"))
    divided = chapters.drop("page", "y").join(sections.withColumn("section_pos", F.col("pos").cast("long")).drop("pos"), ["doc", "chapter_pos"])
    cuts = plain.unionByName(divided).withColumn("cut", F.when(F.col("section_pos") >= 0, F.col("section_pos")).otherwise(F.col("chapter_pos")).cast("long"))
    assigned = assign_to_cuts(articles.select("doc", "article", "page", "y"), cuts.select("doc", "cut", "page", "y"))
    place = F.struct(F.col("title_no").cast("long").alias("title"), F.col("chapter_pos").cast("long").alias("chapter"), F.col("section_pos").alias("section"))
    named = cuts.select("doc", "cut", "title", "title_name", "chapter", "chapter_name", "section", "section_name", place.alias("place"))
    whole = articles.join(assigned, ["doc", "article"]).join(named, ["doc", "cut"], "left").drop("cut")
    only = lambda c: F.coalesce(c, F.when(F.col("place").isNull(), "UNICO"))
    return whole.withColumns({"title": only("title"), "chapter": only("chapter")})


def map_json(placed: DataFrame) -> DataFrame:
    """doc and value: the nested map as JSON, titulos > capitulos > secciones, with names and articles in order of
    article; of repeated numbers in one parent the last counts. placed: rows of law_map with number, what an article is
    called. A document's map is one value, as it is one JSON object."""
    first = F.coalesce("place", F.struct(F.lit(0).cast("long").alias("title"), F.lit(0).cast("long").alias("chapter"), F.lit(-1).cast("long").alias("section")))
    own = placed.withColumn("place", first)
    names = lambda c: F.array_sort(F.collect_list(F.struct("article", c)))
    leaf = own.groupBy("doc", "place", "title", "title_name", "chapter", "chapter_name", "section", "section_name").agg(F.transform(names("number"), lambda x: x["number"]).alias("articulos"))
    entry = F.struct(F.col("place.section").alias("at"), F.col("section").alias("key"), F.struct(F.col("section_name").alias("nombre"), "articulos").alias("value"))
    chapters = leaf.groupBy("doc", "place.title", F.col("place.chapter").alias("chapter_at"), F.col("title").alias("title_number"), "title_name", "chapter", "chapter_name").agg(
        _in_order(F.when(F.col("section").isNotNull(), entry)).alias("s"), F.first(F.when(F.col("section").isNull(), F.col("articulos")), ignorenulls=True).alias("articulos"))
    chapter = F.struct(F.col("chapter_at").alias("at"), F.col("chapter").alias("key"), F.struct(F.col("chapter_name").alias("nombre"), "articulos", F.when(F.size("s") > 0, last_of_keys(F.col("s"))).alias("secciones")).alias("value"))
    titles = chapters.groupBy("doc", F.col("title").alias("title_at"), "title_number", "title_name").agg(_in_order(chapter).alias("c"))
    title = F.struct(F.col("title_at").alias("at"), F.col("title_number").alias("key"), F.struct(F.col("title_name").alias("nombre"), last_of_keys(F.col("c")).alias("capitulos")).alias("value"))
    docs = titles.groupBy("doc").agg(_in_order(title).alias("t"))
    return docs.select("doc", F.to_json(F.struct(last_of_keys(F.col("t")).alias("titulos"))).alias("value"))


def _in_order(entry: Column) -> Column:
    """A group's entries as an array, by where they are (at); nulls are left out."""
    return F.array_sort(F.collect_list(entry), lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0))


def last_of_keys(entries: Column) -> Column:
    """A map of entries (key, value), where of repeated keys the last value counts, at the first one's place."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), last(k).alias("value"))))
