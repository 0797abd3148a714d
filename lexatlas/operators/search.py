"""Search over articles: tokens, query syntax, inverted index, ranking, snippets, fuzzy and vector search.

Ranks are this library's own: `simple` adds, for each query term, a weight times f / (f + 1) for f occurrences; `cover`
follows cover density (Clarke, Cormack and Tudhope, 2000) and is normalised to r / (r + 1). Terms of an article's number
weigh more than those of its text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.functions.numbering import base_number, place
from lexatlas.operators.views import clamp, in_list, joined_text
from lexatlas.sources.corpus import Corpus
from lexatlas.sources.workspace import map_arrow, materialize

WORD = r"[\p{L}\p{N}]+"
NUMBER_WEIGHT, TEXT_WEIGHT = 1.0, 0.4
#: Query vectors of one block: they are broadcast.
QUERY_VECTORS = 10_000


def fold_accents(text: Column) -> Column:
    """Lower case without the accents of Spanish."""
    return F.translate(F.lower(text), "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc")


def tokens(text: Column, accents: bool = True) -> Column:
    """Words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text) if accents else fold_accents(text), F.lit(f"({WORD})"), 1)


def index(docs: DataFrame, text: str = "text", number: str | None = None) -> DataFrame:
    """Inverted index (id, term, pos, weight); number terms come first and weigh more."""
    own = docs.select("id", F.posexplode(tokens(F.col(text))).alias("pos", "term"), F.lit(TEXT_WEIGHT).alias("weight"))
    if number is None:
        return own
    return own.unionByName(docs.select("id", F.posexplode(tokens(F.col(number))).alias("pos", "term"), F.lit(NUMBER_WEIGHT).alias("weight")).withColumn("pos", F.col("pos") - 1000))


@dataclass
class Search:
    """A parsed query: alternatives of required terms and phrases, and what is excluded."""

    any_of: list[list[tuple[str, ...]]] = field(default_factory=list)
    excluded: list[tuple[str, ...]] = field(default_factory=list)

    def terms(self) -> list[str]:
        return sorted({w for group in self.any_of for phrase in group for w in phrase})


def parse(text: str) -> Search:
    """Web syntax: words are all required, "..." is a phrase, - excludes, OR separates alternatives. Raises on an empty query."""
    out, group = Search(), []
    for sign, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word == "OR" and not sign:
            if group:
                out.any_of.append(group)
            group = []
            continue
        phrase = tuple(re.findall(r"[^\W_]+", (quoted or word).lower()))
        if phrase:
            (out.excluded if sign else group).append(phrase)
    if group:
        out.any_of.append(group)
    if not out.any_of:
        raise ValueError("the query is empty")
    return out


def _holds(words: Column, phrase: tuple[str, ...]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(words, phrase[0])
    # words hold no spaces, so a phrase is a substring of the words joined by them
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def matches(words: Column, search: Search) -> Column:
    """Whether an array of words matches a query."""
    out = F.lit(False)
    for group in search.any_of:
        every = F.lit(True)
        for phrase in group:
            every = every & _holds(words, phrase)
        out = out | every
    for phrase in search.excluded:
        out = out & ~_holds(words, phrase)
    return out


def matching_ids(terms: DataFrame, search: Search) -> DataFrame:
    """Ids that hold all words of one of the alternatives, from the inverted index alone: only the query's terms are read,
    and each id is counted once per term. Phrases and exclusions are then tested on the texts."""
    wanted = search.terms()
    hits = terms.where(F.col("term").isin(wanted)).groupBy("id").agg(F.collect_set("term").alias("have"))
    test = F.lit(False)
    for group in search.any_of:
        need = sorted({w for phrase in group for w in phrase})
        test = test | (F.size(F.array_except(F.array(*map(F.lit, need)), F.col("have"))) == 0)
    return hits.where(test).select("id")


def simple_rank(words: Column, search: Search, weight: float = TEXT_WEIGHT) -> Column:
    out = F.lit(0.0)
    for term in search.terms():
        f = F.size(words) - F.size(F.array_remove(words, term))
        out = out + weight * f / (f + 1.0)
    return F.round(out, 6)


def _once(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value), with value computed once however often function and its lambdas read it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def cover_rank(words: Column, search: Search) -> Column:
    """Cover density of the query's words: each shortest stretch that holds all of them adds the inverse of its length
    beyond them; then r / (r + 1).

    One pass over the places of the query's words keeps the last place of each; a stretch ends at each place, and starts
    at the earliest of the last places.
    """
    terms = search.terms()
    wanted = F.array(*map(F.lit, terms))
    n = len(terms)
    places = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(wanted, w).cast("int").alias("term"), i.alias("i"))), lambda x: x["term"] > 0)
    at = lambda last, x: F.transform(last, lambda old, k: F.when(k + 1 == x["term"], x["i"]).otherwise(old))
    begin = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("r"))

    def step(state: Column, x: Column) -> Column:
        def added(last: Column) -> Column:
            start = F.array_min(last)
            more = F.when(start > state["start"], F.lit(1.0) / F.greatest(x["i"] - start + 2 - n, F.lit(1))).otherwise(F.lit(0.0))
            return F.struct(last.alias("last"), F.greatest(start, state["start"]).alias("start"), (state["r"] + more).alias("r"))

        return _once(at(state["last"], x), added)

    r = F.aggregate(places, begin, step, lambda state: state["r"])
    return F.round(r / (r + 1), 6)


def snippet(text: Column, search: Search, most: int = 50, least: int = 20) -> Column:
    """The stretch of up to `most` words with the most matches (the first of equals), matches in <mark>; short texts whole."""
    return marked_stretch(text, F.array(*map(F.lit, search.terms())), most, least)


def marked_stretch(text: Column, wanted: Column, most: int = 50, least: int = 20) -> Column:
    """snippet for an array of words in lower case, which may differ from row to row."""
    is_hit = lambda w: F.coalesce(F.array_contains(wanted, F.lower(F.regexp_extract(w, f"({WORD})", 1))), F.lit(False))

    def best(words: Column, hit: Column) -> Column:
        last = F.greatest(F.size(words) - F.lit(least), F.lit(0))
        starts = F.filter(F.transform(hit, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: (x["h"] == 1) & (x["i"] <= last) | (x["i"] == 0))
        scored = F.transform(starts, lambda x: F.struct(F.aggregate(F.slice(hit, x["i"] + 1, most), F.lit(0), lambda a, b: a + b).alias("n"), (-x["i"]).alias("i")))
        marked = lambda w: F.when(is_hit(w), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w)
        return F.array_join(F.transform(F.slice(words, 1 - F.array_max(scored)["i"], most), marked), " ")

    whole = lambda words: _once(F.transform(words, lambda w: is_hit(w).cast("int")), lambda hit: best(words, hit))
    return _once(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda words: F.when(F.size(words) == 0, F.lit("")).otherwise(whole(words)))


def search(docs: DataFrame, text: str, limit: int = 20, page: int = 1, rank: str = "simple") -> DataFrame:
    """Articles (id, number, text) that match a query or whose number holds it, ranked, with snippets, a page at a time.

    Matches by number alone have rank 0; ties go by id. An empty query raises ValueError.
    """
    asked = parse(text)
    own = docs.withColumn("words", tokens(F.coalesce("text", F.lit(""))))
    found = matches(F.col("words"), asked)
    by_number = F.col("number").ilike(f"%{text}%")
    score = (cover_rank if rank == "cover" else simple_rank)(F.col("words"), asked)
    ranked = own.where(found | by_number).select("id", "number", "text", F.when(found, score).otherwise(0.0).alias("rank"))
    shown = ranked.orderBy(F.desc("rank"), "id").offset((page - 1) * limit).limit(limit)
    return shown.select("id", "number", "rank", snippet(F.coalesce("text", F.lit("")), asked).alias("snippet"))


def stemmed(search: Search) -> Search:
    """The query with each word's stem."""
    of = lambda phrases: [tuple(map(stem, p)) for p in phrases]
    return Search([of(group) for group in search.any_of], of(search.excluded))


def stem_hits(terms: DataFrame, search: Search) -> DataFrame:
    """Per id of an inverted index (id, term, pos, weight) the places of the query's stems: id, hits (stem, pos, weight; in
    order), words (the terms found). Stems are those of the vocabulary: only terms with a stem of the query are read on."""
    wanted = sorted({w for phrases in (*search.any_of, search.excluded) for p in phrases for w in p})
    vocabulary = stems(terms).where(F.col("stem").isin(wanted))
    found = terms.join(vocabulary, "term")
    return found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("stem", "pos", "weight"))).alias("hits"), F.collect_set("term").alias("words"))


def words_of_stems(texts: DataFrame, search: Search) -> DataFrame:
    """(term, stem) of those words of texts (text) whose stem is one of the query's. The stemmer changes no word's first
    two letters but for accents, and makes none longer: only words that agree in this are stemmed."""
    wanted = sorted({w for phrases in (*search.any_of, search.excluded) for p in phrases for w in p})
    plain = lambda t: F.substring(F.translate(t, "áéíóú", "aeiou"), 1, 2)
    near = lambda t: reduce(Column.__or__, [(plain(t) == w[:2]) & (F.length(t) >= len(w)) for w in wanted])
    terms = texts.select(F.explode(F.filter(tokens(F.col("text")), near)).alias("term"))
    return stems(terms).where(F.col("stem").isin(wanted))


def row_hits(text: Column, number: Column, known: Column) -> Column:
    """The places of words in a text and a number, of those that a map of terms to stems holds: array of (stem, pos, weight,
    term); pos and weight as in index."""

    def of(value: Column, back: int, weight: float) -> Column:
        every = F.transform(tokens(F.coalesce(value, F.lit(""))), lambda w, i: F.struct(known[w].alias("stem"), (i - back).alias("pos"), F.lit(weight).alias("weight"), w.alias("term")))
        return F.filter(every, lambda h: h["stem"].isNotNull())

    return F.concat(of(text, 0, TEXT_WEIGHT), of(number, 1000, NUMBER_WEIGHT))


def hits_match(hits: Column, search: Search) -> Column:
    """Whether hits match a query of stems: phrases are stems at consecutive places."""
    places = lambda w, back: F.transform(F.filter(hits, lambda h: h["stem"] == w), lambda h: h["pos"] - back)

    def holds(phrase: tuple[str, ...]) -> Column:
        return F.size(reduce(F.array_intersect, [places(w, k) for k, w in enumerate(phrase)])) > 0

    every = lambda phrases: reduce(Column.__and__, map(holds, phrases))
    none = [~holds(p) for p in search.excluded]
    return reduce(Column.__and__, none, reduce(Column.__or__, map(every, search.any_of)))


def weighted_rank(hits: Column, search: Search) -> Column:
    """For each of the query's stems and each weight, the weight times f / (f + 1) for f places; to six places."""

    def part(term: str, weight: float) -> Column:
        f = F.size(F.filter(hits, lambda h: (h["stem"] == term) & (h["weight"] == weight)))
        return weight * f / (f + 1.0)

    return F.round(reduce(Column.__add__, [part(t, w) for t in search.terms() for w in (NUMBER_WEIGHT, TEXT_WEIGHT)]), 6)


#: Rows of a page at most, and those of a page if none or too many are asked for.
MOST_ROWS, PAGE_ROWS = 100, 20
#: Letters that a search needs at least, as a client has it.
LEAST_LETTERS = 2


def worth_asking(text: str | None) -> bool:
    """Whether a client sends a search at all."""
    return text is not None and len(text.strip()) >= LEAST_LETTERS


def search_articles(corpus: Corpus, text: str, laws: str | None = None, kinds: str | None = None, only_transitory: bool = False, limit: int | None = PAGE_ROWS, page: int = 1) -> DataFrame:
    """Articles whose paragraphs match a query by stems, or whose number holds it: a page in order of rank, then id.

    laws and kinds are optional comma-separated lists of law codes and kinds of law; limit is PAGE_ROWS unless 1 to
    MOST_ROWS. Columns: id, law, law_name, law_kind, number, base, kind, place, content, is_transitory, reforms, rank,
    snippet. Paragraphs move once, to their articles, whose words are then looked through row by row; search_index reads
    a stored index instead. An empty query raises ValueError.
    """
    asked = stemmed(parse(text))
    wanted = corpus.laws.where(in_list("code", laws) & in_list("kind", kinds)).select(F.col("code").alias("law"), F.col("name").alias("law_name"), F.col("kind").alias("law_kind"))
    own = corpus.articles.join(F.broadcast(wanted), "law")
    if only_transitory:
        own = own.where("kind = 'transitorio'")
    content = joined_text(corpus.paragraphs.join(own.select(F.col("id").alias("article_id")), "article_id", "left_semi"), "\n\n").select(F.col("article_id").alias("id"), F.col("text").alias("content"))
    terms = words_of_stems(corpus.paragraphs.select(F.col("content").alias("text")).unionByName(own.select(F.col("number").alias("text"))), asked)
    known = terms.agg(F.map_from_entries(F.collect_list(F.struct("term", "stem"))).alias("known"))
    by_number = F.coalesce(F.col("number").ilike(f"%{text}%"), F.lit(False))
    score = lambda hits: F.when(hits_match(hits, asked), F.struct(weighted_rank(hits, asked).alias("rank"), F.transform(hits, lambda h: h["term"]).alias("words")))
    found = F.filter(F.transform(F.array(row_hits(F.col("content"), F.col("number"), F.col("known"))), score), lambda x: x.isNotNull() | by_number)
    ranked = own.join(content, "id", "left").crossJoin(F.broadcast(known)).select(*own.columns, "content", F.explode(found).alias("found"))  # a generator computes it once
    rows = clamp(limit, MOST_ROWS, PAGE_ROWS)
    shown = ranked.select("*", F.coalesce("found.rank", F.lit(0.0)).alias("rank")).orderBy(F.desc("rank"), "id").offset((page - 1) * rows).limit(rows)
    d = corpus.divisions.select(F.col("id").alias("division_id"), place(F.col("kind"), F.col("number")).alias("place"))
    out = shown.join(d, "division_id", "left")
    marked = marked_stretch(F.coalesce("content", F.lit("")), F.array_distinct(F.coalesce("found.words", F.array().cast("array<string>"))))
    return out.select("id", "law", "law_name", "law_kind", "number", base_number(F.col("number")).alias("base"), "kind", "place", "content", (F.col("kind") == "transitorio").alias("is_transitory"), "reforms", "rank", marked.alias("snippet"))


def trigrams(text: Column) -> Column:
    """Distinct three-character strings of a lower-cased text with two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


#: Letters of a fuzzy term at least, its rows at most, and those if none or too many are asked for.
FUZZY_LETTERS, MOST_FUZZY, FUZZY_ROWS = 3, 50, 10


def fuzzy(items: DataFrame, term: str, least: float = 0.3, limit: int | None = FUZZY_ROWS) -> DataFrame:
    """Items (id, text) whose trigrams resemble a term's: the share of common ones, `least` or more; the best first. limit
    is FUZZY_ROWS unless 1 to MOST_FUZZY; a term of fewer than FUZZY_LETTERS characters raises ValueError."""
    if len(term.strip()) < FUZZY_LETTERS:
        raise ValueError(f"a fuzzy term has {FUZZY_LETTERS} letters or more")
    a, b = trigrams(F.col("text")), trigrams(F.lit(term))
    similarity = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return items.select("id", F.round(similarity, 6).alias("similarity")).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(clamp(limit, MOST_FUZZY, FUZZY_ROWS))


#: Looks of fuzzy_terms, each for the terms that those before found too few rows for: trigrams of a term that a text may
#: lack, fewer where more texts than LOOKED_PAIRS are expected. Where they find too few, a term is compared with about
#: LOOKED_TEXTS texts of each of its LOOKED_GRAMS rarest trigrams.
LOOKED_MISSES, LOOKED_PAIRS, LOOKED_GRAMS, LOOKED_TEXTS = (1, 3), 1000, 3, 200
#: Texts of so many trigrams at most are found by two trigrams at a time, longer ones by one.
PAIRED = 64
#: Keys that are broadcast, at most.
SHARED_KEYS = 2_000_000
_MARKS = ["mark_0", "mark_1"]


def fuzzy_terms(items: DataFrame, terms: DataFrame, least: float = 0.3, limit: int | None = FUZZY_ROWS) -> DataFrame:
    """fuzzy for a table of terms (term) at a time: term, id, similarity, place; `limit` rows of each term.

    Items of one text resemble a term alike, so that texts are compared, each with its first `limit` ids. First looks
    at texts that hold nearly all of a term's trigrams tell how similar its last row is at least. From that follows, for
    each size of a text, how many of the term's trigrams it may lack; texts that may lack more than was looked at are
    looked for again, so that all pairs that can be among the best are compared. Terms of fewer than FUZZY_LETTERS
    characters and null terms have no rows, a repeated term has them once; null texts resemble nothing.
    """
    rows = clamp(limit, MOST_FUZZY, FUZZY_ROWS)
    found, asked, ids = _fuzzy_pairs(items, terms, least, rows)
    best = Window.partitionBy("ask").orderBy(F.desc("similarity"), "first")
    shown = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= rows).drop("place")
    shown = shown.join(ids.select("item", "ids"), "item").select("ask", F.explode("ids").alias("id"), "similarity")
    shown = shown.withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("similarity"), "id"))).where(F.col("place") <= rows)
    return shown.join(asked.select("ask", "term"), "ask").select("term", "id", "similarity", "place")


def _fuzzy_pairs(items: DataFrame, terms: DataFrame, least: float, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (ask, item, first, copies, similarity) among which are each term's best `rows`, the terms (ask, term) and the
    texts with their ids (item, ids)."""
    own = items.select("id", F.lower("text").alias("text")).where("text is not null").withColumn("r", F.row_number().over(Window.partitionBy("text").orderBy("id"))).where(F.col("r") <= rows)
    ids = own.groupBy("text").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("item"), "ids", F.sort_array(_trigram_codes(F.col("text"))).alias("grams"))
    ids = materialize(ids.withColumns(dict(zip(_MARKS, _marks(F.col("grams"))))), "trigrams")
    texts = ids.select("item", F.get("ids", F.lit(0)).alias("first"), F.size("ids").alias("copies"), "grams", F.size("grams").alias("m"), *_MARKS)
    often = materialize(texts.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often")), "often")
    asked = terms.select("term").where(F.length(F.trim("term")) >= FUZZY_LETTERS).distinct().select("term", _trigram_codes(F.col("term")).alias("wanted"))
    each = asked.select("term", "wanted", F.posexplode("wanted").alias("at", "gram")).join(often, "gram")
    each = each.groupBy("term").agg(F.first("wanted").alias("wanted"), F.sort_array(F.collect_list(F.struct("often", "gram", "at"))).alias("known"))
    each = each.withColumns(dict(zip(_MARKS, _marks(F.col("known.gram")))))
    asked = materialize(each.select(F.monotonically_increasing_id().alias("ask"), "term", "wanted", F.size("wanted").alias("n"), "known", *_MARKS), "asked")
    common = F.size(F.array_intersect("grams", "wanted"))
    similarity = F.round(common / (F.col("m") + F.col("n") - common), 6)
    best = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("similarity"), "first"))

    def compared(pairs: DataFrame) -> DataFrame:
        """The first `rows` of each term's pairs."""
        both = pairs.join(texts.drop(*_MARKS), "item").join(asked.select("ask", "wanted", "n"), "ask").select("ask", "item", "first", "copies", similarity.alias("similarity"))
        return both.withColumn("place", best).where((F.col("place") <= rows) & (F.col("similarity") >= least)).drop("place")

    n_texts, short = ids.count(), F.col("m") <= PAIRED
    found, looked, few = None, None, asked
    for misses in LOOKED_MISSES:
        keys = _keys(few.select("ask", F.lit(1).alias("low"), F.lit(PAIRED).alias("high"), F.lit(1).alias("need"), *_MARKS, F.least(F.lit(misses), F.size("known") - 1).alias("misses"), "known"), n_texts, LOOKED_PAIRS)
        pairs, tried = _holders(texts.where(short), None, keys), keys.select("ask", "misses").distinct()
        new = materialize(compared(pairs.join(found, ["ask", "item"], "left_anti") if found is not None else pairs), "looked")
        found, looked = (found.unionByName(new), looked.unionByName(tried)) if found is not None else (new, tried)
        enough = found.groupBy("ask").agg(F.sum("copies").alias("copies")).where(F.col("copies") >= rows)
        few = materialize(asked.join(enough, "ask", "left_anti"), "few")
    rare = materialize(few.select("ask", F.explode(F.slice("known", 1, LOOKED_GRAMS)).alias("gram")).select("ask", "gram.gram", "gram.often"), "rare")
    some = texts.select("item", F.explode("grams").alias("gram")).join(rare.select("gram", "often").distinct(), "gram").where(F.pmod(F.xxhash64("item"), F.ceil(F.col("often") / LOOKED_TEXTS)) == 0)
    more = some.select("item", "gram").join(rare.select("ask", "gram"), "gram").select("ask", "item").distinct()
    found = found.unionByName(materialize(compared(more.join(found, ["ask", "item"], "left_anti")), "looked"))

    so_far = F.sum("copies").over(Window.partitionBy("ask").orderBy(F.desc("similarity"), "item"))
    enough = found.withColumn("so_far", so_far).where(F.col("so_far") >= rows).groupBy("ask").agg(F.max("similarity").alias("reached"))
    floor = F.greatest(F.lit(least), F.coalesce("reached", F.lit(least))) - 2e-6  # similarities are rounded
    looked = looked.groupBy("ask").agg(F.max("misses").alias("looked"))
    floors = asked.select("ask", "n", F.size("known").alias("k")).join(enough, "ask", "left").join(looked, "ask", "left").select("ask", "n", "k", "looked", floor.alias("floor"))
    need = F.greatest(F.ceil(F.col("floor") * (F.col("n") + F.col("m")) / (1 + F.col("floor")) - 1e-9), F.lit(1)).cast("int")
    near = (F.col("m") >= F.col("floor") * F.col("n")) & (F.col("m") * F.col("floor") <= F.col("n"))
    sizes = floors.join(F.broadcast(texts.select("m").distinct()), near).select("ask", "m", "looked", need.alias("need"), (F.col("k") - need).alias("misses"))
    left = sizes.where((F.col("misses") >= 0) & (~short | (F.col("misses") > F.coalesce("looked", F.lit(-1)))))
    ranges = left.groupBy("ask", "need", "misses", short.alias("short")).agg(F.min("m").alias("low"), F.max("m").alias("high"))
    keys = _keys(ranges.join(asked.select("ask", "known", *_MARKS), "ask").select("ask", "low", "high", "need", *_MARKS, "misses", "known"), n_texts)
    rarest = F.row_number().over(Window.partitionBy("item").orderBy("often", "gram"))
    long = texts.where(~short).select("item", "m", *_MARKS, F.explode("grams").alias("gram")).join(often, "gram").withColumn("at", rarest)
    rest = _holders(texts.where(short), long, keys).join(found, ["ask", "item"], "left_anti")
    return found.unionByName(compared(rest)), asked, ids


def _trigram_codes(text: Column) -> Column:
    """trigrams, in order, each as one number."""
    padded = F.split(F.concat(F.lit("  "), F.lower(text), F.lit(" ")), "")
    code = lambda a, i: F.get(a, i).cast("long") * 2**42 + F.get(a, i + 1).cast("long") * 2**21 + F.get(a, i + 2)
    return F.array_distinct(_once(F.transform(padded, F.ascii), lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: code(a, i))))


def _marks(grams: Column) -> tuple[Column, Column]:
    """Two numbers with a bit for each trigram. For each bit that a term has and a text hasn't, the text lacks a trigram."""
    place = lambda g: F.pmod(F.xxhash64(g), F.lit(128)).cast("int")
    bit = lambda g: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(g), F.lit(64)))
    marks = lambda own: F.aggregate(F.filter(grams, own), F.lit(0).cast("long"), lambda x, g: x.bitwiseOR(bit(g)))
    return marks(lambda g: place(g) < 64), marks(lambda g: place(g) >= 64)


def _keys(rows: DataFrame, texts: int, most: int | None = None) -> DataFrame:
    """Adds keys (key, a) of which a text of low to high trigrams has one at least that lacks so many (misses) of a term's
    known trigrams at most. With most, fewer misses where more texts would be expected, and no keys where even that
    doesn't help."""
    import pyarrow as pa

    names = ["ask", "low", "high", "need", *_MARKS, "misses"]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for *place, misses, known in zip(*(batch.column(c).to_pylist() for c in (*names, "known"))):
                known = [(x["often"], x["gram"], x["at"]) for x in known]
                cost, pairs = _two_of_each(known, misses, texts, place[1] <= PAIRED)
                while most is not None and cost > most and misses >= 0:
                    misses -= 1
                    cost, pairs = _two_of_each(known, misses, texts, True) if misses >= 0 else (0, [])
                for a, b in pairs:
                    for column, value in zip(out, (*place, misses, min(a, b), max(a, b))):
                        column.append(value)
            types = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[*names, "a", "b"])

    dealt = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    keys = map_arrow(dealt, run, "ask long, low int, high int, need int, mark_0 long, mark_1 long, misses int, a long, b long")
    return materialize(keys.select(*names, F.xxhash64("a", "b").alias("key"), "a"), "keys")


def _two_of_each(known: list[tuple], misses: int, texts: int, paired: bool) -> tuple[float, list[tuple]]:
    """Pairs of trigrams of which a text holds one at least, if it lacks so many of the known ones (often, gram, at; the
    rarest first) at most, and how many texts are expected to; a pair may be one trigram twice.

    Of the misses + 1 rarest it holds one. Of the c rarest, dealt into c - misses - 1 parts, it holds two of a part: they
    are dealt in turn as they stand in the term, so that those of a part share few letters. Of these ways the one with
    the fewest texts is taken.
    """
    ways = [(float(sum(x[0] for x in known[: misses + 1])), [(x[1], x[1]) for x in known[: misses + 1]])]
    for c in range(misses + 2, min(len(known), misses + 7) + 1 if paired else 0):
        parts, placed = c - misses - 1, sorted(known[:c], key=lambda x: x[2])
        both = [(u, v) for i, u in enumerate(placed) for v in placed[i + parts :: parts]]
        ways.append((sum(_expected(u, v, texts) for u, v in both), [(u[1], v[1]) for u, v in both]))
    return min(ways)


def _expected(u: tuple, v: tuple, texts: int) -> float:
    """Texts that hold both trigrams, about: letters that they have in common are counted once."""
    mean = (u[0] * v[0]) ** 0.5
    return min(u[0], v[0], mean * (mean / texts) ** (min(abs(u[2] - v[2]), 3) / 3))


def _holders(texts: DataFrame, long: DataFrame | None, asked: DataFrame) -> DataFrame:
    """Pairs (ask, item) of terms and texts that have one of the term's keys and may lack no more of its trigrams than
    allowed: texts (item, m, marks, grams) by all pairs of their trigrams, long ones (item, m, marks, gram, at) by those
    trigrams that are among their m - need + 1 rarest."""
    keys = materialize(asked.select("key", "a").distinct(), "shared-keys")
    shared = F.broadcast if keys.count() <= SHARED_KEYS else lambda df: df
    marks = [F.col(c).alias(f"of_{c}") for c in _MARKS]
    lead = texts.select("item", "m", *_MARKS, "grams", F.posexplode("grams").alias("i", "a")).join(shared(keys.select("a").distinct()), "a")
    both = lead.select("item", "m", *marks, F.lit(1).alias("at"), "a", F.explode(F.slice("grams", F.col("i") + 1, F.col("m") - F.col("i"))).alias("b"))
    held = both.select("item", "m", "of_mark_0", "of_mark_1", "at", F.xxhash64("a", "b").alias("key"))
    if long is not None:
        held = held.unionByName(long.select("item", "m", *marks, "at", F.xxhash64("gram", "gram").alias("key")))
    held = held.join(shared(keys.select("key").distinct()), "key", "left_semi")
    lacks = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseAND(F.bitwise_not(F.col(f"of_{c}")))) for c in _MARKS])
    fits = F.col("m").between(F.col("low"), F.col("high")) & (F.col("at") <= F.col("m") - F.col("need") + 1) & (lacks <= F.col("misses"))
    return held.join(asked.drop("a"), "key").where(fits).select("ask", "item").distinct()


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
    """The k most similar vectors (id, embedding) of each query (query_id, query) by cosine, to six places; ties by id.

    Every query is compared with every vector. Queries are broadcast in blocks of about QUERY_VECTORS, as many as there
    are; each task keeps the best k of each query. Where there is no cosine (null or zero vectors, or of another length),
    similarity is null and comes last.
    """
    spark = vectors.sparkSession
    own = vectors.where("id is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.where("query_id is not null").select("query_id", F.col("query").cast("array<double>").alias("query"))
    n = max(1, -(-asked.count() // QUERY_VECTORS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {own.schema['id'].dataType.simpleString()}, similarity double"
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    blocks = []
    for i in range(n):
        shared = spark.sparkContext.broadcast([tuple(r) for r in asked.where(block == i).collect()])
        scored = map_arrow(own, lambda it, b=shared: _nearest(it, b, k), kinds).withColumn("similarity", F.nullif("similarity", F.lit(_NO_COSINE)))
        if least is not None:
            scored = scored.where(F.col("similarity") >= least)
        blocks.append(scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k))
    return reduce(DataFrame.unionByName, blocks)


#: Below any cosine.
_NO_COSINE = -9.0
#: Queries that a batch of vectors is multiplied with at once.
_QUERY_ROWS = 256


def _unit(rows: list, length: int):
    """Vectors of a length as rows of length 1, and which of them have one."""
    import numpy as np

    good = [r is not None and len(r) == length and None not in r for r in rows]
    out = np.array([r if ok else [0.0] * length for r, ok in zip(rows, good)], float).reshape(len(rows), length)
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None], np.array(good, bool) & (norm > 0)


def _nearest(batches, shared, k: int):
    """(query_id, id, similarity): the best k of a task's vectors for each query."""
    import numpy as np
    import pyarrow as pa

    queries = shared.value
    if not queries:
        return
    names = np.array([q for q, _ in queries])
    by_length: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(queries):
        by_length.setdefault(len(v or ()), []).append(i)
    kinds, kept = (pa.null(), pa.null()), None

    def best(rows):
        """The best k of each query, of rows (query, id, similarity)."""
        q, ids, sims = rows
        order = np.lexsort((ids, -sims, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return tuple(x[place < k] for x in (q, ids[order], sims[order]))

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.array(batch.column("id").to_pylist())
        order = np.argsort(ids, kind="stable")
        ids, kinds = ids[order], batch.schema.field("id").type
        vectors = batch.column("embedding").to_pylist()
        vectors = [vectors[i] for i in order.tolist()]
        found = [] if kept is None else [kept]
        for length, members in by_length.items():
            rows, good = _unit(vectors, length)
            for at in range(0, len(members), _QUERY_ROWS):
                part = members[at : at + _QUERY_ROWS]
                asked, fine = _unit([queries[i][1] for i in part], length)
                sims = np.round(asked @ rows.T, 6)
                sims[~fine] = _NO_COSINE
                sims[:, ~good] = _NO_COSINE
                for i, row in zip(part, sims):
                    other = np.flatnonzero(ids != names[i])
                    own = row[other]
                    if len(own) > k:  # ids ascend, so of equals the first ones
                        least = np.partition(own, len(own) - k)[len(own) - k]
                        above = np.flatnonzero(own > least)
                        pick = np.concatenate([above, np.flatnonzero(own == least)[: k - len(above)]])
                        other, own = other[pick], own[pick]
                    found.append((np.full(len(own), i), ids[other], own))
        kept = best(tuple(np.concatenate(x) for x in zip(*found)))
    if kept is not None:
        q, ids, sims = kept
        for at in range(0, len(q), 10_000):
            cut = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array([queries[i][0] for i in q[cut].tolist()]), pa.array(ids[cut].tolist(), kinds), pa.array(sims[cut])], names=["query_id", "id", "similarity"])


def stems(words: DataFrame) -> DataFrame:
    """(term, stem) of distinct terms; the stemmer runs on the vocabulary, not on texts."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("term"), pa.array([stem(t) for t in b.column("term").to_pylist()], pa.string())], names=["term", "stem"])

    return map_arrow(words.select("term").where("term is not null").distinct(), run, "term string, stem string")


# Suffixes of the published Snowball algorithm for Spanish, longest first within each step.
_STANDARD = ("amientos", "imientos", "amiento", "imiento", "aciones", "uciones", "adoras", "adores", "ancias", "logías", "encias", "amente", "idades", "anzas", "ismos", "ables", "ibles", "istas", "adora", "acion", "ación", "antes", "ancia", "logía", "ución", "ucion", "encia", "mente", "anza", "icos", "icas", "ismo", "able", "ible", "ista", "osos", "osas", "ador", "ante", "idad", "ivas", "ivos", "ico", "ica", "oso", "osa", "iva", "ivo")
_PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
_GERUNDS = (("iéndo", "iendo"), ("ándo", "ando"), ("ár", "ar"), ("ér", "er"), ("ír", "ir"), ("ando", "ando"), ("iendo", "iendo"), ("ar", "ar"), ("er", "er"), ("ir", "ir"))
_Y_VERBS = ("yeron", "yendo", "yamos", "yais", "yan", "yen", "yas", "yes", "ya", "ye", "yo", "yó")
_VERBS = ("aríamos", "eríamos", "iríamos", "iéramos", "iésemos", "aríais", "aremos", "eríais", "eremos", "iríais", "iremos", "ierais", "ieseis", "asteis", "isteis", "ábamos", "áramos", "ásemos", "arían", "arías", "aréis", "erían", "erías", "eréis", "irían", "irías", "iréis", "ieran", "iesen", "ieron", "iendo", "ieras", "ieses", "abais", "arais", "aseis", "íamos", "arán", "arás", "aría", "erán", "erás", "ería", "irán", "irás", "iría", "iera", "iese", "aste", "iste", "aban", "aran", "asen", "aron", "ando", "abas", "adas", "idas", "aras", "ases", "íais", "ados", "idos", "amos", "imos", "ará", "aré", "erá", "eré", "irá", "iré", "aba", "ada", "ida", "ara", "ase", "ían", "ado", "ido", "ías", "áis", "ía", "ad", "ed", "id", "an", "ió", "ar", "er", "ir", "as", "ís", "en", "es", "éis", "emos")
_E_VERBS = ("emos", "éis", "en", "es")
_RESIDUALS = ("os", "a", "o", "á", "í", "ó")
_VOWELS = "aeiouáéíóúü"


def _regions(w: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 of a word begin."""
    after = lambda s: next((i + 1 for i in range(s + 1, len(w)) if w[i] not in _VOWELS and w[i - 1] in _VOWELS), len(w))
    r1 = after(0)
    r2 = after(r1) if r1 < len(w) else len(w)
    rv = len(w)
    if len(w) > 2:
        if w[1] not in _VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in _VOWELS), len(w))
        elif w[0] in _VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in _VOWELS), len(w))
        else:
            rv = 3
    return rv, r1, r2


def stem(word: str) -> str:
    """Spanish stem of a lower-case word, after the published Snowball description."""
    w = word
    rv, r1, r2 = _regions(w)
    ends = lambda s, at: w.endswith(s) and len(w) - len(s) >= at
    for p in _PRONOUNS:  # attached pronouns
        if ends(p, rv):
            base = w[: -len(p)]
            for g, plain in _GERUNDS:
                if base.endswith(g) and len(base) - len(g) >= rv:
                    w = base[: -len(g)] + plain
                    break
            else:
                if base.endswith("uyendo") and len(base) - 5 >= rv:
                    w = base
            break
    done = False
    found = next((s for s in _STANDARD if w.endswith(s)), None)
    if found:
        at = r1 if found == "amente" else r2
        if len(w) - len(found) >= at:
            w, done = w[: -len(found)], True
            if found in ("logía", "logías"):
                w += "log"
            elif found in ("ución", "ucion", "uciones"):
                w += "u"
            elif found in ("encia", "encias"):
                w += "ente"
            elif found == "amente":
                for s in ("iv", "os", "ic", "ad"):
                    if ends(s, r2):
                        w = w[: -len(s)]
                        if s == "iv" and ends("at", r2):
                            w = w[:-2]
                        break
            elif found == "mente":
                w = next((w[: -len(s)] for s in ("ante", "able", "ible") if ends(s, r2)), w)
            elif found in ("idad", "idades"):
                w = next((w[: -len(s)] for s in ("abil", "ic", "iv") if ends(s, r2)), w)
            elif found in ("iva", "ivo", "ivas", "ivos"):
                w = w[:-2] if ends("at", r2) else w
            elif found in ("ador", "adora", "adores", "adoras", "acion", "ación", "aciones", "ante", "antes", "ancia", "ancias"):
                w = w[:-2] if ends("ic", r2) else w
    if not done:
        s = next((s for s in _Y_VERBS if ends(s, rv)), None)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = max((s for s in _VERBS if ends(s, rv)), key=len, default=None)
            if s:
                w = w[: -len(s)]
                if s in _E_VERBS and w.endswith("gu"):
                    w = w[:-1]
    s = next((s for s in _RESIDUALS if ends(s, rv)), None)
    if s:
        w = w[: -len(s)]
    else:
        for s in ("e", "é"):
            if ends(s, rv):
                w = w[:-1]
                if w.endswith("gu") and len(w) - 1 >= rv:
                    w = w[:-1]
                break
    return w.translate(str.maketrans("áéíóú", "aeiou"))
