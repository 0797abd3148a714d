"""A stored search index: postings of stems in segments, and the articles themselves, each read by few of its parts.

A segment is written once and never changed. Its postings are rows (stem, id, ..., hits, words), partitioned by a hash of
the stem, each file sorted by stem: a query reads the partitions of its own stems, and of their files the row groups that
hold them. Its articles are partitioned by a hash of their id, so that the texts of a page are read alone. All words of an
article lie in its row, so that its postings are made there: only whole articles move to other tasks when a segment is
added. Adding articles writes one more segment; merging writes one segment out of all. A list of the segments in force
is written last, under a new generation each time, so that readers never see half a segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.functions.numbering import base_number, place
from lexatlas.operators.search import MOST_ROWS, NUMBER_WEIGHT, PAGE_ROWS, TEXT_WEIGHT, Search, hits_match, parse, stem, stemmed, tokens, weighted_rank, worth_asking
from lexatlas.operators.views import clamp, joined_text
from lexatlas.sources.corpus import Corpus
from lexatlas.sources.workspace import map_arrow, materialize

#: Partitions of a segment's postings, and of its articles; each task that writes has a file in each.
BUCKETS = 16
#: Words of the articles whose postings are made at once, unless one article has more.
BLOCK_WORDS = 500_000
#: Articles of a task that makes postings, so that it sorts them in memory, and the fewest for which there is one more.
TASK_ARTICLES, LEAST_ARTICLES = 100_000, 5_000
#: What postings hold of an article, for filters.
_FACETS = ("law", "law_kind", "kind")


def _bucket(value: Column) -> Column:
    return (F.crc32(value.cast("string").cast("binary")) % BUCKETS).cast("int")


def _buckets(values: list) -> list[int]:
    return sorted({zlib.crc32(str(v).encode()) % BUCKETS for v in values})


def segments(spark: SparkSession, path: str) -> list[str]:
    """Names of the segments in force; none where no index has been written."""
    try:
        listed = spark.read.schema("generation int, segment string").parquet(f"{path}/segments")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    rows = listed.groupBy("generation").agg(F.sort_array(F.collect_list("segment")).alias("s")).orderBy(F.desc("generation")).limit(1).collect()
    return list(rows[0]["s"]) if rows else []


def _publish(spark: SparkSession, path: str, names: list[str]) -> None:
    try:
        last = spark.read.schema("generation int, segment string").parquet(f"{path}/segments").agg(F.max("generation")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = 0
    spark.createDataFrame([(last + 1, n) for n in names], "generation int, segment string").coalesce(1).write.mode("append").parquet(f"{path}/segments")


def _write(rows: DataFrame, folder: str, *order: str) -> None:
    """Rows by bucket and order: ranges, so that a stem that many articles hold is written by many tasks."""
    keys = ["bucket", *order]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("bucket").parquet(folder)


def add_segment(path: str, articles: DataFrame, name: str) -> None:
    """Writes articles (id, law, law_kind, kind, number, text, and other columns) as one more segment; none of those there
    is read or changed. ids are new to the index, and name is new to it, too. Null texts and numbers have no words; words
    of a number weigh more. The articles are computed once and written; postings are made of what was written."""
    spark = articles.sparkSession
    known = segments(spark, path)
    if name in known:
        raise ValueError(f"there is a segment {name}")
    own = articles.withColumn("bucket", _bucket(F.col("id")))
    own.sortWithinPartitions("bucket", "id").write.partitionBy("bucket").parquet(f"{path}/articles/{name}")
    written = spark.read.schema(own.schema).parquet(f"{path}/articles/{name}")
    n = written.count()
    tasks = max(-(-n // TASK_ARTICLES), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ARTICLES)), 1)
    words = written.repartition(tasks, "id").sortWithinPartitions("id").select("id", *_FACETS, *(tokens(F.coalesce(c, F.lit(""))).alias(c) for c in ("number", "text")))
    kinds = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in ("id", *_FACETS))
    postings = map_arrow(words, _postings, f"stem string, {kinds}, hits array<struct<pos:int,weight:double>>, words array<string>, bucket int")
    postings.sortWithinPartitions("bucket", "stem", "id").write.partitionBy("bucket").parquet(f"{path}/postings/{name}")
    _publish(spark, path, [*known, name])


_ACCENTS = str.maketrans("áéíóú", "aeiou")


@lru_cache(1 << 16)
def _known_stem(word: str) -> str:
    return stem(word)


def _stem(word: str) -> str:
    """stem, at once for words that end in a digit: no suffix does, and only accents change."""
    return word.translate(_ACCENTS) if word[-1].isdigit() else _known_stem(word)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of articles (id, facets, number and text as arrays of words), block by block."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = sum(pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("number", "text"))
        block = np.cumsum(sizes) // BLOCK_WORDS if len(sizes) else sizes
        starts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
        for a, z in zip(starts, [*starts[1:], batch.num_rows]):
            yield _block_postings(batch.slice(a, z - a))


def _block_postings(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each stem of each article: its places in order with their weights, and the words that have it there. Rows
    come by bucket and stem, so that what is left to sort is runs."""
    import numpy as np
    import pyarrow.compute as pc

    columns = [(batch.column(c), back, weight) for c, back, weight in (("number", 1000, NUMBER_WEIGHT), ("text", 0, TEXT_WEIGHT))]
    sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False) for c, _, _ in columns]
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    pos = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) - back for n, (_, back, _) in zip(sizes, columns)])
    weight = np.concatenate([np.full(n.sum(), w) for n, (_, _, w) in zip(sizes, columns)])
    found = pa.concat_arrays([c.flatten() for c, _, _ in columns]).dictionary_encode()
    word, terms = found.indices.to_numpy(), found.dictionary
    known = pa.array([_stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
    buckets = np.array([zlib.crc32(s) % BUCKETS for s in known.dictionary.cast(pa.binary()).to_pylist()], np.int32)
    ranked = pc.sort_indices(known.dictionary).to_numpy().astype(np.int64)
    ranked = ranked[np.argsort(buckets[ranked], kind="stable")]
    stems, buckets, place = known.dictionary.take(pa.array(ranked)), buckets[ranked], np.argsort(ranked)
    of_word = place[known.indices.to_numpy()]
    group = of_word[word] * batch.num_rows + row
    long_number = len(sizes[0]) and sizes[0].max() > 1000  # else a number's words come before a text's
    order = np.lexsort((pos, group)) if long_number else np.argsort(group, kind="stable")
    group, row, word = group[order], row[order], word[order]
    new = np.diff(group, prepend=-1) != 0
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    ends = lambda starts, n: pa.array(np.append(starts, n), pa.int32())
    hits = pa.ListArray.from_arrays(ends(first, len(group)), pa.StructArray.from_arrays([pa.array(pos[order], pa.int32()), pa.array(weight[order])], ["pos", "weight"]))
    distinct = number * max(len(terms), 1) + word
    for _ in range(2):  # most repeats follow each other, and what is left is almost in order
        distinct = np.sort(distinct[np.diff(distinct, prepend=-1) != 0], kind="stable")
    of_group = distinct // max(len(terms), 1)
    words = pa.ListArray.from_arrays(ends(np.searchsorted(of_group, np.arange(len(first))), len(distinct)), terms.take(pa.array(distinct % max(len(terms), 1))))
    at = pa.array(row[first])
    stem_at = of_word[word[first]]
    out = [stems.take(pa.array(stem_at)), *(batch.column(c).take(at) for c in ("id", *_FACETS)), hits, words, pa.array(buckets[stem_at])]
    return pa.RecordBatch.from_arrays(out, names=["stem", "id", *_FACETS, "hits", "words", "bucket"])


def merge_segments(spark: SparkSession, path: str, name: str) -> None:
    """Writes all segments in force as one, which takes their place; their files stay for readers that began before."""
    known = segments(spark, path)
    if name in known:
        raise ValueError(f"there is a segment {name}")
    _write(_read(spark, path, "postings"), f"{path}/postings/{name}", "stem", "id")
    _write(_read(spark, path, "articles"), f"{path}/articles/{name}", "id")
    _publish(spark, path, [name])


def _read(spark: SparkSession, path: str, what: str, names: list[str] | None = None) -> DataFrame:
    names = segments(spark, path) if names is None else names
    if not names:
        raise ValueError(f"there is no index at {path}")
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{what}/{n}") for n in names])


def _in(name: str, listed: str | None) -> Column:
    return F.lit(True) if listed is None else F.col(name).isin([x for x in listed.split(",") if x])


def postings_of(spark: SparkSession, path: str, wanted: list[str], names: list[str] | None = None) -> DataFrame:
    """The postings of stems: of all partitions those that may hold them, of these the rows that do. names: the segments to
    read, those in force if not given."""
    return _read(spark, path, "postings", names).where(F.col("bucket").isin(_buckets(wanted)) & F.col("stem").isin(wanted))


def cover_density(hits: Column, search: Search) -> Column:
    """Cover density of hits (stem, pos, weight; in order of pos) by weight, to six places, as r / (r + 1).

    Each shortest stretch that holds all of the query's stems adds the harmonic mean of their weights there, divided by
    one more than the words in it beyond the stems. One pass over the places keeps the last place and weight of each
    stem; a stretch ends at a place and begins at the earliest of the last places.
    """
    terms = search.terms()
    n, wanted = len(terms), F.array(*map(F.lit, search.terms()))
    state = F.struct(F.array_repeat(F.struct(F.lit(-1_000_000).alias("pos"), F.lit(1.0).alias("weight")), n).alias("last"), F.lit(-1_000_000).alias("start"), F.lit(0.0).alias("r"))

    def step(s: Column, x: Column) -> Column:
        last = F.transform(s["last"], lambda old, k: F.when(F.get(wanted, k) == x["stem"], F.struct(x["pos"].alias("pos"), x["weight"].alias("weight"))).otherwise(old))

        def added(now: Column) -> Column:
            start = F.array_min(F.transform(now, lambda p: p["pos"]))
            mean = n / F.aggregate(now, F.lit(0.0), lambda a, p: a + 1.0 / p["weight"])
            beyond = F.greatest(x["pos"] - start + 1 - n, F.lit(0))
            more = F.when(start > s["start"], mean / (1.0 + beyond)).otherwise(0.0)
            return F.struct(now.alias("last"), F.greatest(start, s["start"]).alias("start"), (s["r"] + more).alias("r"))

        return F.get(F.transform(F.array(last), added), F.lit(0))

    own = F.filter(hits, lambda h: F.array_contains(wanted, h["stem"]))
    r = F.aggregate(own, state, step, lambda s: s["r"])
    return F.round(r / (r + 1), 6)


def best_fragments(hit: list[bool], most: int, least: int, fragments: int) -> list[tuple[int, int]]:
    """One or two stretches of words with the most hits, as (first, after the last), in order.

    A stretch has up to `most` words and begins at a hit with `least` words or more after it, or at the first word. Of
    pairs that don't overlap that with the most hits in all is taken; the second must hold a hit. Of equals the first
    stretch that begins earliest counts, then the second. The best stretch that ends before a place is kept as a running
    maximum, so that one pass finds the best pair.
    """
    size = len(hit)
    sums = [0]
    for h in hit:
        sums.append(sums[-1] + h)
    count = lambda i: sums[min(i + most, size)] - sums[i]
    starts = [i for i in range(size) if i == 0 or (hit[i] and i <= size - least)]
    best, pair = max(((count(i), -i, None) for i in starts), default=(0, 0, None)), None
    if fragments > 1:
        first, k = None, 0
        for j in starts:
            while k < len(starts) and starts[k] + most <= j:
                first = max(first or (-1, 0), (count(starts[k]), -starts[k]))
                k += 1
            if first and count(j):
                pair = max(pair or (-1, 0, 0), (first[0] + count(j), first[1], -j))
    if pair and pair[0] > best[0]:
        return [(-x, min(-x + most, size)) for x in pair[1:]]
    return [(-best[1], min(-best[1] + most, size))] if size else []


def _marked(batches: Iterator[pa.RecordBatch], most: int, least: int, fragments: int) -> Iterator[pa.RecordBatch]:
    import regex

    word = regex.compile(r"[\p{L}\p{N}]+")
    for batch in batches:
        out = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist()):
            words, known = (text or "").split(), set(wanted or ())
            hit = [bool((m := word.search(w.lower())) and m[0] in known) for w in words]
            parts = (" ".join(f"<mark>{words[i]}</mark>" if hit[i] else words[i] for i in range(a, z)) for a, z in best_fragments(hit, most, least, fragments))
            out.append(" ... ".join(parts))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "snippet"])


def snippets(rows: DataFrame, most: int = 50, least: int = 20, fragments: int = 2) -> DataFrame:
    """id and snippet of rows (id, text, words): up to two stretches of the text with the most of its words, in <mark>."""
    kind = dict(rows.dtypes)["id"]
    return map_arrow(rows.select("id", "text", "words"), lambda it: _marked(it, most, least, fragments), f"id {kind}, snippet string")


def search_index(spark: SparkSession, path: str, text: str, laws: str | None = None, kinds: str | None = None, only_transitory: bool = False, limit: int | None = PAGE_ROWS, page: int = 1, rank: str = "simple", fragments: int = 1) -> DataFrame:
    """Articles of a stored index that match a query by stems, or whose number holds it: a page in order of rank, then id.

    Parameters are those of search_articles; rank is "simple" or "cover". Postings of the query's stems are read, the
    numbers of all articles, and the texts of the page's ids, a hundred at most; these are read once and written, as a row
    and its snippet are made of them. An empty query raises ValueError, as does one of fewer letters than a client sends.
    """
    asked = stemmed(parse(text))
    if not worth_asking(text):
        raise ValueError("the query is too short")
    wanted = sorted({w for phrases in (*asked.any_of, asked.excluded) for p in phrases for w in p})
    chosen = _in("law", laws) & _in("law_kind", kinds) & (F.col("kind") == "transitorio" if only_transitory else F.lit(True))
    names = segments(spark, path)
    own = postings_of(spark, path, wanted, names).where(chosen).select("id", "words", F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), F.col("stem").alias("stem"), h["weight"].alias("weight"))).alias("hits"))
    articles = _read(spark, path, "articles", names)
    numbered = articles.where(chosen & F.col("number").ilike(f"%{text}%")).select("id", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("words", "hits")), F.lit(True).alias("named"))
    both = own.withColumn("named", F.lit(False)).unionByName(numbered)
    hits = both.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"), F.max("named").alias("named"))
    score = (cover_density if rank == "cover" else weighted_rank)(F.col("hits"), asked)
    match = F.when(hits_match(F.col("hits"), asked), F.struct(score.alias("rank"), "words")).when(F.col("named"), F.struct(F.lit(0.0).alias("rank"), F.array().cast("array<string>").alias("words")))
    found = hits.select("id", F.explode(F.array_compact(F.array(match))).alias("found")).select("id", "found.rank", "found.words")  # a generator computes it once
    rows = clamp(limit, MOST_ROWS, PAGE_ROWS)
    shown = found.orderBy(F.desc("rank"), "id").offset((page - 1) * rows).limit(rows).collect()
    ids = [r["id"] for r in shown]
    ranked = spark.createDataFrame([tuple(r) for r in shown], found.schema)
    whole = articles.where(F.col("bucket").isin(_buckets(ids)) & F.col("id").isin(ids)).drop("bucket").join(F.broadcast(ranked), "id")
    whole = materialize(whole, "page")
    marked = snippets(whole, fragments=fragments)
    return whole.drop("words").join(marked, "id").orderBy(F.desc("rank"), "id")


def corpus_articles(corpus: Corpus) -> DataFrame:
    """A corpus as articles of an index, with what a page shows of each: joined once and written, as each segment takes a
    part of them."""
    laws = corpus.laws.select(F.col("code").alias("law"), F.col("name").alias("law_name"), F.col("kind").alias("law_kind"))
    divisions = corpus.divisions.select(F.col("id").alias("division_id"), place(F.col("kind"), F.col("number")).alias("place"))
    texts = joined_text(corpus.paragraphs, "\n\n").select(F.col("article_id").alias("id"), "text")
    own = corpus.articles.join(laws, "law").join(divisions, "division_id", "left").join(texts, "id", "left")
    return materialize(own.select("id", "law", "law_name", "law_kind", "number", base_number(F.col("number")).alias("base"), "kind", "place", "reforms", "text"), "index-articles")

