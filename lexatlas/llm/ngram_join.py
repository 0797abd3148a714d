"""Exact set-similarity self-join of documents on word n-grams: grouped prefix filtering.

1. A pass over the texts counts in how many documents each shingle occurs (packed 32-bit codes, counted by numpy in
   buckets of codes); those of the highest counts, up to a bounded number of codes, are broadcast. They order all
   shingles: rare ones by hash, frequent ones last, by frequency. Any order that all documents share gives exact results.
2. A second pass yields each row's set size, a digest of its set and its prefix: the first shingles in that order, so
   many that documents similar enough must share one. Rows with equal sets become one class, and classes with identical
   prefix and size one group; only groups are indexed by their prefix shingles. Rows, classes and groups go by ids of
   their own, so that a row needs no doc_id to link.
3. Prefixes are long enough for similar documents to share COMMON shingles in them. Of two sets the smaller shares them
   in a shorter prefix still, so its entries there are looked up in the larger one's list; a list without such entries is
   dropped. Group pairs pass a length filter, a positional filter, a count of the shingles shared and a bound by parity
   bitmaps of their whole sets (bitmaps differ in no more bits than the sets in shingles), and are expanded to members,
   which are verified on their whole sets. Since components are asked for, pairs come in two steps: first every group of
   a shingle's list is compared with the list's lead, and within a group every member with its first; components of the
   links found are formed; then all remaining pairs are compared, save those within one component. The lead is the group
   with the fewest rare shingles, then the largest: an edit makes shingles that no other copy has, so that it is the
   original of a group of near copies, or the least edited one, to which more of them link than to any other. So a large
   group of near copies costs about as many comparisons as it has members, yet no link between components is missed.

Lists of shingles that very many documents hold are summed up map-side, and their pairs are made in parts of both sides.
So are the pairs within a group whose members are of several components; only those whose bitmaps are near are sent on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexatlas.llm.arrays import _PLACE, mix, text_blocks, windows, word_hashes
from lexatlas.llm.columns import aside
from lexatlas.llm.graphs import components, join_counted
from lexatlas.sources.workspace import map_arrow, materialize

#: Frequent shingles that are broadcast, at most (8 bytes each); codes held by a task before they are sent on.
FREQUENT, HELD = 2_000_000, 4_000_000
#: Only shingles in so many documents or more count as frequent, also in a small corpus.
LEAST_FREQUENT = 16
#: Steps per doubling in which the threshold is sought.
STEPS = 8
#: Buckets of codes at least; a code is the upper 32 bits of a hash, and 24 of them tell codes of one bucket apart. Codes
#: that shingles share make a count too large by (all shingles) / 2^32 on average.
BUCKETS = 256
#: Shingles that the prefixes of similar documents must share (all, for smaller sets).
COMMON = 3
#: Words of 64 bits in a set's parity bitmap: each shingle flips one bit.
BITMAP = 8
#: Class representatives that are broadcast to find their texts; beyond that, they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: A shingle is hot if more than 1 / HOT_PARTS of all rows hold it, and HOT_LEAST at least; hot lists are cut in HOT_CUTS.
HOT_PARTS, HOT_LEAST, HOT_CUTS = 1000, 1000, 16
#: Members of a group that a task compares with each other member, on average.
PART = 2000


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct shingles, ascending, and where each text's begin."""
    hashes, words = word_hashes(text, lower=True)
    found, doc, _ = windows(hashes, words, size)
    counts = np.diff(words)
    for n in range(1, size):  # too short for a shingle: the whole sequence is one
        short = np.flatnonzero(counts == n)
        if len(short):
            own = sum(hashes[words[short] + k] * _PLACE[100 * n + k] for k in range(n))
            found, doc = np.concatenate([found, mix(own)]), np.concatenate([doc, short])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.searchsorted(doc[new], np.arange(len(text) + 1))


def _starts(buckets: int) -> np.ndarray:
    """The first code of each bucket."""
    return np.array([-(-(b << 32) // buckets) for b in range(buckets)], np.uint64)


def _codes(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Codes of all shingles by bucket: those seen once in this task, and the others with their counts."""

    starts = _starts(buckets)

    def send(parts: list[np.ndarray]) -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.append(np.searchsorted(codes, starts.astype(np.uint32)), len(codes))
        once, many = [], []
        for start, a, b in zip(starts, cut[:-1], cut[1:]):
            low, single = codes[a:b] - np.uint32(start), counts[a:b] == 1
            step = np.diff(low[single], prepend=np.uint32(0))
            once.append(zlib.compress(b"".join((step >> np.uint32(k)).astype(np.uint8).tobytes() for k in (0, 8, 16)), 1))
            many.append(zlib.compress(np.stack([low[~single], counts[a:b][~single].astype(np.uint32)], 1).tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(once, pa.binary()), pa.array(many, pa.binary())], names=["bucket", "once", "many"])

    parts, held = [], 0
    for _, text in text_blocks(batches):
        parts.append((shingle_sets(text, size)[0] >> np.uint64(32)).astype(np.uint32))
        held += len(parts[-1])
        if held > HELD:
            yield send(parts)
            parts, held = [], 0
    if held:
        yield send(parts)


def _counted(table: pa.Table, buckets: int) -> pa.Table:
    """Codes of one bucket in LEAST_FREQUENT documents or more."""
    bucket = table.column("bucket")[0].as_py()
    unpacked = [np.frombuffer(zlib.decompress(x), np.uint8).reshape(3, -1).astype(np.uint32) for x in table.column("once").to_pylist()]
    once = np.concatenate([np.cumsum(p[0] | p[1] << np.uint32(8) | p[2] << np.uint32(16), dtype=np.uint32) for p in unpacked])
    many = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint32).reshape(-1, 2) for x in table.column("many").to_pylist()])
    low = np.concatenate([once, many[:, 0]])
    low, which = np.unique(low, return_inverse=True)
    counts = np.bincount(which, np.concatenate([np.ones(len(once)), many[:, 1]]), len(low)).astype(np.int64)
    code = int(_starts(buckets)[bucket]) + low.astype(np.int64)
    often = counts >= LEAST_FREQUENT
    return pa.table({"code": code[often], "df": counts[often]})


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the frequent shingles, ascending, and the number of documents that hold each.

    The threshold is LEAST_FREQUENT, or the lowest step above it that FREQUENT codes at most reach: it follows from the
    counts themselves, so that shingles of small groups stay frequent in a corpus of any size as long as there is room
    for their codes. Two shingles with one code share its count, which only shapes the order.
    """
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = map_arrow(docs.select("text"), lambda it: _codes(it, size, buckets), "bucket int, once binary, many binary")
    counted = materialize(packed.groupBy("bucket").applyInArrow(lambda t: _counted(t, buckets), "code long, df long"), "shingle-counts")
    steps = counted.groupBy(F.floor(F.log2("df") * STEPS).alias("step")).agg(F.count("*").alias("codes"), F.min("df").alias("df"))
    least, room = None, FREQUENT
    for step in steps.orderBy(F.desc("step")).collect():  # 64 * STEPS rows at most
        room -= step["codes"]
        if room < 0:
            break
        least = step["df"]
    if least is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    found = counted.where(F.col("df") >= least).toPandas().sort_values("code")
    return found["code"].to_numpy(np.uint32), found["df"].clip(upper=2**32 - 1).to_numpy(np.uint32)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets that overlap enough share COMMON shingles among their first n - o + COMMON, o the least overlap of a set of n."""
    least = -(-n * percent // 100)
    return n - least + np.minimum(COMMON, least)


def _index_size(n: Column, percent: int) -> Column:
    """The same for the smaller of two sets, n: their overlap is 2 * percent * n / (100 + percent) at least."""
    least = F.ceil(2 * percent * n / (100 + percent))
    return n - least + F.least(F.lit(COMMON), least)


_BITS = [f"bits{w}" for w in range(BITMAP)]
_DOCS = f"doc_id long, th long, n long, a long, b long, pa long, pb long, {', '.join(f'{c} long' for c in _BITS)}, rare int, hot_from int, prefix array<long>"


def bitmaps(found: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The words of each set's parity bitmap."""
    bit = mix(found ^ np.uint64(5)) % np.uint64(64 * BITMAP)
    flip, word = np.uint64(1) << (bit % np.uint64(64)), bit // np.uint64(64)
    out = []
    for w in range(BITMAP):
        run = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(word == w, flip, np.uint64(0)))])
        out.append((run[offsets[1:]] ^ run[offsets[:-1]]).view(np.int64))
    return out


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, percent: int, hot: int, shared) -> Iterator[pa.RecordBatch]:
    codes, counts = shared.value
    add = lambda values, offsets: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])[offsets])
    for batch, text in text_blocks(batches):
        found, offsets = shingle_sets(text, size)
        n = np.diff(offsets)
        doc = np.repeat(np.arange(len(n)), n)
        digests = [add(mix(found ^ np.uint64(k)), offsets).view(np.int64) for k in (1, 2)]
        df = np.zeros(len(found), np.uint32)
        if len(codes):
            code = (found >> np.uint64(32)).astype(np.uint32)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            df = np.where(codes[at] == code, counts[at], np.uint32(0))
        rare = np.bincount(doc[df == 0], minlength=len(n)).astype(np.int32)
        order = np.lexsort((found, df, doc))
        rank = np.arange(len(found)) - np.repeat(offsets[:-1], n)
        own = rank < np.repeat(np.where(n > 0, prefix_size(n, percent), 0), n)
        prefix = found[order][own]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(doc[own], minlength=len(n)))])
        keys = [add(mix(prefix ^ np.uint64(k)), ends).view(np.int64) for k in (3, 4)]
        cool = add((df[order][own] < hot).astype(np.uint64), ends).astype(np.int32)  # hot ones come last
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(prefix.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n), *map(pa.array, digests), *map(pa.array, keys), *map(pa.array, bitmaps(found, offsets)), pa.array(rare), pa.array(cool), lists], names=[x.split()[0] for x in _DOCS.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch, text in text_blocks(batches):
        found, offsets = shingle_sets(text, size)
        data = memoryview(found.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([bytes(data[8 * a : 8 * b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["id", "set"])


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sx"), batch.column("sy")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _possible(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes n and m may be similar if a shingle at places i and j of their order is one of their first
    COMMON common ones."""
    most = COMMON + F.least(n - i - 1, m - j - 1)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of sizes n and m share as many shingles in their prefixes as similar ones do."""
    return shared >= F.least(F.lit(COMMON), F.ceil(F.least(n, m) * percent / 100))


def _near(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of sizes n and m may be similar by bitmaps of two groups: bits that all sets of one have and none of
    the other (columns all*, any*; with _2 at the end for the other) are shingles that one set has and the other lacks."""
    lacks = lambda w, x, y: F.bit_count(F.col(f"all{w}{x}").bitwiseAND(F.bitwise_not(F.col(f"any{w}{y}"))))
    apart = reduce(Column.__add__, [lacks(w, x, y) for w in range(BITMAP) for x, y in (("", "_2"), ("_2", ""))])
    return (100 + percent) * apart <= (100 - percent) * (n + m)


def _of_lists(listed: DataFrame, **sums: Column) -> DataFrame:
    """Adds aggregates over each shingle's list to its entries. Hot lists are summed map-side; there are fewer of them
    than frequent shingles, and the sums are broadcast."""
    w = Window.partitionBy("token")
    hot = listed.where("hot")
    per_token = hot.groupBy("token").agg(*[c.alias(name) for name, c in sums.items()])
    return listed.where("not hot").withColumns({name: c.over(w) for name, c in sums.items()}).unionByName(hot.join(F.broadcast(per_token), "token"))


def _pairs_of_lists(lists: DataFrame, percent: int) -> DataFrame:
    """(gid, gid2, n, n2, shared) of entries of different groups in one list, the first the smaller set's (by size, then
    id) in its shorter prefix. Both sides of a hot list are cut: the smaller ones by id, and each part meets all larger."""
    smaller = lists.where(F.col("i") < _index_size(F.col("n"), percent))
    larger = lists.select("token", "hot", *[F.col(c).alias(f"{c}_2") for c in ("gid", "n", "i", "label", "mixed")])
    order = (F.col("n") < F.col("n_2")) | ((F.col("n") == F.col("n_2")) & (F.col("gid") < F.col("gid_2")))
    apart = F.col("mixed") | F.col("mixed_2") | (F.col("label") != F.col("label_2"))
    possible = order & apart & _possible(F.col("n"), F.col("i"), F.col("n_2"), F.col("i_2"), percent)
    cool = smaller.where("not hot").drop("hot").join(larger.where("not hot").drop("hot"), "token")
    cut = smaller.where("hot").drop("hot").withColumn("cut", F.pmod(F.xxhash64("gid"), F.lit(HOT_CUTS)).cast("int"))
    parts = larger.where("hot").drop("hot").withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(HOT_CUTS - 1))))
    hot = cut.join(parts, ["token", "cut"]).drop("cut")
    pairs = cool.where(possible).unionByName(hot.where(possible)).groupBy("gid", F.col("gid_2").alias("gid2")).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("n_2").alias("n2"))
    return pairs.where(_enough(F.col("shared"), F.col("n"), F.col("n2"), percent))


def _pairs_of_members(members: DataFrame, mixed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(x, y) of members (gid, id, n, label) of one group with different labels and near bitmaps, for the groups in mixed
    (gid, and n, how many members). Each group is cut in parts of about PART members, and each part meets all."""
    bits = [F.col(b).alias(f"{kind}{b[4:]}") for b in _BITS for kind in ("all", "any")]
    cuts = F.ceil(F.col("members") / PART).cast("int")
    counted = mixed.withColumn("members", F.col("n"))
    own = join_counted(members.withColumnRenamed("n", "size"), counted, ["gid"], members.count())
    own = own.join(classes.select("id", *bits), "id").withColumnsRenamed({"size": "n"})
    own = materialize(own.select("gid", "id", "n", "label", cuts.alias("cuts"), *[f"{kind}{w}" for w in range(BITMAP) for kind in ("all", "any")]), "mixed-members")
    part = own.withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).drop("cuts")
    every = own.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    other = every.select("gid", "cut", *[F.col(c).alias(f"{c}_2") for c in every.columns if c not in ("gid", "cut")])
    apart = (F.col("id") < F.col("id_2")) & (F.col("label") != F.col("label_2")) & _near(F.col("n"), F.col("n_2"), percent)
    return part.join(other, ["gid", "cut"]).where(apart).select(F.col("id").alias("x"), F.col("id_2").alias("y"))


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of each row: doc_id, th (hash of its text), n (set size), root (one for each component; null for empty sets) and
    component_id (the component's smallest doc_id)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    shared = spark.sparkContext.broadcast(frequent_shingles(own, size))
    hot = max(HOT_LEAST, own.count() // HOT_PARTS)
    rows = map_arrow(own, lambda it: _prefixes(it, size, percent, hot, shared), _DOCS)
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "prefixes")

    narrow = rows.select("id", "doc_id", "n", "a", "b", "pa", "pb", *_BITS).where("n > 0")
    classes = narrow.groupBy("a", "b", "n").agg(F.min("id").alias("id"), F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("pa", "pb", *_BITS)])
    classes = materialize(classes, "classes")
    bounds = [f(f"bits{w}").alias(f"{name}{w}") for w in range(BITMAP) for name, f in (("all", F.bit_and), ("any", F.bit_or))]
    groups = materialize(classes.groupBy("n", "pa", "pb").agg(F.min("id").alias("gid"), F.count("*").alias("m"), *bounds), "groups")
    # shingles that several groups share, with the list's lead
    heads = rows.select(F.col("id").alias("gid"), "n", "rare", "prefix", "hot_from").join(groups.select("gid"), "gid", "left_semi")
    listed = heads.select("gid", F.col("n").cast("int").alias("n"), "rare", "hot_from", F.posexplode("prefix").alias("i", "token")).withColumn("hot", F.col("i") >= F.col("hot_from")).drop("hot_from")
    smaller = F.col("i") < _index_size(F.col("n"), percent)
    listed = _of_lists(listed, lists=F.count("*"), some=F.max(smaller), lead=F.min(F.struct("rare", (-F.col("n")).alias("small"), "gid", "n", "i"))).where("lists > 1 and some")
    listed = materialize(listed.select("token", "hot", "gid", "n", "i", F.col("lead.gid").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.i").alias("lead_i")), "shared-prefixes")
    several = groups.where("m > 1").select(F.col("n").alias("size"), "pa", "pb", "gid", F.col("m").alias("n"))
    in_several = join_counted(classes.select("id", F.col("n").alias("size"), "pa", "pb"), several, ["size", "pa", "pb"], classes.count())
    members = materialize(in_several.select("gid", "id", F.col("size").alias("n")), "group-members")

    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough; sets are made from the texts of what is in a pair."""
        wanted = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
        hint = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda df: df
        places = rows.select("id", F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).join(hint(wanted), "id")
        texts = own.join(hint(places), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th"))).select("id", "text")
        sets = materialize(map_arrow(texts, lambda it: _sets(it, size), "id long, set binary"), "sets")
        one = sets.groupBy("id").agg(F.first("set").alias("set"))  # rows that repeat have one id
        x, y = one.select(F.col("id").alias("a"), F.col("set").alias("sx")), one.select(F.col("id").alias("b"), F.col("set").alias("sy"))
        return map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "sx", "sy"), lambda it: _similar(it, percent), "a long, b long")

    stars = listed.where((F.col("gid") != F.col("lead")) & _possible(F.col("n"), F.col("i"), F.col("lead_n"), F.col("lead_i"), percent))
    stars = stars.groupBy(F.col("lead").alias("a"), F.col("gid").alias("b")).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("lead_n").alias("m"))
    stars = stars.where(_enough(F.col("shared"), F.col("n"), F.col("m"), percent)).select("a", "b")
    stars = materialize(stars.unionByName(members.where("id != gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))).distinct(), "star-pairs")
    links = materialize(verify(stars), "links")
    labels = components(links)

    # what is left: pairs of different components, less those compared already
    label = lambda df, of, to: df.join(labels.select(F.col("node").alias(of), F.col("root").alias("_r")), of, "left").withColumn(to, F.coalesce("_r", of)).drop("_r")
    in_groups = materialize(label(members, "id", "label"), "labelled-members")
    mixed = in_groups.groupBy("gid").agg((F.min("label") != F.max("label")).alias("mixed"), F.count("*").alias("m"))
    lists = label(listed.select("token", "hot", "gid", "n", "i"), "gid", "label").join(mixed.drop("m"), "gid", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    lists = _of_lists(lists, first=F.min("label"), last=F.max("label"), any=F.max("mixed")).where("first != last or any")
    lists = materialize(lists.select("token", "hot", "gid", "n", "i", "label", "mixed"), "mixed-lists")
    pairs = materialize(_pairs_of_lists(lists, percent), "group-pairs")
    bits = groups.select("gid", *[c for c in groups.columns if c[:3] in ("all", "any")])
    other = bits.select(F.col("gid").alias("gid2"), *[F.col(c).alias(f"{c}_2") for c in bits.columns if c != "gid"])
    pairs = pairs.join(bits, "gid").join(other, "gid2").where(_near(F.col("n"), F.col("n2"), percent)).select("gid", "gid2")
    one = lambda g, to: F.coalesce(F.col(to), F.col(g))
    side = lambda g, to: in_groups.select(F.col("gid").alias(g), F.col("id").alias(to))
    expanded = pairs.join(side("gid", "x"), "gid", "left").join(side("gid2", "y"), "gid2", "left").select(one("gid", "x").alias("x"), one("gid2", "y").alias("y"))
    inner = _pairs_of_members(in_groups, mixed.where("mixed").select("gid", F.col("m").alias("n")), classes, percent)
    rest = label(label(expanded.unionByName(inner), "x", "lx"), "y", "ly").where("lx != ly")
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialize(verify(materialize(rest.join(done, ["a", "b"], "left_anti"), "rest-pairs")), "links")
    joined = label(label(more, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    roots = components(joined)

    owner = label(classes.select("a", "b", "n", "id", "doc_id", "rows"), "id", "label")
    owner = owner.join(roots.select(F.col("node").alias("label"), F.col("root").alias("_r")), "label", "left").withColumn("root", F.coalesce("_r", "label"))
    owner = materialize(owner.select("a", "b", F.col("n").alias("size"), "rows", "root", "doc_id"), "owners")
    least = owner.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    owner = join_counted(owner.drop("doc_id"), least, ["root"], owner.count()).select("a", "b", "size", F.col("rows").alias("n"), "root", "component_id")
    owner = materialize(owner, "class-components")
    found = rows.select("doc_id", "th", F.col("n").alias("size"), "a", "b")
    linked = join_counted(found.where("size > 0"), owner, ["a", "b", "size"], rows.count())
    none = found.where("size = 0").withColumns({"root": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return linked.unionByName(none).select("doc_id", "th", F.col("size").alias("n"), "root", "component_id")


def similar_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of each document (doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text with A-Z in lower case; a document's set holds its distinct shingles
    of `size` words, or with fewer words the whole sequence as one. Two documents link when their sets' Jaccard
    similarity is `percent` / 100 or more; component_id is the smallest doc_id that links reach. A document without
    words (null or empty text) has an empty set and links with nothing: component_id is its own doc_id.

    Each row is a document, whether or not its doc_id is null or repeats: rows link by their texts alone, and a row
    without a doc_id may connect others. component_id is null where no row of a component has a doc_id. Other columns
    are ignored; an empty table gives no rows.
    """
    return _components(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of similar documents, all columns: that of the smallest doc_id (null last), then of the
    smallest hash of its text; of rows alike in both, any one. Rows without words stay.

    Rows that more than 1 / HOT_PARTS of the table repeats are found by a broadcast of their keys (fewer than HOT_PARTS)
    and taken together map-side, so that no task gets all of them.
    """
    keys = ["_doc", "_th"]
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_doc"), F.col("th").alias("_th"))
    found = materialize(_components(docs, size, percent).where("root is not null").select("doc_id", "th", "root"), "rows-with-roots")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k")).select("k.doc_id", "k.th").select(*key)
    often = found.groupBy(*key).count().where(F.col("count") > max(1, found.count() // HOT_PARTS)).select(*keys)
    often = materialize(first.join(often, keys, "left_semi"), "hot-rows")
    names, docs = docs.columns, aside(docs)
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.where(words).withColumns({"_doc": key[0], "_th": F.xxhash64("text")})
    seldom = keyed.join(F.broadcast(often), keys, "left_anti").join(first, keys)
    hot = keyed.join(F.broadcast(often), keys)
    kept = seldom.dropDuplicates(keys).unionByName(hot.dropDuplicates(keys)).drop(*keys)
    return kept.unionByName(docs.where(~words)).select(*(F.col(f"`{c}`") for c in docs.columns)).toDF(*names)
