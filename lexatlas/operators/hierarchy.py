"""Trees of divisions and paragraphs: closures, subtree counts, breadcrumbs, path resolution, legality.

Trees may be of any depth. Closures grow by levels from the nodes that are asked for; what depends on a node's whole
chain alone goes by pointer doubling, in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lexatlas.functions.numbering import level, path_text, shown_kind
from lexatlas.sources.corpus import Corpus
from lexatlas.sources.workspace import fresh_path, materialize

#: Rounds of chains_within before rows are written: enough for trees with three levels below their roots.
ROUNDS = 2


def _by_levels(first: DataFrame, step: Callable[[DataFrame], DataFrame], again: Column) -> DataFrame:
    """first and what step makes of each level until it is empty, with the level as distance; each level is written once.
    `again` holds for a row that has come back to where it started: ValueError."""
    spark, kinds = first.sparkSession, first.schema
    path = fresh_path(spark, "levels")
    d, here = 0, first
    while True:
        here.write.parquet(f"{path}/distance={d}")
        written = spark.read.schema(kinds).parquet(f"{path}/distance={d}")
        rows, back = written.agg(F.count("*"), F.coalesce(F.bool_or(again), F.lit(False))).first()
        if not rows:
            return spark.read.schema(StructType([*kinds.fields, StructField("distance", IntegerType())])).parquet(path)
        if d and back:
            raise ValueError("nodes are their own ancestors")
        here, d = step(written), d + 1


def ancestors(nodes: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(id, ancestor, distance) for each node (id, parent_id) and its ancestors, itself at distance 0; `start`: of these
    nodes alone. A parent that isn't a node ends its chain; a cycle raises ValueError."""
    up = nodes.select(F.col("id").alias("ancestor"), F.col("parent_id").alias("up"))
    first = (nodes if start is None else start).select("id", F.col("id").alias("ancestor"), F.col("parent_id").alias("next"))
    step = lambda here: here.where("next is not null").select("id", F.col("next").alias("ancestor")).join(up, "ancestor").select("id", "ancestor", F.col("up").alias("next"))
    return _by_levels(first, step, F.col("id") == F.col("ancestor")).drop("next")


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, distance) of each of the roots (id) and the nodes (id, parent_id) below it; a cycle raises ValueError."""
    below = nodes.where("parent_id is not null").select(F.col("parent_id").alias("_up"), F.col("id").alias("_id"))
    first = roots.select(F.col("id").alias("root"), "id")
    step = lambda here: here.join(below, F.col("id") == F.col("_up")).select("root", F.col("_id").alias("id"))
    return _by_levels(first, step, F.col("id") == F.col("root"))


def chains(nodes: DataFrame) -> DataFrame:
    """(id, depth, parts) of each node (id, parent_id, part): its ancestors' number, and the parts of its chain from the
    root, itself included, nulls left out.

    Pointer doubling: each round joins every unfinished node with the node it points at, which already knows as much of
    the chain above. A parent that isn't a node ends its chain; a cycle raises ValueError.
    """
    own = nodes.select("id", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("int").alias("depth"), F.array_compact(F.array("part")).alias("parts"))
    state, most, rounds = materialize(own, "chains"), None, 0
    while not state.where("up is not null").isEmpty():
        if most is None:
            most = state.count()
        if 2**rounds > 2 * most:
            raise ValueError("nodes are their own ancestors")
        there = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("parts").alias("_parts"))
        moved = state.where("up is not null").join(there, "up", "left").select(
            "id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(-1))).alias("depth"), F.concat(F.coalesce("_parts", F.array().cast("array<string>")), "parts").alias("parts"))
        state, rounds = materialize(state.where("up is null").unionByName(moved), "chains"), rounds + 1
    return state.select("id", "depth", "parts")


def chains_within(nodes: DataFrame, group: list[str]) -> DataFrame:
    """nodes with depth, and with parts for a column part, as in chains, where each tree lies within a group: group
    columns, id (one row each in its group), parent_id, any others.

    Pointer doubling, but a group's rows come together once, and not at all if they lie in buckets by group; there each
    unfinished node is a second row under the one it points at, and a window hands it what that one knows. After ROUNDS
    rounds rows are written, and only groups with unfinished nodes go on.
    """
    known = ["_up", "depth", *(["parts"] if "part" in nodes.columns else [])]
    rest = [c for c in nodes.columns if c not in ("parent_id", "part")]
    own = Window.partitionBy(*group)
    parts = [F.array_compact(F.array("part")).alias("parts")] if "part" in nodes.columns else []
    more = F.col("parent_id").isNotNull()
    here = nodes.select(*rest, F.col("parent_id").alias("_up"), more.cast("int").alias("depth"), *parts, F.count("*").over(own).alias("_most"))
    done, kept = [], [*rest, *known[1:]]
    while True:
        for _ in range(ROUNDS):
            here = _doubled(here, group, known)
        state = materialize(here.withColumn("_open", F.max(F.col("_up").isNotNull()).over(own)), "chains")
        done.append(state.where("not _open").select(*kept))
        open_ = state.where("_open").drop("_open")
        unfinished, back = open_.where("_up is not null").agg(F.count("*"), F.bool_or(F.col("depth") >= F.col("_most"))).first()
        if back:
            raise ValueError("nodes are their own ancestors")
        if not unfinished:
            return reduce(DataFrame.unionByName, done)
        here = open_.repartition(*group)


def _doubled(state: DataFrame, group: list[str], known: list[str]) -> DataFrame:
    """A round of chains_within: what the node at _up knows, put before what a row knows. Rows under a node are in order,
    the node itself first."""
    columns = state.columns
    under = F.array_compact(F.array(F.struct(F.col("id").alias("_at"), F.lit(False).alias("_asks")), F.when(F.col("_up").isNotNull(), F.struct(F.col("_up").alias("_at"), F.lit(True).alias("_asks")))))
    first = Window.partitionBy(*group, "_at").orderBy("_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    there = F.first(F.when(~F.col("_asks"), F.struct(*known))).over(first)
    rows = state.select(*columns, F.inline(under)).withColumn("_there", there).where("_asks or _up is null")
    found = F.when(F.col("_asks"), F.col("_there"))
    moved = {"_up": found["_up"], "depth": F.col("depth") + F.when(F.col("_asks"), F.coalesce(found["depth"], F.lit(-1))).otherwise(0)}
    if "parts" in known:
        moved["parts"] = F.concat(F.coalesce(found["parts"], F.array().cast("array<string>")), "parts")
    return rows.withColumns(moved).select(*columns)


def subtree_counts(corpus: Corpus) -> DataFrame:
    """(id, total) of articles at or below each division: counted by division first, then summed along the ancestors."""
    own = corpus.articles.groupBy(F.col("division_id").alias("id")).agg(F.count("*").alias("own"))
    return ancestors(corpus.divisions).join(own, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("own").alias("total"))


def first_last(corpus: Corpus) -> DataFrame:
    """(id, first, last): numbers of the first and last article directly in each division."""
    return corpus.articles.groupBy(F.col("division_id").alias("id")).agg(F.min_by("number", "position").alias("first"), F.max_by("number", "position").alias("last"))


def structure(corpus: Corpus) -> DataFrame:
    """A law's divisions with path text, level, articles at or below, first and last direct article, and parent."""
    d = corpus.divisions
    out = d.join(subtree_counts(corpus), "id", "left").join(first_last(corpus), "id", "left")
    return out.select("id", "kind", "number", "name", path_text(d.kind, d.number, d.name).alias("path_text"), level(d.kind).alias("level"), F.coalesce("total", F.lit(0)).alias("total"), "first", "last", "parent_id", "position")


def older_structure(corpus: Corpus) -> DataFrame:
    """The older form of a law's structure: full path text, level, direct and inherited articles together, and the smallest
    number of those directly in a division."""
    d = corpus.divisions
    smallest = corpus.articles.groupBy(F.col("division_id").alias("id")).agg(F.min("number").alias("first"))
    out = d.join(paths(d).select("id", "path_text"), "id").join(subtree_counts(corpus), "id", "left").join(smallest, "id", "left")
    return out.select("id", "kind", "number", "name", "path_text", level(F.col("kind")).alias("level"), F.coalesce("total", F.lit(0)).alias("total"), "first")


def children(corpus: Corpus, division: int) -> DataFrame:
    """Direct children of a division, as in structure; only what lies below them is read."""
    own = corpus.divisions.where(F.col("parent_id") == division)
    below = descendants(corpus.divisions, own).select("root", F.col("id").alias("division_id"))
    articles = corpus.articles.join(below, "division_id").groupBy(F.col("root").alias("id")).agg(F.count("*").alias("total"))
    direct = corpus.articles.join(own.select(F.col("id").alias("division_id")), "division_id", "left_semi")
    out = own.join(articles, "id", "left").join(first_last(Corpus(corpus.laws, own, direct, lambda: corpus.paragraphs)), "id", "left")
    return out.select("id", "kind", "number", "name", path_text(F.col("kind"), F.col("number"), F.col("name")).alias("path_text"), level(F.col("kind")).alias("level"), F.coalesce("total", F.lit(0)).alias("total"), "first", "last", "position")


def inherited_range(corpus: Corpus) -> DataFrame:
    """(id, first, last): first and last article at or below each division, by position."""
    own = corpus.articles.groupBy(F.col("division_id").alias("id")).agg(F.min(F.struct("position", "number")).alias("lo"), F.max(F.struct("position", "number")).alias("hi"))
    up = ancestors(corpus.divisions).join(own, "id").groupBy(F.col("ancestor").alias("id")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return up.select("id", F.col("lo.number").alias("first"), F.col("hi.number").alias("last"))


def breadcrumb(corpus: Corpus, article: int) -> DataFrame:
    """An article's divisions: distance (0 its own), id, kind, number, name, path text; the root comes last by distance."""
    d = corpus.divisions
    own = d.join(corpus.articles.where(F.col("id") == article).select(F.col("division_id").alias("id")), "id", "left_semi")
    up = ancestors(d, own).select(F.col("ancestor").alias("id"), "distance")
    return d.join(up, "id").select("distance", "id", "kind", "number", "name", path_text(d.kind, d.number, d.name).alias("path_text"))


def paths(divisions: DataFrame, separator: str = " > ") -> DataFrame:
    """Materialised paths: id, path_ids (root first), path_text, depth."""
    return shown_paths(stored_paths(divisions), separator)


def shown_paths(stored: DataFrame, separator: str = " > ") -> DataFrame:
    """id, path_ids, path_text and depth of stored paths."""
    return stored.select("id", "path_ids", F.array_join("labels", separator).alias("path_text"), (F.size("path_ids") - 1).alias("depth"))


def move_subtrees(stored: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored paths after some divisions got other parents: all of them, and those that are new.

    stored: rows of stored_paths. moves: (id, parent_id), one row for each division that moves, a null parent for one that
    becomes a root; unknown ids are left out. Only rows at or below a moved division are made anew: the path of each
    moved division from that of its new parent, the paths below from its own. A parent that lies in another moved subtree
    waits for that one, so that there are as many rounds as moves that rest on each other. An unknown parent, and a move
    of a division below itself, raise ValueError.
    """
    asked = moves.select(F.col("id").alias("moved"), F.col("parent_id").alias("to"))
    labels = stored.select(F.col("id").alias("moved"), F.element_at("labels", -1).alias("label"))
    asked = materialize(asked.join(labels, "moved"), "moves")
    nodes = stored.select("id", F.posexplode("path_ids").alias("pos", "moved"))
    touched = materialize(nodes.join(asked.select("moved"), "moved").groupBy("id").agg(F.max("pos").alias("pos")), "touched")
    up = stored.select(F.col("id").alias("to"), F.col("path_ids").alias("up_ids"), F.col("labels").alias("up_labels"))
    left = asked.join(up, "to", "left").join(touched.withColumnsRenamed({"id": "to", "pos": "up_pos"}), "to", "left")
    left = materialize(left, "moves")
    if not left.where("to is not null and up_ids is null").isEmpty():
        raise ValueError("a division moves to a parent that isn't there")
    none = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    rest = lambda c: F.slice(c, F.col("up_pos") + 2, F.size(c))
    shown = lambda ids, names: (F.concat(ids, F.array("moved")).alias("new_ids"), F.concat(names, F.array("label")).alias("new_labels"))
    done = materialize(left.where("up_pos is null").select("moved", *shown(F.coalesce("up_ids", none[0]), F.coalesce("up_labels", none[1]))), "moved-paths")
    left = left.where("up_pos is not null").withColumn("base", F.get("up_ids", F.col("up_pos")))
    waiting, made = left.count(), done
    while waiting:
        base = done.select(F.col("moved").alias("base"), F.col("new_ids").alias("base_ids"), F.col("new_labels").alias("base_labels"))
        ready = left.join(base, "base").select("moved", *shown(F.concat("base_ids", rest(F.col("up_ids"))), F.concat("base_labels", rest(F.col("up_labels")))))
        done = materialize(ready, "moved-paths")
        left = materialize(left.join(done.select("moved"), "moved", "left_anti"), "moves")
        before, waiting = waiting, left.count()
        if waiting == before:
            raise ValueError("a division moves below itself")
        made = made.unionByName(done)
    own = stored.join(touched, "id").withColumn("moved", F.get("path_ids", F.col("pos"))).join(made, "moved")
    below = lambda c: F.slice(c, F.col("pos") + 2, F.size(c))
    new = materialize(own.select("id", F.concat("new_ids", below(F.col("path_ids"))).alias("path_ids"), F.concat("new_labels", below(F.col("labels"))).alias("labels")), "new-paths")
    return stored.join(new.select("id"), "id", "left_anti").unionByName(new), new


def stored_paths(divisions: DataFrame) -> DataFrame:
    """Paths to store: id, path_ids and labels, the root first."""
    named = divisions.select(F.col("id").alias("ancestor"), path_text(F.col("kind"), F.col("number"), F.col("name")).alias("t"))
    up = ancestors(divisions).join(named, "ancestor").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("ancestor").alias("a"), "t"))).alias("p"))
    return up.select("id", F.transform("p", lambda x: x["a"]).alias("path_ids"), F.transform("p", lambda x: x["t"]).alias("labels"))


def resolve_path(corpus: Corpus, steps: list[str], separator: str = " > ") -> DataFrame:
    """The division that kind/number pairs lead to from a root: `['titulo', '1', 'capitulo', '3']`; letters' case is
    ignored, accents are not. With its full path and direct articles. No row if a step fails or the list is odd or empty.

    One join a step, from the root down, each with the few divisions of that kind and number.
    """
    d = corpus.divisions.withColumn("path_text", path_text(F.col("kind"), F.col("number"), F.col("name")))
    if not steps or len(steps) % 2:
        return d.select("id", "kind", "number", "name", "path_text").withColumn("total", F.lit(0).cast("long")).limit(0)
    named = [d.where((F.lower("kind") == F.lower(F.lit(k))) & (F.upper("number") == F.upper(F.lit(n)))) for k, n in zip(steps[::2], steps[1::2])]
    here = named[0].where("parent_id is null")
    for following in named[1:]:
        above = here.select(F.col("id").alias("parent_id"), F.col("path_text").alias("_above"))
        here = following.join(above, "parent_id").withColumn("path_text", F.concat("_above", F.lit(separator), "path_text"))
    own = corpus.articles.join(here.select(F.col("id").alias("division_id")), "division_id", "left_semi").groupBy(F.col("division_id").alias("id")).agg(F.count("*").alias("total"))
    return here.join(own, "id", "left").select("id", "kind", "number", "name", "path_text", F.coalesce("total", F.lit(0)).alias("total"))


#: Kinds of division and the kinds that may hold them; "" is the root.
ALLOWED = (("titulo", "libro"), ("capitulo", "titulo"), ("capitulo", "libro"), ("seccion", "capitulo"), ("subseccion", "seccion"), ("libro", ""), ("titulo", ""), ("capitulo", ""))


def illegal_parents(divisions: DataFrame) -> DataFrame:
    """Divisions whose parent's kind is not allowed: id, kind, parent_kind ("" at the root)."""
    spark = divisions.sparkSession
    parents = divisions.select(F.col("id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    own = divisions.select("id", "kind", "parent_id").join(parents, "parent_id", "left").select("id", "kind", F.coalesce("parent_kind", F.lit("")).alias("parent_kind"))
    return own.join(F.broadcast(spark.createDataFrame(list(ALLOWED), "kind string, parent_kind string")), ["kind", "parent_kind"], "left_anti").select("id", "kind", "parent_kind")


def shown_divisions(divisions: DataFrame) -> DataFrame:
    """Divisions with the kind as it is displayed."""
    return divisions.select("id", shown_kind(F.col("kind")).alias("shown"), "number")


def paragraph_tree(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with their depth, and whether they continue another: text below the root."""
    nodes = paragraphs.withColumns({"id": F.col("number"), "parent_id": F.col("parent_number")})
    tree = chains_within(nodes, ["law", "article_id"])
    return tree.select("law", "article_id", "number", *(c for c in paragraphs.columns if c not in ("law", "article_id", "number")), "depth", ((F.col("kind") == "texto") & (F.col("depth") > 0)).alias("continues"))
