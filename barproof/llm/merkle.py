"""A Merkle manifest: a hash for each row, subroot, root and the proof that leads from one to the other.

1. *Leaves* hash a row's fields, each as ``-`` if null, else byte count, ``:`` and value.
2. *Numbers.*  Leaves are range-sorted by (source, doc_id), so a source with most rows
   is spread; a range counts its rows of each source, and the counts, summed along
   the ranges, turn positions into row numbers.
3. *Levels.*  A node's parent is its number divided by the fanout; at most ``fanout``
   children meet in a sorted array, whose hashes joined give the parent's.  A level
   is a table with a third of the rows of the one below.  Sources end at the level at
   which one node remains, the subroot; subroots go through the same levels to the root.
4. *Proofs* go down from the root: a level's arrays of children join the proofs of
   their parents, and each child's own siblings come before its parent's.  So all
   joins but the last are over fewer rows than there are documents.
5. *Verification* folds a row as it is now, with the siblings recorded, to a root.

Only built-in functions; the driver learns how many rows the largest source has, and
the root.

Defined results: rows of one doc_id stand in the order of their hashes, a null
doc_id before all others; null and empty text or source differ; repeated rows are
leaves of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barproof.llm import graph

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def row_hash(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields.values())), 256)


def of_source(source: Column) -> Column:
    """A key that tells null from empty and puts null first."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a table with ``grp``) -> with ``i``, the row's number in its group, and ``n``, the group's size."""
    by = ["grp", *order, "row"]
    placed = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    # counts within a partition, which is a range of the order
    placed = placed.drop("row").withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33))
    placed = graph.left_over(placed)
    sizes = placed.groupBy("grp", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many"))  # one row a range and group
    group = Window.partitionBy("grp")
    sizes = sizes.withColumn("base", F.sum("many").over(group.orderBy("range")) - F.col("many")).withColumn("n", F.sum("many").over(group))
    return placed.join(sizes, ["grp", "range"]).withColumn("i", F.col("at") - F.col("first") + F.col("base")).drop("at", "range", "first", "many", "base")


def build(leaves: DataFrame, payload: list[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """``leaves`` (grp, i, n, h and payload) -> the levels' groups of children (grp, j, kids), and roots (grp, h, level)."""
    up = lambda n: F.floor((n + fanout - 1) / fanout).cast("long")
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, levels, roots = leaves, [], [leaves.where("n = 1").select("grp", "h", F.lit(0).alias("level"))]
    while most > 1:
        extra = payload if not levels else []
        kids = F.array_sort(F.collect_list(F.struct("i", "h", *extra)))  # at most ``fanout``
        groups = nodes.where("n > 1").groupBy("grp", F.floor(F.col("i") / fanout).alias("j"), "n").agg(kids.alias("kids"))
        groups = graph.left_over(groups)
        levels.append(groups)
        nodes = groups.select("grp", F.col("j").alias("i"), up(F.col("n")).alias("n"), F.sha2(F.array_join(F.transform("kids", lambda x: x["h"]), ""), 256).alias("h"))
        roots.append(nodes.where("n = 1").select("grp", "h", F.lit(len(levels)).alias("level")))
        most = -(-most // fanout)
    all_roots = roots[0]
    for r in roots[1:]:
        all_roots = all_roots.unionByName(r)
    return levels, all_roots


def descend(levels: list[DataFrame], top: DataFrame, leaves: DataFrame, payload: list[str]) -> DataFrame:
    """``top`` (grp, level, path and more) -> a row for each leaf: payload, h, and ``path`` from the leaf up, each step the hashes left and right of the node."""
    more = [c for c in top.columns if c not in ("grp", "level", "path")]
    here = lambda k: top.where(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("j"), "path", *more)
    above = here(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        kid = levels[k].join(above, ["grp", "j"]).select("grp", "kids", "path", *more, F.explode("kids").alias("kid"))
        side = lambda keep: F.array_join(F.transform(F.filter("kids", keep), lambda x: x["h"]), "")
        step = F.struct(side(lambda x: x["i"] < F.col("kid.i")).alias("left"), side(lambda x: x["i"] > F.col("kid.i")).alias("right"))
        extra = ["h", *payload] if k == 0 else []
        above = kid.select("grp", F.col("kid.i").alias("j"), *[F.col(f"kid.{c}").alias(c) for c in extra], F.concat(F.array(step), "path").alias("path"), *more)
        if k:
            above = above.unionByName(here(k))
    alone = leaves.where("n = 1").select("grp", "h", *payload).join(top.where("level = 0").select("grp", "path", *more), "grp")
    columns = ["h", *payload, "path", *more]
    return above.select(columns).unionByName(alone.select(columns)) if levels else alone.select(columns)


def no_path() -> Column:
    return F.array().cast("array<struct<left: string, right: string>>")


def manifest(docs: DataFrame, tampered: Callable[[Column, Column], Column] | None = None, fanout: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (steps from the leaf up), proof_sha256, folded_root and verified of each row.

    ``tampered`` (doc_id, text) -> the text as it is when rows are verified; by default unchanged.
    """
    fields = {c: docs[c] for c in FIELDS}
    now = fields | {"text": tampered(docs["doc_id"], docs["text"])} if tampered else fields
    leaf = docs.select(of_source(docs["source"]).alias("grp"), docs["doc_id"].cast("long").alias("doc_id"), row_hash(fields).alias("h"), row_hash(now).alias("now"))
    leaf = graph.left_over(leaf)
    leaves = graph.left_over(numbered(leaf, ["doc_id", "h"]))
    own = ["doc_id", "now"]
    levels, roots = build(leaves, own, fanout)
    roots = graph.left_over(roots)
    sources = graph.left_over(numbered(roots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "h", "level"), ["source"]))
    tops, root = build(sources, ["source", "level"], fanout)
    found = root.first()
    start = root.select("grp", "level", no_path().alias("path"))
    top = descend(tops, start, sources, ["source", "level"]).select(F.col("source").alias("grp"), "level", "path", F.col("h").alias("subroot"))
    out = descend(levels, graph.left_over(top), leaves, own).withColumn("root", F.lit(found["h"] if found else None).cast("string"))
    fold = F.aggregate("path", F.col("now"), lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), F.sha2(siblings, 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_ends(doc_id: Column, text: Column) -> Column:
    """Texts of which the checksum of the id is even lose their line ends."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
