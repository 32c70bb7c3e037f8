"""Merkle manifest of a table: a leaf for each row, a subtree for each language, one root, and a proof for each row.

Every level is a window: nodes are partitioned by group and the index of their
parent, and an ordered collect_list over the full frame gives the run that is the
parent's preimage and, without the node itself, the node's siblings. Of a run one
row stays, as the parent on the next level. Groups of any size are cut into blocks
of FAN ** DEPTH nodes that lie side by side; a block is dealt to a task once for all
of its levels, and the roots of blocks are the nodes of the next round. A block
holds the siblings of its own levels only, so its row has a bounded size.

Defined results: null fields are the letter ``-`` in a leaf; rows that repeat an id
are leaves of their own in the order of their digests, rows without an id come
first; a null language is a group of its own, first in order; a null n_chars isn't
changed by tampering, nor is a row without an id; a single leaf is its own subroot,
a single subroot the root; a row without siblings has the digest of nothing as its
proof; an empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FAN, DEPTH = 2, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a side that is broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_PATH = "array<struct<left:binary,right:binary>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return digest(F.concat(*[encoded(fields[name]) for name in FIELDS]))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, grp (the language as a key that isn't null), leaf and start, the leaf after tampering, of each row.

    Tampering adds 1 to n_chars where 7 divides the checksum of the id.
    """
    fields = {name: F.col(name) for name in FIELDS}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    grp = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))  # keeps the order
    start = F.when(hit, leaf_digest(fields | {"n_chars": F.col("n_chars") + 1}))
    return docs.select("doc_id", grp.alias("grp"), F.unhex(leaf_digest(fields)).alias("leaf"), F.unhex(start).alias("start"))


def beside(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """An inner join; the other side, a written table, is broadcast if it has at most BROADCAST_ROWS rows."""
    return df.join(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other, on)


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds idx, the place of each row of a written table from 0 within ``by``, and n, the rows of its group.

    Rows are dealt by ranges of (by, order) and sorted there; a partition's first
    place follows from the counts of the partitions before it. So a group spans as
    many tasks as it needs, and windows see one row per partition and group. The
    last of ``order`` must tell all rows apart, or equal rows meet in one task.
    """
    placed = materialize(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    parts = placed.groupBy(by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(parts.select(by, "_part", "_first", before.alias("_before"), F.sum("_rows").over(group).alias("n")), "starts")
    found = beside(placed.withColumn("_part", part), starts, [by, "_part"])
    return found.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parents(nodes: DataFrame, fan: int) -> DataFrame:
    """The next level of blocks (grp, blk, at, n, digest, members); n is how many nodes the group has on this level."""
    run = Window.partitionBy("grp", "blk", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = nodes.withColumn("parent", F.floor(F.col("at") / fan)).withColumn("run", F.collect_list(F.struct("digest", "members")).over(run))
    once = listed.where(F.col("at") % fan == 0).withColumn("digests", F.col("run.digest"))
    sibling = lambda i: F.struct(F.unhex(_joined(F.slice("digests", 1, i))).alias("left"), F.unhex(_joined(F.slice("digests", i + 2, fan))).alias("right"))
    longer = lambda x, i: F.transform(x["members"], lambda m: F.struct(m["item"].alias("item"), F.concat(m["path"], F.array(sibling(i))).alias("path")))
    more = F.col("n") > 1  # a group with one node is done
    return once.select(
        "grp", "blk", F.col("parent").alias("at"), F.ceil(F.col("n") / fan).alias("n"),
        F.when(more, digest(_joined(F.col("digests")))).otherwise(F.col("digests")[0]).alias("digest"),
        F.when(more, F.flatten(F.transform("run", longer))).otherwise(F.col("run")[0]["members"]).alias("members"),
    )


def climb(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(grp, item, path, top) of nodes (grp, idx, n, digest, item): each node's siblings level by level, and its group's root.

    A level of the path has what stands left and right of the node in its run. The
    groups' roots are collected by rounds of ``depth`` levels; each is a written table.
    """
    block = fan**depth
    start = F.array(F.struct("item", F.array().cast(_PATH).alias("path")))
    level = nodes.select("grp", F.floor(F.col("idx") / block).alias("blk"), (F.col("idx") % block).alias("at"), "n", "digest", start.alias("members")).repartition("grp", "blk")
    for _ in range(depth):
        level = _parents(level, fan)
    blocks = materialize(level.drop("at"), "blocks")
    if blocks.where("n > 1").isEmpty():
        tops = blocks.select("grp", F.lit(None).cast(_PATH).alias("above"), F.col("digest").alias("top"), F.explode("members").alias("m"))
    else:
        up = climb(blocks.select("grp", F.col("blk").alias("idx"), "n", "digest", F.struct("blk").alias("item")), fan, depth)
        up = materialize(up.select("grp", "item.blk", F.col("path").alias("above"), "top"), "above")
        tops = beside(blocks.select("grp", "blk", "members"), up, ["grp", "blk"]).select("grp", "above", "top", F.explode("members").alias("m"))
    path = F.concat("m.path", F.coalesce("above", F.array().cast(_PATH)))
    return tops.select("grp", "m.item", path.alias("path"), "top")


def _text(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def proof_digest(path: Column) -> Column:
    return digest(_joined(F.transform(path, lambda x: F.concat(_text(x["left"]), _text(x["right"])))))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda acc, x: digest(F.concat(_text(x["left"]), acc, _text(x["right"]))))


def manifest(docs: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """doc_id, lang, leaf, start, subroot, root and path (siblings from the leaf to the root) of each row.

    Texts are read and hashed once; what is sorted and climbed are digests.
    """
    made = materialize(leaves(docs).withColumn("_row", F.monotonically_increasing_id()), "leaves")
    order = numbered(made, "grp", ["doc_id", "leaf", "_row"])
    item = F.struct("doc_id", "leaf", "start")
    trees = climb(order.select("grp", "idx", "n", _text(F.col("leaf")).alias("digest"), item.alias("item")), fan, depth)
    roots = materialize(trees.groupBy("grp").agg(F.first("top").alias("digest")), "subroots")
    ranked = numbered(roots.select(F.lit("").alias("all"), "grp", "digest"), "all", ["grp"])
    crown = climb(ranked.select(F.col("all").alias("grp"), "idx", "n", "digest", F.struct("grp", "digest").alias("item")), fan, depth)
    crown = materialize(crown.select("item.grp", F.col("item.digest").alias("subroot"), F.col("path").alias("crown"), F.col("top").alias("root")), "crown")
    found = beside(trees, crown, ["grp"])
    lang = F.when(F.col("grp") != "-", F.substring("grp", F.lit(2), F.length("grp")))
    return found.select("item.doc_id", lang.alias("lang"), "item.leaf", "item.start", "subroot", "root", F.concat("path", "crown").alias("path"))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: does each row, some of them tampered with, lead to the root?"""
    leaf = _text(F.col("leaf"))
    made = manifest(docs).select("doc_id", leaf.alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce(_text(F.col("start")), leaf), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))
