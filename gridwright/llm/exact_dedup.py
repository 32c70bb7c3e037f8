"""Exact deduplication against a minimal perfect hash over historical digests.

Texts are equal when they are identical after every run of white space became
one space. Their SHA-256 digests are kept apart in shards by leading bits; a
shard of the history holds a minimal perfect hash whose slots carry the full
digest, the winner's id and the number of rows. A lookup maps any digest to a
slot and compares all 32 bytes there, so a digest that is not in the history
never passes for one that is. Digests outside the history are grouped among
themselves.

Defined results: a null text counts as empty, so null and blank texts of one
form are equal; a null id loses against any other id and is kept only in a group
that has no id at all; of rows that repeat both id and text one is kept; an
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, keep_winners, materialize, settled, text_or_empty

DIGESTS_PER_SHARD = 16384
_BITS = "levels array<binary>, widths array<bigint>, slots binary, winners binary, counts binary"


def _positions(digests: np.ndarray, level: int, width: int) -> np.ndarray:
    """Where each digest (rows of four uint64) falls in the bit array of a level."""
    with np.errstate(over="ignore"):
        x = digests[:, level % 4] + digests[:, (level + 1) % 4] * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(width)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A minimal perfect hash of distinct digests: bit arrays, and each digest's slot.

    On every level the digests that meet no other one set their bit and the rest
    go on to the next level. The slot is the number of bits set before.
    """
    rest, levels, slot, before = np.arange(len(digests)), [], np.zeros(len(digests), np.int64), 0
    while len(rest):
        width = max(64, 2 * len(rest))
        at = _positions(digests[rest], len(levels), width)
        alone = np.bincount(at, minlength=width) == 1
        rank = before + np.cumsum(alone) - 1
        own = alone[at]
        slot[rest[own]] = rank[at[own]]
        levels.append(alone)
        before += int(alone.sum())
        rest = rest[~own]
    return levels, slot


def find_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot of each digest, or -1 where no level has its bit."""
    slot, rest, before = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, bits in enumerate(levels):
        at = _positions(digests[rest], level, len(bits))
        own = bits[at]
        slot[rest[own]] = (before + np.cumsum(bits) - 1)[at[own]]
        rest, before = rest[~own], before + int(bits.sum())
    return slot


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def _build(t: pa.Table) -> pa.Table:
    digests = _words(t["digest"])
    levels, slot = build_hash(digests)
    order = np.argsort(slot)
    return pa.table({
        "shard": t["shard"].slice(0, 1),
        "levels": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
        "widths": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())),
        "slots": [digests[order].tobytes()],
        "winners": [t["keep_id"].to_numpy()[order].astype("<i8").tobytes()],
        "counts": [t["n"].to_numpy()[order].astype("<i8").tobytes()],
    })


def _lookup(batch: pa.Table, index: pa.Table) -> pa.Table:
    n = len(batch)
    member, winner, count = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n and len(index):
        row = index.to_pylist()[0]
        levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=w).astype(bool) for b, w in zip(row["levels"], row["widths"])]
        digests, slots = _words(batch["digest"]), np.frombuffer(row["slots"], "<u8").reshape(-1, 4)
        slot = find_slots(levels, digests)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[(slots[slot[hit]] == digests[hit]).all(axis=1)]  # every byte of the digest
        member[hit] = True
        winner[hit] = np.frombuffer(row["winners"], "<i8")[slot[hit]]
        count[hit] = np.frombuffer(row["counts"], "<i8")[slot[hit]]
    return pa.table({
        "digest": batch["digest"], "keep_id": batch["keep_id"], "n": batch["n"],
        "old_id": pa.array(winner, mask=~member), "old_n": pa.array(count, mask=~member),
    })


def _shard(shards: int):
    return (F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int") % shards).alias("shard")


def text_digest(text: str = "text"):
    """SHA-256 of the text with white space normalised."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), WHITE, " "), 256))


def shards_for(n_distinct: int) -> int:
    return 1 << max(3, math.ceil(math.log2(max(1, n_distinct) / DIGESTS_PER_SHARD)))


def build_index(distinct: DataFrame, n_distinct: int) -> DataFrame:
    """The hash over a history's distinct digests (digest, keep_id, n): a row per shard.

    A shard has about DIGESTS_PER_SHARD digests, whatever ``n_distinct``: the
    distinct digests of the history, or of what is looked up if these are more.
    """
    shards = shards_for(n_distinct)
    index = distinct.select("digest", "keep_id", "n", _shard(shards)).groupBy("shard").applyInArrow(_build, "shard int, " + _BITS)
    return materialize(index.withColumn("shards", F.lit(shards)), "mph")


def look_up(distinct: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Adds old_id and old_n, the history's winner and rows, null for what it lacks."""
    return distinct.select("digest", "keep_id", "n", _shard(shards)).groupBy("shard").cogroup(index.drop("shards").groupBy("shard")).applyInArrow(_lookup, "digest binary, keep_id bigint, n bigint, old_id bigint, old_n bigint")


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has (doc_id, digest, n) for every distinct pair, groups (digest, keep_id, n).

    The older half of the ids is the history, and the rest is looked up in it.
    Counts are combined before each shuffle, so a text that a third of all rows
    share reaches the shuffle as one row of each task.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_digest(text_col).alias("digest"))
    rows = materialize(slim.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests")
    middle = rows.select(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    old = F.coalesce(F.col("doc_id") < F.lit(middle).cast("bigint"), F.lit(False))
    distinct = lambda df: df.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("n"))
    history, batch = materialize(distinct(rows.where(old)), "history"), materialize(distinct(rows.where(~old)), "batch")
    most = max(history.count(), batch.count())
    found = materialize(look_up(batch, build_index(history, most), shards_for(most)), "found")
    members, others = found.where("old_id is not null"), found.where("old_id is null")
    groups = history.unionByName(members.select("digest", F.col("old_id").alias("keep_id"), "n")).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    return rows, groups.unionByName(others.select("digest", "keep_id", "n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""

    def build() -> DataFrame:
        rows, groups = equal_groups(docs, id_col, text_col)
        return rows.join(groups.select("digest", "keep_id", F.col("n").alias("group_size")), "digest")

    joined = settled(docs.sparkSession, "groups", build)
    copies = joined.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    return copies.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one of each group of equal texts."""

    def build() -> DataFrame:
        rows, groups = equal_groups(docs, id_col, text_col)
        return rows.join(groups.select("digest", "keep_id"), "digest").select("doc_id", "digest", "n", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("wins"))

    judged = settled(docs.sparkSession, "judged", build)
    return keep_winners(docs, judged, lambda df: df.withColumn("_gw_digest", text_digest(text_col)), id_col)
