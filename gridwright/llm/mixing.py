"""Mixing sources to target weights.

Words are summed per source, each source's repetition rate is its target over
its words, and a document is emitted floor(rate) times, plus once more when a
draw from its hash falls below the rate's fraction. The draw of a document is
the same on every run. Of a fixed family of seeds, each source uses the one whose
draws bring its words closest to its target; one aggregation tries them all.

Defined results: a null text has no words; documents without a source form a
source of their own, last in order; a source without words gets target 0 and
keeps none of its documents; a document with a null id is drawn by its text; repeated
rows share their id's draw and are emitted alike; an empty table gives an empty
result. Columns other than id, text and source are passed through by emit_mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

WORD = "[^\\x20\\x09-\\x0D]+"
SEEDS = 64
MAX_REPEATS = 3
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Targets share all words by weight and stop at ``cap`` times a source's words;
    what is above is shared again by weight. With sources in order of cap over
    weight, the first k are capped, k being the first number for which no other
    source is above its cap. The windows see one row per source.
    """
    ranked = sizes.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("place"))
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighted = ranked.select("source", "source_size", "place", weight.alias("w"), (F.lit(cap) * F.col("source_size")).alias("most")).withColumn("r", F.col("most") / F.col("w"))
    order = Window.orderBy("r", "place")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # capped: the caps of all rows before; free: the weights of this row and all after
    level = weighted.select("*", F.sum("source_size").over(Window.partitionBy()).alias("total"), F.coalesce(F.sum("most").over(before), F.lit(0)).alias("capped"), F.sum("w").over(rest).alias("free"))
    fits = level.withColumn("fits", (F.col("total") - F.col("capped")) * F.col("w") <= F.col("most") * F.col("free"))
    first = fits.withColumn("at", F.min(F.when(F.col("fits"), F.struct("r", "place", "capped", "free"))).over(Window.partitionBy()))
    share = F.col("w") * (F.col("total") - F.col("at.capped")) / F.col("at.free")
    below = F.struct("r", "place") < F.struct(F.col("at.r").alias("r"), F.col("at.place").alias("place"))
    return first.select("source", "source_size", F.when(below, F.col("most").cast("double")).otherwise(share).alias("target"))


def _hash(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 8), 16, 10).cast("bigint")


def with_draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds _gw_h1 and _gw_h2, two hashes of the id, or of the text where there is none, from which every seed's draw follows."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), text_or_empty(text_col)))
    return docs.withColumns({"_gw_h1": _hash(key, 1), "_gw_h2": _hash(key, 9)})


def draw(seed: Column) -> Column:
    """The number from 0 to 1 that a seed gives to a row of with_draws."""
    return (F.col("_gw_h1") + seed * F.col("_gw_h2")) % F.lit(1 << 32) / F.lit(float(1 << 32))


def copies() -> Column:
    """How often a row of with_draws is emitted under its source's rate."""
    return (F.col("_gw_whole") + (draw(F.col("_gw_seed")) < F.col("_gw_part")).cast("bigint")).alias("copies")


def join_rates(df: DataFrame, rates: DataFrame, source_col: str = "source") -> DataFrame:
    """``df`` with its source's rate. The rates are broadcast up to BROADCAST_SOURCES rows and shuffled beyond."""
    small = rates.select(F.col("source").alias("_gw_source"), *[F.col(c).alias(f"_gw_{c}") for c in rates.columns if c != "source"])
    if rates.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    return df.join(small, df[source_col].eqNullSafe(small["_gw_source"]))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and the two hashes of each row, kept in the scratch folder."""
    drawn = with_draws(docs, id_col, text_col)
    return materialize(drawn.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint").alias("size"), "_gw_h1", "_gw_h2"), "sizes")


def source_rates(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, whole, part, seed): a row for each source of sized_documents."""
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = materialize(targets.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate)), "rates")
    drawn = [F.sum(F.when(draw(F.lit(k)) < F.col("_gw_part"), F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)]
    sums = join_rates(sized, rates).groupBy("source").agg(F.max(F.col("_gw_part") * F.col("_gw_source_size")).alias("want"), *drawn)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("want")).alias("off"), F.lit(k).cast("bigint").alias("seed")) for k in range(SEEDS)]))
    seeds = sums.select(F.col("source").alias("_gw_source"), best["seed"].alias("seed"))
    return materialize(rates.join(seeds, rates["source"].eqNullSafe(seeds["_gw_source"])).drop("_gw_source"), "seeds")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """doc_id, size, source, source_size, target, copies for each row of ``docs``."""
    sized = sized_documents(docs)
    planned = join_rates(sized, source_rates(sized, weights, cap))
    return planned.select("doc_id", "size", "source", F.col("_gw_source_size").alias("source_size"), F.col("_gw_target").alias("target"), copies())


def emit_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """The mix: each document as often as its source's rate and its draw say, with all its columns.

    Copies follow from a document's id and its source's rate and seed, so the
    texts stay where they are and only the rates, a row for each source, meet them.
    """
    rates = source_rates(sized_documents(docs), weights, cap)
    counted = join_rates(with_draws(docs), rates).withColumn("_gw_copies", copies())
    every = counted.where("_gw_copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "_gw_copies")).alias("_gw_copy"))
    return every.select(*docs.columns)
