"""Boxes that meet, found by an equi-join over cells of a grid with many levels.

A box is at home on the level whose cells are at least as large as it is, so it
covers four cells there at most, however large or small it is. Two boxes are looked
up on the higher one of their levels: the larger one in its own cells, the smaller
one in the cells that hold it there. A pair that shares several cells counts in the
cell of one corner of its intersection only. No two boxes are compared that don't
share a cell as large as the larger of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

BOX = ("bx0", "by0", "bx1", "by1")
#: Levels are powers of two of a unit; boxes beyond these sizes are at home on the first or last one.
FIRST_LEVEL, LAST_LEVEL = -20, 40


def with_level(rows: DataFrame) -> DataFrame:
    """Rows with a box of numbers (BOX, with by0 <= by1 and bx0 <= bx1), and the level where it is at home."""
    x0, y0, x1, y1 = map(F.col, BOX)
    extent = F.greatest(x1 - x0, y1 - y0, F.lit(2.0**FIRST_LEVEL))
    level = F.least(F.greatest(F.ceil(F.log2(extent)).cast("int"), F.lit(FIRST_LEVEL)), F.lit(LAST_LEVEL))
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**LAST_LEVEL)
    return rows.where(number(x0) & number(y0) & number(x1) & number(y1)).withColumn("level", level)


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _cells(level: Column, side: int) -> Column:
    """Structs of the cells that the box covers on a level."""
    at = lambda c: F.floor(F.col(c) / _size(level))
    column = lambda x: F.transform(F.sequence(at("by0"), at("by1")), lambda y: F.struct(F.lit(side).alias("side"), level.cast("int").alias("at"), x.alias("cx"), y.alias("cy")))
    return F.flatten(F.transform(F.sequence(at("bx0"), at("bx1")), column))


def _levels_of(rows: DataFrame) -> list[int]:
    """At most LAST_LEVEL - FIRST_LEVEL + 1 numbers."""
    return sorted(r[0] for r in rows.select("level").distinct().collect())


def _spread(rows: DataFrame, own_side: int, levels: list[int], same: bool) -> DataFrame:
    """Rows once for each cell: of their own level for smaller boxes of the other table, of its levels above for larger ones."""
    level = F.col("level")
    smaller = [x for x in levels if x is not None]
    has = lambda test: F.exists(F.array(*map(F.lit, smaller)), test) if smaller else F.lit(False)
    none = F.array().cast("array<struct<side:int,at:int,cx:bigint,cy:bigint>>")
    own = F.when(has((lambda x: x <= level) if same else (lambda x: x < level)), _cells(level, own_side)).otherwise(none)
    above = F.filter(F.array(*map(F.lit, smaller)).cast("array<int>"), (lambda x: x > level) if same else (lambda x: x >= level))
    up = F.flatten(F.transform(above, lambda x: _cells(x, 1 - own_side)))
    return rows.withColumn("_cell", F.explode(F.concat(own, up))).select("*", "_cell.*").drop("_cell")


def meeting(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of rows equal in ``by`` whose boxes meet or touch; other columns of the two sides must have different names.

    Both sides need BOX. They are written once, as their levels are asked for first.
    Cells are shuffled by (by, level, cell), and adaptive execution splits cells with
    many boxes on both sides.
    """
    left, right = written(with_level(left), "left"), written(with_level(right), "right")
    mine, theirs = _levels_of(left), _levels_of(right)
    a = _spread(left, 0, theirs, same=True)
    b = _spread(right, 1, mine, same=False)
    for name in (*BOX, "level"):
        b = b.withColumnRenamed(name, f"_{name}")
    pairs = a.join(b, [*by, "side", "at", "cx", "cy"])
    corner = lambda c: F.floor(F.greatest(F.col(c), F.col(f"_{c}")) / _size(F.col("at")))
    touch = (F.col("bx0") <= F.col("_bx1")) & (F.col("_bx0") <= F.col("bx1")) & (F.col("by0") <= F.col("_by1")) & (F.col("_by0") <= F.col("by1"))
    once = pairs.where(touch & (corner("bx0") == F.col("cx")) & (corner("by0") == F.col("cy")))
    return once.drop("side", "at", "cx", "cy", *BOX, "level", *[f"_{n}" for n in (*BOX, "level")])
