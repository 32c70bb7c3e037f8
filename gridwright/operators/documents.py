"""Documents that patches change, kept in buckets: a delta touches its buckets only, and a lookup reads one.

A store is a Parquet table with a folder for each bucket, which follows from the hash
of the key. Every field is kept with the number of the patch that set it, so patches
may come in any order and again: of each field the value of the highest number stays,
of equal numbers the larger value, and a patch that leaves a field null doesn't touch it.

Defined results: patches without a number count for nothing; all without a key are
of one document; a store without patches, or one that isn't there yet, is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written


@dataclass(frozen=True)
class Store:
    """Where documents are kept: (key type, seq type, types of the fields) and in how many buckets; these never change."""

    path: str
    key: tuple[str, str]
    seq: tuple[str, str]
    fields: dict[str, str]
    buckets: int = 256

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.key[1])), F.lit(self.buckets)).cast("int")

    @property
    def schema(self) -> str:
        kept = ", ".join(f"`{f}` struct<seq:{self.seq[1]},value:{kind}>" for f, kind in self.fields.items())
        return f"`{self.key[0]}` {self.key[1]}, `{self.seq[0]}` {self.seq[1]}, {kept}, bucket int"


def _kept(spark: SparkSession, store: Store) -> DataFrame:
    there = spark._jvm.org.apache.hadoop.fs.Path(store.path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], store.schema)
    return spark.read.schema(store.schema).option("basePath", store.path).parquet(store.path)


def merge(patches: DataFrame, store: Store) -> int:
    """Takes patches (key, seq, fields...) into the store; gives the number of buckets that were written anew.

    Patches are combined before the shuffle, so a document that a third of them are
    for is no task of its own. The new buckets are written aside first, and then take
    the places of the old ones; doing it again after a failure changes nothing more.
    """
    spark, (key, kind), (seq, order) = patches.sparkSession, store.key, store.seq
    number = F.col(seq).cast(order)
    set_at = [F.when(F.col(f).isNotNull(), F.struct(number.alias("seq"), F.col(f).cast(t).alias("value"))).alias(f) for f, t in store.fields.items()]
    delta = patches.where(F.col(seq).isNotNull()).select(F.col(key).cast(kind).alias(key), number.alias(seq), *set_at).withColumn("bucket", store.bucket(F.col(key)))
    last = [F.max(c).alias(c) for c in (seq, *store.fields)]
    delta = written(delta.groupBy(key, "bucket").agg(*last), "delta")
    touched = [r[0] for r in delta.select("bucket").distinct().collect()]  # as many as the store has buckets at most
    if not touched:
        return 0
    old = _kept(spark, store).where(F.col("bucket").isin(touched))
    both = old.unionByName(delta).groupBy(key, "bucket").agg(*last)
    new = written(both.repartition("bucket"), "buckets")
    new.select(key, seq, *store.fields, "bucket").repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(store.path)
    return len(touched)


def documents(spark: SparkSession, store: Store) -> DataFrame:
    """(key, seq, fields...): all documents as they are now."""
    return _kept(spark, store).select(store.key[0], store.seq[0], *[F.col(f"`{f}`.value").alias(f) for f in store.fields])


def lookup(spark: SparkSession, store: Store, key: object) -> DataFrame:
    """One document; its bucket alone is listed and read."""
    own = F.lit(key).cast(store.key[1])
    bucket = spark.range(1).select(store.bucket(own)).first()[0]
    kept = _kept(spark, store).where((F.col("bucket") == bucket) & F.col(store.key[0]).eqNullSafe(own))
    return kept.select(store.key[0], store.seq[0], *[F.col(f"`{f}`.value").alias(f) for f in store.fields])
