"""Helpers shared by the corpus operators: reading tables, scratch tables, columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls from tab to carriage return.
WHITE = "[\\x20\\x09-\\x0D]+"
CACHED_WORDS = 100_000
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_local_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder of its own and
    any other master the SQL warehouse, which is shared.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        app = spark.sparkContext.applicationId
        if app not in _local_scratch:
            _local_scratch[app] = "file://" + tempfile.mkdtemp(prefix="gridwright-")
        return _local_scratch[app]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


_open: list[list[str]] = []  # the tables that each settled() in progress has written so far


def _write(df: DataFrame, name: str) -> str:
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and what several later branches read is computed once. Within ``settled`` the
    table goes when the result that it is for is written.
    """
    path = _write(df, name)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written as by materialize; the tables that were written for it are deleted then."""
    with tables_deleted(spark):
        df = build()
        path = _write(df, name)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized in this block are deleted at its end."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def keep_winners(docs: DataFrame, rows: DataFrame, with_digest: Callable[[DataFrame], DataFrame], id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that win, each once, with all their columns.

    ``rows`` is a written table of (doc_id, digest, n, wins) for every distinct pair of id and digest, n
    being how often it occurs. Rows that lose are taken out by their ids, which alone
    are sent to the texts if there are not too many. Only rows without an id, or with
    one that occurs again, are told apart by digest: ``with_digest`` adds _gw_digest.
    """
    again = materialize(rows.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_gw_id")), "again")
    out = rows.where("not wins and doc_id is not null").select(F.col("doc_id").alias("_gw_id")).unionByName(again.where("_gw_id is not null")).distinct()
    out = materialize(out, "losers")
    key = docs[id_col].cast("bigint")
    once = docs.where(key.isNotNull()).join(F.broadcast(out) if out.count() <= BROADCAST_IDS else out, key == out["_gw_id"], "left_anti")
    if again.isEmpty():
        return once
    winners = rows.where("wins").select(F.col("doc_id").alias("_gw_id"), F.col("digest").alias("_gw_winner"))
    some = with_digest(docs.join(again, key.eqNullSafe(again["_gw_id"]), "left_semi"))
    won = some.join(winners, some[id_col].cast("bigint").eqNullSafe(winners["_gw_id"]) & (some["_gw_digest"] == winners["_gw_winner"]))
    return once.unionByName(won.dropDuplicates(["_gw_id", "_gw_digest"]).select(*docs.columns))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def arrow_strings(column) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty string."""
    return [x or "" for x in column.to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, kept for the words of late; one table for each Python worker, whatever it runs."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


word_hash = WordHashes()


def give_back() -> None:
    """Returns memory that earlier tasks of this Python worker have freed, but that its allocators still hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` at most, so a task holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
