"""Where files are kept that driver and executors both reach, and how tasks open paths."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import TYPE_CHECKING
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from pyarrow.fs import FileSystem


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder and any other
    master one in the SQL warehouse, which is shared.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return "file://" + tempfile.mkdtemp(prefix="gridwright-")
    base = shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system of a path as Spark writes it, and the name there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(unquote(re.sub("^file:/+", "/", path)) if path.startswith("file:") else path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a new folder: what several later steps read is computed once, and a lost executor costs a read."""
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
