"""Where lineage is cut: tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Of a table's rows, by their columns' number, their strings' bytes and their arrays' entries (of a few numbers each).
BROADCAST_BYTES = 32_000_000
#: Of a working table's row groups, which a task that writes one gathers in memory.
ROW_GROUP_BYTES = 16_000_000

#: The folders of each application's results.
_results: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, only a local session gets one, in its warehouse: on a cluster the
    executors might not see it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemill-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, path: str) -> None:
    files, path = _files(spark, path)
    files.delete(path, True)


def close(spark: SparkSession) -> None:
    """Deletes the results that operators have given so far; their DataFrames can't be read any more. Without it they go when the application ends."""
    for folder in _results.pop(spark.sparkContext.applicationId, []):
        _delete(spark, folder)


def sized(df: DataFrame) -> DataFrame:
    """df, a written table or columns of one, marked for broadcast if its rows take at most BROADCAST_BYTES; beyond that Spark joins it by a shuffle, unless it knows better."""
    wide = [F.octet_length(f.name) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))] + [48 * F.size(f.name) for f in df.schema if isinstance(f.dataType, ArrayType)]
    rows, more = df.agg(F.count("*"), sum((F.coalesce(F.sum(w), F.lit(0)) for w in wide), F.lit(0))).first()
    return F.broadcast(df) if rows * (16 + 8 * len(df.columns)) + more <= BROADCAST_BYTES else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it no column's name."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in df.columns}:
            name += "_"
        out.append(name)
    return out


class Scratch:
    """The tables of one call of an operator: those it works with, which go when it ends, and its result, which goes when the application ends.

    with Scratch(spark, "name") as scratch: ... return scratch.result(df)
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.kept = False

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _delete(self.spark, f"{self.folder}/work" if self.kept else self.folder)

    def _table(self, df: DataFrame, path: str) -> DataFrame:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((found, path))
        return found

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """df as a Parquet table, read back without its lineage."""
        return self._table(df, f"{self.folder}/work/{name}-{len(self.tables)}")

    def result(self, df: DataFrame) -> DataFrame:
        """df as a Parquet table that outlives the call."""
        found = self._table(df, f"{self.folder}/result")
        self.kept = True
        # The folder is there by now; of one that isn't, Hadoop would take no note.
        files, path = _files(self.spark, self.folder if self.spark.conf.get("spark.checkpoint.dir", None) else shared_dir(self.spark))
        files.deleteOnExit(path)
        _results.setdefault(self.spark.sparkContext.applicationId, []).append(self.folder)
        return found

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that written gave and nothing will read again."""
        _delete(self.spark, next(path for table, path in self.tables if table is df))
