"""Aggregates kept per file, so that a dataset's totals follow added, changed and dropped files without reading
the others again.

A file is known by path, length and time of change. Its partial aggregate is computed once and committed
(`CommitLog`); a total merges the partials of the files that the folder holds now. Two uses: the
dataset manifest (digest and size) and the moments of an embedding table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import drift
from vigil.sources.commits import CommitLog
from vigil.sources.io import row_digest

FILE = [T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified", T.TimestampType())]
IDENTITY = [f.name for f in FILE]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the Parquet files below ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(_plain(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))


def _plain(path):
    """One spelling of local paths: Spark says file:/x in one place and file:///x in another."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def file_of(path, folder: str):
    """The file that a path listed below ``folder`` belongs to: itself, or the folder ``*.parquet`` whose part
    file it is. (A table that many tasks write is a folder of part files; known, and read, part by part.)"""
    root = "/" + folder.split(":", 1)[-1].strip("/")
    above = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(above.endswith(".parquet") & ~above.endswith(root), above).otherwise(F.col(path))


class FileParts:
    """Partial aggregates of the files of folders: ``compute`` takes rows with a column ``path`` and returns
    partial rows that keep it, in the columns of ``fields``."""

    def __init__(self, log: CommitLog, table: str, fields: list[T.StructField], compute: Callable[[DataFrame], DataFrame]):
        self.log, self.table, self.compute = log, table, compute
        self.files = f"{table}_files"
        log.schemas |= {table: T.StructType([*FILE, *fields]), self.files: T.StructType(FILE)}

    def update(self, folder: str) -> int:
        """Read the files that have no partials yet; how many there were. One commit."""
        spark = self.log.spark
        unknown = listed(spark, folder).join(self.log.read(self.files), IDENTITY, "left_anti")
        new = unknown.collect()  # names of new files, as Spark's own file index holds them
        if not new:
            return 0
        names = spark.createDataFrame(new, T.StructType(FILE))
        rows = spark.read.parquet(*[r.path for r in new]).withColumn("path", _plain(F.input_file_name()))
        parts = self.compute(rows).join(names, "path")
        key = f"{self.table}:{self.log.version()}:{min(r.path for r in new)}"
        self.log.put(key, append={self.table: parts, self.files: names})
        return len(new)

    def current(self, folder: str) -> DataFrame:
        """The partials of the files that are there now."""
        return self.log.read(self.table).join(listed(self.log.spark, folder), IDENTITY, "left_semi")


# ---- manifest -----------------------------------------------------------------------------------

DIGESTS = [
    T.StructField("n_rows", T.LongType()), T.StructField("total_chars", T.LongType()),
    T.StructField("digest_sum", T.DecimalType(38, 0)), T.StructField("digest_xor", T.LongType()),
]


class Manifest(FileParts):
    """One row about a dataset: where it comes from, its name and target, and an order-insensitive digest and
    size, from one pass over each file."""

    def __init__(self, log: CommitLog, cols: list[str], text_col: str | None = None, table: str = "manifest_parts"):
        def digests(rows: DataFrame) -> DataFrame:
            digest = row_digest(cols)
            return rows.groupBy("path").agg(
                F.count(F.lit(1)).alias("n_rows"), F.sum(F.length(text_col or cols[0])).cast("long").alias("total_chars"),
                F.sum(digest).alias("digest_sum"), F.bit_xor(F.xxhash64(*cols)).alias("digest_xor"),
            )

        super().__init__(log, table, DIGESTS, digests)

    def row(self, folder: str, name: str, target: str) -> DataFrame:
        """source, name, target, n_files, bytes, n_rows, total_chars, digest_sum, digest_xor."""
        self.update(folder)
        size = listed(self.log.spark, folder).agg(F.count_distinct(file_of("path", folder)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        sums = self.current(folder).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in (("n_rows", "long"), ("total_chars", "long"), ("digest_sum", "decimal(38,0)"))],
            F.coalesce(F.bit_xor("digest_xor"), F.lit(0)).alias("digest_xor"),
        )
        named = [F.lit(v).alias(c) for c, v in (("source", folder), ("name", name), ("target", target))]
        return size.crossJoin(sums).select(*named, *size.columns, *sums.columns)  # one row each


# ---- moments --------------------------------------------------------------------------------------


class Moments(FileParts):
    """Count, mean and squared deviation of each dimension of an embedding table, file by file. ``embed`` turns the
    rows of new files into (path, ``grp``, embedding); merged, they equal `drift.dimension_moments` of all rows."""

    def __init__(self, log: CommitLog, embed: Callable[[DataFrame], DataFrame], table: str = "moment_parts"):
        fields = [T.StructField("grp", T.StringType()), *drift.PART_FIELDS]
        super().__init__(log, table, fields, lambda rows: drift.moment_parts(embed(rows), ["path", "grp"]))

    def merged(self, folder: str) -> DataFrame:
        """(grp, pos, mean, std, n) over the files that are there now; only new files are read."""
        self.update(folder)
        return drift.merged_moments(self.current(folder))
