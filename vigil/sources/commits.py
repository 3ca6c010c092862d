"""Several tables that change together: readers see whole commits or nothing.

Every write goes to a folder of its own (``data/<table>/commit=<id>``). A commit is then one small file in
``commits/``, written last and in one piece, that names the folders and carries a caller's key. Folders
that no commit names (a job died before it) are never read, and a key that was committed is not committed again,
so a job can be replayed from its start at any time. A table is the union of the folders committed
since its last replacement.

Reading is a semi join of the table's folders with the log, so nothing about past commits is held on the driver.
One writer at a time may commit below a root; readers need no coordination.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.sources.io import conformed

LOG = "version long, key string, table string, commit string, action string"
APPEND, REPLACE = "append", "replace"


@dataclass
class Staged:
    """A written folder that a commit may name."""

    table: str
    commit: str
    action: str


class CommitLog:
    """Tables of fixed schemas below ``root``, a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def _folder(self, table: str) -> str:
        return f"{self.root}/data/{table}"

    def log(self) -> DataFrame:
        """All commits: version, key, table, commit, action."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)  # nothing was committed yet

    def has(self, key: str) -> bool:
        return not self.log().filter(F.col("key") == key).isEmpty()

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return self.log().agg(F.max("version")).first()[0] or 0  # one row

    def stage(self, table: str, df: DataFrame, action: str = APPEND) -> Staged:
        """Write rows, by column name, where only a commit makes them part of ``table``."""
        staged = Staged(table, f"c{uuid.uuid4().hex}", action)
        conformed(df, self.schemas[table]).write.parquet(f"{self._folder(table)}/commit={staged.commit}")
        return staged

    def staged_rows(self, staged: Staged) -> DataFrame:
        return self.spark.read.schema(self.schemas[staged.table]).parquet(f"{self._folder(staged.table)}/commit={staged.commit}")

    def commit(self, key: str, staged: list[Staged]) -> bool:
        """Make staged rows visible, all or none; False if ``key`` was committed before."""
        if self.has(key):
            return False
        number = self.version() + 1
        rows = [(number, key, s.table, s.commit, s.action) for s in staged]
        entry = self.spark.createDataFrame(rows, LOG).coalesce(1)  # one file: it appears whole
        entry.drop("version").write.mode("error").parquet(f"{self.root}/commits/version={number}")
        return True

    def put(self, key: str, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> bool:
        """Stage and commit in one go; a committed key writes nothing."""
        if self.has(key):
            return False
        staged = [self.stage(t, df, APPEND) for t, df in (append or {}).items()]
        staged += [self.stage(t, df, REPLACE) for t, df in (replace or {}).items()]
        return self.commit(key, staged)

    def read(self, table: str) -> DataFrame:
        """The committed rows of ``table``; none before its first commit."""
        schema = self.schemas[table]
        entries = self.log().filter(F.col("table") == table)
        since = entries.filter(F.col("action") == REPLACE).agg(F.max("version").alias("since"))  # one row
        live = entries.crossJoin(F.broadcast(since)).filter(F.col("since").isNull() | (F.col("version") >= F.col("since")))
        try:
            rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("commit", T.StringType())])).parquet(self._folder(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return rows.join(live.select("commit"), "commit", "left_semi").select(schema.names)
