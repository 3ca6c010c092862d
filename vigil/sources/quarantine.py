"""Rows that cannot be taken as they are go to a table of rejects, with the reason and the raw row.

A reader judges: every row of the input comes back once, as its typed columns, a ``reason`` (null where the row is
good) and the ``raw`` input. Then either the first bad row stops the job (`strict`, the default of the readers in
`vigil.sources.io`), or `divided` writes both kinds in one pass and counts them while they pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REASON, RAW, _CORRUPT = "reason", "raw", "__corrupt"
# An unquoted empty field is missing, a quoted one is an empty text: the reader may take
# neither for the other, so missing fields are marked by a character that no text has.
MISSING = "\u0000"


def csv_options(reader):
    return (
        reader.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("nullValue", MISSING)
    )


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV text by the header's names, all strings, and ``__corrupt``: the record, where its fields
    do not fit the header. Files of one folder must agree in their header."""
    names = csv_options(spark.read).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _CORRUPT]])
    reader = csv_options(spark.read).option("columnNameOfCorruptRecord", _CORRUPT).option("enforceSchema", False)
    return reader.option("columnPruning", False).schema(schema).csv(path)


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The text of the first check that holds, else null."""
    return F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])


def judged_csv(spark: SparkSession, path: str, columns: dict[str, tuple[str, T.DataType, Column | None]]) -> DataFrame:
    """CSV rows with typed columns: ``columns`` maps an output name to (header name, type, expression or None
    for a cast). A header without a name gives nulls. A field that is there and does not parse is a reason."""
    rows = csv_rows(spark, path)
    raw = F.coalesce(F.col(_CORRUPT), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != _CORRUPT])))
    out, checks = [], [(F.col(_CORRUPT).isNotNull(), "fields do not fit the header")]
    for name, (header, kind, expression) in columns.items():
        if header not in rows.columns:
            out.append(F.lit(None).cast(kind).alias(name))
            continue
        field = F.col(f"`{header}`")
        value = field.try_cast(kind) if expression is None else expression.try_cast(kind)
        out.append(value.alias(name))
        checks.append((field.isNotNull() & value.isNull(), f"{header} does not parse"))
    return rows.select(*out, first_reason(*checks).alias(REASON), raw.alias(RAW))


def judged_json(df: DataFrame, json_col: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """Items of JSON arrays (a single object is an array of one). Text that is no such array is one bad row,
    an item that lacks a required field another; a null text and an empty array have no rows."""
    text = F.trim(F.col(json_col))
    array = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    keep = [c for c in df.columns if c != json_col]
    item = T.ArrayType(T.StringType())  # items as JSON text first, so that each keeps its raw form
    parsed = df.filter(text.isNotNull()).select(
        *keep, F.col(json_col).alias("__text"), F.from_json(array, item, {"mode": "PERMISSIVE"}).alias("__raw"),
        F.from_json(array, schema).alias("__items"),
    )
    # what cannot be read as an array of objects at all
    broken = F.col("__items").isNull() | F.exists("__items", lambda x: x.isNull())
    items = F.when(broken, F.array(F.lit(None).cast(_element(df.sparkSession, schema)))).otherwise(F.col("__items"))
    rows = parsed.select(*keep, "__text", "__raw", F.posexplode(items).alias("__at", "__item"))
    checks = [(F.col("__item").isNull(), "not a JSON array of objects")]
    checks += [(F.col(f"__item.{r}").isNull(), f"{r} is missing") for r in required]
    raw = F.when(F.col("__item").isNull(), F.col("__text")).otherwise(F.coalesce(F.get("__raw", F.col("__at")), F.col("__text")))
    return rows.select(*keep, "__item.*", first_reason(*checks).alias(REASON), raw.alias(RAW))


def _element(spark: SparkSession, schema: str) -> T.DataType:
    return T.StructType.fromDDL(f"x {schema}")["x"].dataType.elementType


def strict(judged: DataFrame) -> DataFrame:
    """The rows, if all are good; reading a bad one is an error that names its reason."""
    bad = F.raise_error(F.concat(F.lit("bad row: "), F.col(REASON), F.lit(": "), F.substring(RAW, 1, 200))).cast("boolean")
    return judged.filter(F.when(F.col(REASON).isNull(), True).otherwise(bad)).drop(REASON, RAW)


@dataclass
class Divided:
    """What `divided` wrote, and its counts."""

    good: DataFrame
    rejects: DataFrame
    n_in: int
    n_good: int
    n_rejects: int


def divided(judged: DataFrame, path: str) -> Divided:
    """Write good rows and rejects below ``path`` in one pass. The counts are observed on the rows as they are
    written; every row in is one of both."""
    seen = Observation()
    good = F.col(REASON).isNull()
    counted = judged.observe(seen, F.count(F.lit(1)).alias("n_in"), F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_rejects"))
    counted.withColumn("good", good).write.partitionBy("good").parquet(path)
    schema = T.StructType([*judged.schema.fields, T.StructField("good", T.BooleanType())])
    rows = judged.sparkSession.read.schema(schema).parquet(path)
    counts = seen.get
    return Divided(
        rows.filter("good").drop("good", REASON, RAW), rows.filter("NOT good").drop("good"),
        counts["n_in"], counts["n_good"], counts["n_rejects"],
    )
