"""JSON Lines with a strict schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InvalidRecord(ValueError):
    """A line that doesn't fit its schema."""


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows; blank lines are skipped; a malformed line makes the query fail.

    Absent required fields fail as well; other fields are ignored, as Spark reads by name.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", _nullable(schema), {"mode": "FAILFAST"}).alias("r")).select("r.*")
    for field in schema.fields:
        if not field.nullable:
            parsed = parsed.withColumn(field.name, F.coalesce(F.col(field.name), F.raise_error(F.lit(f"a record lacks {field.name}")).cast(field.dataType)))
    return parsed


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def first_invalid(spark: SparkSession, path: str, schema: T.StructType) -> tuple[int, str] | None:
    """Number and text of the first line of a file that doesn't parse, for error messages; None if all do."""
    bad = T.StructField("_bad", T.StringType())
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).filter(F.trim("line") != "")
    typed = lines.select(
        "n", "line",
        F.from_json("line", T.StructType([*_nullable(schema).fields, bad]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"),
    )
    missing = F.lit(False)
    for field in schema.fields:
        if not field.nullable:
            missing = missing | F.col(f"r.{field.name}").isNull()
    row = typed.filter(F.col("r._bad").isNotNull() | missing).orderBy("n").first()
    return (row["n"] + 1, row["line"]) if row else None


def write(rows: DataFrame, path: str) -> int:
    """Write a folder of JSON Lines and tell the number of rows; null fields are written as such."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return count(rows.sparkSession, path)


def count(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return spark.read.text(path).filter(F.trim("value") != "").count()
