"""Stored settings: prompts and lengths by data set or model, as small tables that are joined to the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of settings has at most so many rows; a larger one is not settings.
MOST = 100_000


def read_settings(spark: SparkSession, path: str, value: str, kind: str = "string", name: str = "name") -> DataFrame:
    """(name, value) of a JSON file that maps names to values."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias(name, value))


def with_settings(rows: DataFrame, settings: DataFrame, on: str, name: str = "name", default: dict | None = None) -> DataFrame:
    """Rows with the settings of their ``on``, which are counted and sent to them.

    Names are unique. A row whose name has no settings fails, unless ``default``
    gives values.
    """
    n, names = settings.agg(F.count(F.lit(1)), F.count_distinct(name)).first()
    if n > MOST or n != names:
        raise ValueError("settings are few, with one row for each name")
    joined = rows.join(F.broadcast(settings.withColumnRenamed(name, "_name")), F.col(on) == F.col("_name"), "left")
    if default is None:
        joined = joined.where(F.assert_true(F.col("_name").isNotNull(), F.concat(F.lit("no settings for "), F.coalesce(F.col(on).cast("string"), F.lit("null")))).isNull())
    else:
        joined = joined.withColumns({k: F.when(F.col("_name").isNull(), F.lit(v)).otherwise(F.col(k)) for k, v in default.items()})
    return joined.drop("_name")
