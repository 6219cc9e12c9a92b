"""Tables of names in CSV: read, encode the first column, write."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from lexforge.functions.phonetics import phonogram


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; quoted fields may hold line ends. All columns are strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def with_code(df: DataFrame, name: str | None = None) -> DataFrame:
    """Add ``phonogram``, the code of a column, by default the first."""
    return df.withColumn("phonogram", phonogram(name or df.columns[0]))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def encode_csv(spark: SparkSession, source: str, target: str) -> None:
    """From a CSV to one with a further column ``phonogram``."""
    write_csv(with_code(read_csv(spark, source)), target)


def encode_names(spark: SparkSession, names: Iterable[str] | DataFrame) -> DataFrame:
    """(name, phonogram) for names given as they are, or for each distinct name of a table's first column."""
    if not isinstance(names, DataFrame):
        return with_code(spark.createDataFrame([(n,) for n in names], "name string"))
    return with_code(names.select(names[names.columns[0]].alias("name")).distinct())
