"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.sources.written import materialize

#: Bits of the filter that rows are sifted by, a power of two; it goes to every task, whatever the tables' sizes.
SIEVE = 1 << 23


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """The columns of `df` as c0, c1, ..., and each row's place: a hash of its file's name and its number in the file.

    A table that isn't read from files is written first.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    try:
        rows = _with_place(df)
    except AnalysisException:  # no files, or those of several tables
        rows = _with_place(materialize(df.toDF(*names), "rows"))
    return rows.select("row.*", "file", "at").toDF(*names, "file", "at")


def _with_place(df: DataFrame) -> DataFrame:
    """Each row as a struct, with its place."""
    meta = df.metadataColumn("_metadata")
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"))


def sifted(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """`rows`, and `sifted`: false only where no row of `wanted` has its values of `on`. So a join with few rows moves hardly more
    than it finds; of very many wanted rows the filter is full and rules out nothing."""
    bit = F.pmod(F.xxhash64(*on), F.lit(SIEVE))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("__word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("__bits"))
    met = rows.withColumn("__bit", bit).withColumn("__word", F.shiftright("__bit", 6)).join(F.broadcast(words), "__word", "left")
    hit = F.coalesce(F.expr("getbit(__bits, CAST(__bit % 64 AS INT)) = 1"), F.lit(False))
    return met.withColumn("sifted", hit).drop("__word", "__bit", "__bits")
