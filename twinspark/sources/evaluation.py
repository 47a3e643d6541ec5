"""Evaluation sets as tables, loaded when asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETS: dict[str, Callable[[SparkSession, str], dict[str, DataFrame]]] = {}


def register_set(name: str, load: Callable[[SparkSession, str], dict[str, DataFrame]]) -> None:
    _SETS[name] = load


def evaluation_set(name: str, spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a set; KeyError for an unknown name. Only the set that is asked for is read."""
    return _SETS[name](spark, path)


def annotated(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """annotation (query_id, label, video_id) from a JSON map of query, label and ids; queries and database, sorted."""
    raw = spark.read.option("wholetext", True).text(path)
    parsed = raw.select(F.from_json("value", "map<string,map<string,array<string>>>").alias("m"))
    labels = parsed.select(F.explode("m").alias("query_id", "labels")).select("query_id", F.explode("labels").alias("label", "ids"))
    annotation = labels.select("query_id", "label", F.explode("ids").alias("video_id"))
    return {"annotation": annotation, "queries": annotation.select("query_id").distinct().orderBy("query_id"), "database": annotation.select("video_id").distinct().orderBy("video_id")}


def identifiers(spark: SparkSession, path: str) -> DataFrame:
    """video_id, one a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("video_id")).where("video_id <> ''")


for _name in ("fine", "large", "distractors", "web", "events", "copies"):
    register_set(_name, annotated)
