"""Detectors over streams. Scoring keeps no state, so a streaming DataFrame goes through the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions.grams import bound
from florilege.functions.text import normalize
from florilege.operators.detectors import marker_label


def labelled(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``lang`` by markers of the normalised text."""
    return stream.withColumn("lang", bound(normalize(text_col), marker_label))  # the list asks for the text many times


def distinct_texts(stream: DataFrame, time_col: str, text_col: str = "text", late: str = "1 hour") -> DataFrame:
    """The first of equal texts within the watermark. State is a key per distinct text, dropped once the watermark has passed it; it
    lives in the query's checkpoint, so a restarted query goes on where it ended."""
    return stream.withColumn("_k", F.md5(text_col)).withWatermark(time_col, late).dropDuplicatesWithinWatermark(["_k"]).drop("_k")
