"""Paragraphs of plain or marked-up text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraphs(df: DataFrame, id_col: str, text: str = "text", least: int = 20) -> DataFrame:
    """id, place (of the line, from 0), paragraph: trimmed lines of at least ``least`` words."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("place", "line")).withColumn("paragraph", F.trim("line"))
    words = F.size(F.split("paragraph", r"\s+"))
    return lines.filter((F.col("paragraph") != "") & (words >= least)).select("id", "place", "paragraph")


def plain(text: Column) -> Column:
    """Without heading marks, asterisks and empty lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^#+\s*", ""), r"\*+", ""))
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), "\n")
