"""Identifier codecs and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cell_code(prefix: Column, suffix: Column) -> Column:
    """A number as letters a..p (hexadecimal digits shifted), eight of them for 32 bits and more only where it needs them, then the suffix."""
    digits = F.lower(F.hex(prefix.cast("long")))
    digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(8)), F.lit("0"))
    return F.concat(F.translate(digits, "0123456789abcdef", "abcdefghijklmnop"), F.lit("-"), suffix.cast("string"))


def cell_number(code: Column) -> Column:
    """The number that cell_code() spelt."""
    return F.conv(F.translate(F.substring_index(code, "-", 1), "abcdefghijklmnop", "0123456789abcdef"), 16, -10).cast("long")


def transcript_id(fov: Column, counter: Column) -> Column:
    return F.shiftleft(fov.cast("long") + 65536, 32) + counter.cast("long")


def distinct_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names become name--1, name--2 in the given order; single ones stay."""
    w = Window.partitionBy(name)
    return df.withColumn("__k", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w)).withColumn(name, F.when(F.col("__n") > 1, F.concat(name, F.lit("--"), F.col("__k"))).otherwise(F.col(name))).drop("__k", "__n")
