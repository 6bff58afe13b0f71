"""Sizes and times written as settings, and settings held against rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units of a size, in MB, and of a time, in seconds, by their endings, looked for in this order.
SIZES = {"kb": 1 / 1024, "mb": 1.0, "gb": 1024.0, "tb": 1024.0 * 1024}
TIMES = {"s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0}

RULES = "name string, kind string, least double, most double, wanted string, options array<string>"


def _in_units(value: Column, units: dict[str, float], bare: float) -> Column:
    text = F.lower(F.trim(value))
    number = lambda cut: F.substring(text, F.lit(1), F.length(text) - cut).try_cast("double")
    found = reduce(lambda acc, u: acc.when(F.endswith(text, F.lit(u)), number(len(u)) * F.lit(units[u])), units, F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0.0))
    return found.otherwise(text.try_cast("double") * F.lit(bare)).cast("long")


def size_mb(value: Column) -> Column:
    """``512kB``, ``64MB``, ``2GB``, ``1TB`` or bytes as whole MB, cut off; null and empty give 0, what is no size null."""
    return _in_units(value, SIZES, 1 / (1024 * 1024))


def seconds(value: Column) -> Column:
    """``30s``, ``5min``, ``2h``, ``1d`` or seconds as whole seconds, cut off; null and empty give 0, what is no time null."""
    return _in_units(value, TIMES, 1.0)


def check_settings(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """Settings held against rules: ``(name, value, status, message)``.

    ``settings(name, value)``; ``rules`` as ``RULES``: ``kind`` is ``size`` (bounds in MB), ``time`` (bounds in seconds),
    ``number``, ``option`` (one of ``options``, best ``wanted``) or ``contains`` (at least one of ``options``). ``status`` is
    ``ok``, ``warning``, ``error`` (no option, or unreadable) or ``unknown`` (no rule). Names in any case.
    """
    v = F.col("value")
    number = F.when(F.col("kind") == "size", size_mb(v)).when(F.col("kind") == "time", seconds(v)).otherwise(v.try_cast("double"))
    known = settings.select("name", "value", F.lower("name").alias("k")).join(rules.select(F.lower("name").alias("k"), "kind", "least", "most", "wanted", "options"), "k", "left")
    low, high = F.col("x") < F.col("least"), F.col("x") > F.col("most")
    ranged = F.when(F.col("x").isNull(), "error").when(low | high, "warning").otherwise("ok")
    told = F.when(F.col("x").isNull(), "not readable").when(low, "too small").when(high, "too large").otherwise("within range")
    lowered = F.transform("options", F.lower)
    listed = F.coalesce(F.array_contains(lowered, F.lower(v)), F.lit(False))
    best = F.coalesce(F.lower(v) == F.lower("wanted"), F.lit(False))
    holds = F.coalesce(F.exists("options", lambda o: F.contains(v, o)), F.lit(False))
    rows = known.withColumn("x", number.cast("double"))
    kind = F.col("kind")
    status = F.when(kind.isNull(), "unknown").when(kind == "option", F.when(~listed, "error").when(best, "ok").otherwise("warning")).when(kind == "contains", F.when(holds, "ok").otherwise("warning")).otherwise(ranged)
    message = F.when(kind.isNull(), "no rule").when(kind == "option", F.when(~listed, "no such option").when(best, "best option").otherwise("not the best option")).when(kind == "contains", F.when(holds, "contains one").otherwise("contains none")).otherwise(told)
    return rows.select("name", "value", status.alias("status"), message.alias("message"))


def session_settings(spark: SparkSession) -> DataFrame:
    """The settings of the session: ``(name, value)``."""
    return spark.sql("set").select(F.col("key").alias("name"), "value")
