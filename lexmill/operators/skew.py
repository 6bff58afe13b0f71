"""Keys that hold most of the records.

Heavy keys are found with a bounded sketch over all rows. Results per key: heavy keys are worked on where the rows lie
(broadcast join, then a partial aggregate), every other key takes the ordinary shuffle, and the two results are united.
Joins whose rows go on: heavy keys are salted in one pass. Which keys the sketch names changes only the route of a row,
never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A key is heavy if the sketch gives it at least this share of the rows, or that of an even shuffle partition if it is less.
MIN_SHARE = 0.002
#: At most so many keys are ever treated as heavy, hence broadcast (no more than 1 / share keys can be).
MAX_HEAVY = 20_000
#: Entries of the sketch kept for each partition, at least and at most.
TRACKED = (2048, 100_000)


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def heavy_counts(df: DataFrame, *keys: str, max_keys: int | None = None, min_share: float | None = None, tracked: int | None = None) -> tuple[int, dict[str, dict]]:
    """Rows of ``df`` and, for each column of ``keys``, its heavy values with their number of rows, about.

    One pass with one frequent-items sketch for each column. By default a key is heavy from ``MIN_SHARE`` of the rows or from
    an even share of a shuffle partition, whichever is less, so what stays light fits beside the rest of a partition. Null
    is never a heavy key. An empty table gives ``(0, {key: {}})``. No more than 1 / share keys can have a share of that
    size, so the result is bounded, whatever the size of the data.
    """
    for key in keys:
        if not _orderable(df.schema[key].dataType):
            raise TypeError(f"{key}: heavy keys need an atomic type")
    if min_share is None:
        min_share = min(MIN_SHARE, 1 / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if max_keys is None:
        max_keys = min(MAX_HEAVY, math.ceil(1 / min_share))
    if tracked is None:
        tracked = min(TRACKED[1], max(TRACKED[0], 4 * max_keys))
    row = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *(F.expr(f"approx_top_k(`{key}`, {max_keys}, {max(tracked, max_keys)})").alias(f"__k{i}") for i, key in enumerate(keys)),
    ).first()
    total = row["__rows"]
    least = max(2, total * min_share)
    found = {}
    for i, key in enumerate(keys):
        found[key] = {x["item"]: x["count"] for x in (row[f"__k{i}"] or []) if x["item"] is not None and x["count"] >= least}
    return total, found


def heavy_keys(df: DataFrame, *keys: str, **detect) -> tuple[int, dict[str, list]]:
    """:func:`heavy_counts` without the numbers: the rows of ``df`` and the heavy values of each column."""
    total, found = heavy_counts(df, *keys, **detect)
    return total, {key: list(values) for key, values in found.items()}


def _key_frame(df: DataFrame, key: str, values: Iterable, **more: list) -> DataFrame:
    """The heavy values as a table, with further columns of whole numbers; a literal list, so that every use of it agrees."""
    values, kind = list(values), df.schema[key].dataType
    own = T.StructType([T.StructField(key, kind, True), *[T.StructField(name, T.IntegerType(), False) for name in more]])
    try:
        columns = [pa.array(values, to_arrow_type(kind)), *[pa.array(x, pa.int32()) for x in more.values()]]
        return df.sparkSession.createDataFrame(pa.table(columns, names=[key, *more]), own)
    except (pa.ArrowException, TypeError):
        return df.sparkSession.createDataFrame(list(zip(values, *more.values(), strict=True)), own)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of ``df`` is below the session's limit for broadcasts."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def split_by_heavy(df: DataFrame, key: str, values: Iterable) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in ``values``, and all others (null keys are among the others)."""
    values = list(values)
    if not values:
        return df.limit(0), df
    hot = F.broadcast(_key_frame(df, key, values))
    return df.join(hot, key, "left_semi"), df.join(hot, key, "left_anti")


def salted(big: DataFrame, small: DataFrame, key: str, heavy: dict | list, salt: str = "__salt") -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``salt`` to be joined on beside ``key``, so that no heavy key gathers in one task.

    A key with ``m`` times the rows of the least heavy one is spread over ``m`` salts (without the numbers, over as many as
    there are shuffle partitions), and its rows of ``small`` are repeated for each; as shares sum to one, that adds at most
    2 / share rows for each row a key has there. Rows of ``big`` with a
    null key, which match nothing, are spread too. ``big`` is read once, whatever is heavy.
    """
    # whole numbers tell rows apart as a rule, and cost a scan little
    plain = [f.name for f in big.schema if isinstance(f.dataType, T.IntegralType)] or [f.name for f in big.schema if _orderable(f.dataType)]
    mixed = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{name}`") for name in plain])
    partitions = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col(key).isNull(), F.lit(partitions))
    if not heavy:
        return big.withColumn(salt, F.when(F.col(key).isNull(), F.pmod(mixed, F.lit(partitions))).otherwise(F.lit(0)).cast("int")), small.withColumn(salt, F.lit(0))
    if not isinstance(heavy, dict):
        heavy = dict.fromkeys(heavy, partitions) | {None: 1}
    least = min(heavy.values())
    rows = {k: max(2, math.ceil(n / least)) for k, n in heavy.items() if k is not None}
    salts = F.broadcast(_key_frame(big, key, rows, __salts=list(rows.values())))
    out = big.join(salts, key, "left").withColumn(salt, F.pmod(mixed, spread.otherwise(F.coalesce("__salts", F.lit(1)))).cast("int"))
    copies = small.join(salts, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    return out.drop("__salts"), copies.drop("__salts")


def skew_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", heavy: dict | list | None = None, **detect) -> DataFrame:
    """Join ``big`` to ``small`` (at most one row for each key) without piling a heavy key onto one task.

    ``how``: ``inner`` or ``left``. A ``small`` that Spark estimates to fit a broadcast is broadcast. Else both sides are :func:`salted`: heavy keys are spread over as many salts as they need, and
    so are rows of ``big`` with a null key, which match nothing and are dropped (``inner``) or kept with nulls (``left``).
    ``big`` is read once and shuffled once. ``heavy`` may name the
    heavy keys with their rows, as :func:`heavy_counts` gives them; else they are looked for in ``big``. Columns of ``small``
    other than the key that also occur in ``big`` raise ``ValueError``. Repeated rows of ``big`` stay repeated.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    clash = (set(map(str.lower, big.columns)) & set(map(str.lower, small.columns))) - {key.lower()}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    columns = [key, *[c for c in big.columns if c != key], *[c for c in small.columns if c != key]]
    if fits_broadcast(small):
        return big.join(small, key, how).select(columns)
    if heavy is None:
        heavy = heavy_counts(big, key, **detect)[1][key]
    a, b = salted(big.where(F.col(key).isNotNull()) if how == "inner" else big, small, key, heavy)
    return a.join(b, [key, "__salt"], how).select(columns)


def skew_joins(big: DataFrame, how: str, *sides: tuple[DataFrame, str]) -> DataFrame:
    """:func:`skew_join` of ``big`` with each ``(small, key)`` in turn; the heavy keys of all are found in one pass."""
    large = list(dict.fromkeys(key for small, key in sides if not fits_broadcast(small)))
    heavy = heavy_counts(big, *large)[1] if large else {}
    for small, key in sides:
        big = skew_join(big, small, key, how, heavy.get(key))
    return big


def per_key_results(rows: DataFrame, key: str, aggregates: list[Column], attributes: DataFrame | None = None, heavy: list | None = None, **detect) -> DataFrame:
    """One row for each key of ``rows``: ``aggregates`` over its rows, plus its columns of ``attributes``.

    ``attributes`` has at most one row for each key; its columns may be used in ``aggregates``, joined in by
    :func:`skew_join`. Heavy keys and other keys are aggregated apart and united; ``is_heavy`` says which way a key went.
    Rows with a null key belong to no key. Repeated rows count each time. An empty table gives no row.
    """
    rows = rows.where(F.col(key).isNotNull())
    if heavy is None:
        heavy = heavy_keys(rows, key, **detect)[1][key]
    hot, cold = split_by_heavy(rows, key, heavy)
    attributes_hot = None
    if attributes is not None:
        cold = cold.join(attributes, key, "left")
        if heavy:
            attributes_hot = F.broadcast(attributes.join(F.broadcast(_key_frame(rows, key, heavy)), key, "left_semi"))
            hot = hot.join(attributes_hot, key, "left")
    out = cold.groupBy(key).agg(*aggregates).withColumn("is_heavy", F.lit(False))
    if heavy:
        out = out.unionByName(hot.groupBy(key).agg(*aggregates).withColumn("is_heavy", F.lit(True)))
    return out


def frequent_keys(rows: DataFrame, key: str, more_than: float, heavy: list | None = None) -> DataFrame:
    """The keys with more than ``more_than`` rows, with their exact ``n_rows``: ``(key, n_rows)``.

    Exact for every key: heavy ones are counted where they lie, the rest after the ordinary shuffle.
    """
    counts = per_key_results(rows.select(key), key, [F.count(F.lit(1)).alias("n_rows")], heavy=heavy)
    return counts.where(F.col("n_rows") > F.lit(more_than)).select(key, "n_rows")
