"""One order over a whole table, and running values along it, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.lineage import written


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row, from 1, in the total order ``order``. Rows are dealt out by range
    and stored with their range's number; each range is ranked alone and shifted by the rows of those before it
    (one count per range)."""
    dealt = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    shift = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return ranked.join(shift, "__range").withColumn(name, (F.col(name) + F.col("__shift")).cast("int")).drop("__range", "__shift")


def columns_of(order: list[str], backwards: bool = False) -> list[Column]:
    """Sort columns of names; ``-name`` is descending."""
    return [(F.desc if n.startswith("-") != backwards else F.asc)(n.removeprefix("-")) for n in order]


def deal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` stored by ranges of ``keys`` and ``order``, with the range's number in ``__range``: as many tasks as the rows
    ask for, however few keys there are."""
    return written(df.repartitionByRange(*keys, *columns_of(order)).withColumn("__range", F.spark_partition_id()), "ranges")


_MERGED = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
_AGGREGATE = {"max": F.max, "min": F.min, "sum": F.sum}


def carried(dealt: DataFrame, keys: list[str], order: list[str], **wanted: tuple[str, Column | str, str]) -> DataFrame:
    """Rows of :func:`deal` with running values within ``keys`` along ``order`` (a total one), each as (max, min or sum;
    column; reach). Reach: ``upto`` and ``before`` (this row in or out) from the first row on, ``from`` and ``after`` to the
    last. Each range is scanned alone, and what the ranges before or after it hold of its key is carried over: one
    row for each range and key, and a range holds all rows of a key but for the first and last."""
    rows = dealt.withColumns({f"__{n}": F.col(c) if isinstance(c, str) else c for n, (_, c, _) in wanted.items()})
    totals = rows.groupBy("__range", *keys).agg(*[_AGGREGATE[kind](f"__{n}").alias(f"__{n}") for n, (kind, _, _) in wanted.items()])
    other = {}
    for n, (kind, _, reach) in wanted.items():
        back = reach in ("from", "after")
        w = Window.partitionBy(*keys).orderBy(F.desc("__range") if back else F.asc("__range")).rowsBetween(Window.unboundedPreceding, -1)
        other[f"__other_{n}"] = _AGGREGATE[kind](f"__{n}").over(w)
    totals = totals.select("__range", *keys, *[c.alias(n) for n, c in other.items()])
    own = {}
    for n, (kind, _, reach) in wanted.items():
        w = Window.partitionBy("__range", *keys).orderBy(*columns_of(order, reach in ("from", "after")))
        own[f"__own_{n}"] = _AGGREGATE[kind](f"__{n}").over(w.rowsBetween(Window.unboundedPreceding, -1 if reach in ("before", "after") else 0))
    joined = rows.withColumns(own).join(totals, ["__range", *keys])
    merged = {n: _MERGED[kind](F.col(f"__own_{n}"), F.col(f"__other_{n}")) for n, (kind, _, _) in wanted.items()}
    return joined.select(*dealt.columns, *[c.alias(n) for n, c in merged.items()])
