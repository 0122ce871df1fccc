"""Interval arithmetic and joins. Intervals are 1-based and inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.ordering import carried, deal


def overlap_gap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """max start - min end: under 0 is an overlap, one less than the number of shared bases."""
    return F.greatest(s1, s2) - F.least(e1, e2)


def gap_or_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases between two intervals if over 0; minus the number of shared bases otherwise."""
    return -(F.least(e1, e2) - F.greatest(s1, s2) + 1)


def overlap_only(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Number of shared bases, 0 if there are none."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def midpoint(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("int")


def bin_join(left: DataFrame, right: DataFrame, keys: list[str], l_start: str, l_end: str, r_start: str, r_end: str, width: int = 10_000) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose intervals share a base, each once.

    Both sides are dealt to all bins of ``width`` bases that they touch and joined on keys and bin; a pair
    counts only in the bin where the later of its starts lies, so no distinct is needed. The columns of both
    sides must differ except for ``keys``.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    a = left.withColumn("__bin", bins(l_start, l_end))
    b = right.withColumn("__bin", bins(r_start, r_end))
    later = F.greatest(F.col(l_start), F.col(r_start))
    return (
        a.join(b, [*keys, "__bin"])
        .filter((F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end)) & (F.floor(later / width) == F.col("__bin")))
        .drop("__bin")
    )


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, order: list | None = None) -> DataFrame:
    """``df`` with ``island`` (from 1 within ``keys``): rows whose intervals overlap, or lie ``gap`` bases or
    less apart (0: at least touching at an end base), are in one island."""
    w = Window.partitionBy(*keys).orderBy(*(order or [F.col(start), F.col(end).desc()]))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w)).drop("__new")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """Union of the intervals within ``keys``: keys, start, end, n (rows merged)."""
    return (
        islands(df, keys, start, end, gap)
        .groupBy(*keys, "island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))
        .drop("island")
    )


def coverage(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per ``keys``: bases covered at least once (cover1) and at least twice (cover2), by a sweep over ends;
    depth and next end are carried from range to range."""
    opens = df.select(*keys, F.col(start).cast("long").alias("at"), F.lit(1).alias("step"))
    shuts = df.select(*keys, (F.col(end) + 1).cast("long").alias("at"), F.lit(-1).alias("step"))
    edges = deal(opens.union(shuts).groupBy(*keys, "at").agg(F.sum("step").alias("step")), keys, ["at"])
    runs = carried(edges, keys, ["at"], depth=("sum", "step", "upto"), next=("min", "at", "after")).withColumn("size", F.col("next") - F.col("at"))
    total = lambda least: F.coalesce(F.sum(F.when(F.col("depth") >= least, F.col("size"))), F.lit(0)).cast("long")
    return runs.groupBy(*keys).agg(total(1).alias("cover1"), total(2).alias("cover2"))
