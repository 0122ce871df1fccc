"""Uniform shuffle of a table into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.lineage import written

#: Input partitions whose rows of the matrix are drawn together; the driver draws one row for each such block.
BLOCK = 64
#: Rows of a shard that a task of the second permutation gets on average.
CELL_ROWS = 1 << 15
#: Bits of a row's random place in its shard.
KEY_BITS = 62
#: Spark numbers a partition's rows within so many bits.
AT_BITS = 33


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` balls drawn without replacement are good. The weights of all counts within ten deviations of
    the likeliest (what lies beyond is under 1e-20) come from their ratios, so no size of urn is too large."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 20 + int(10 * np.sqrt(n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)))
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    up_to = np.cumsum(np.exp(weights - weights.max()))
    return first + int(np.searchsorted(up_to, draw.random() * up_to[-1], side="right").clip(0, len(up_to) - 1))


def draw_matrix(sizes: list[int], room: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Rows with the sums ``sizes`` and columns with the sums ``room``, as a uniform permutation of all balls fills
    them: each row is drawn from what the rows before it have left, column after column."""
    left = [int(x) for x in room]
    out = np.zeros((len(sizes), len(left)), np.int64)
    for r, size in enumerate(sizes):
        todo, rest = int(size), sum(left)
        for c, good in enumerate(left):
            rest -= good
            got = hypergeometric(draw, good, rest, todo)
            out[r, c] = got
            left[c] -= got
            todo -= got
            if not todo:
                break
    return out


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard: counts differ by one at most, and sum up to ``rows``."""
    return rows // shards + (np.arange(shards) < rows % shards)


def shuffle(df: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """``df`` with shard (int, 0 to ``shards`` - 1) and slot (long, gapless from 0 in each shard): every assignment of
    rows to places is equally likely, and the shards' row counts differ by one at most.

    The rows are stored with their partition and place. From the partitions' counts, how many rows of each partition
    go to each shard is drawn (multivariate hypergeometric: the driver draws for blocks of 64 partitions, the tasks
    within their block), each partition deals out a permutation of just those shards, rows are exchanged, and each
    shard is permuted again: by a random place of 62 bits, cut into cells of some 32,768 rows whose counts give the
    cells' first slots. So no task holds a shard. The driver gets one count for each input partition, the tasks
    13 bytes each; nothing depends on the rows' content, so no value can be hot.

    Null values, empty and long texts and repeated rows are rows like any others; input columns named shard or slot
    are replaced (so are those that begin with two underscores), further columns pass through; an empty table gives an
    empty result. The same stored partitions and seed give the same places.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot") or c.startswith("__")])
    at = F.monotonically_increasing_id()
    dealt = written(rows.withColumn("__at", at), "dealt")
    part = F.shiftright("__at", AT_BITS)
    counts = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.zeros(max(counts, default=-1) + 1, np.int64)
    for p, n in counts.items():
        sizes[p] = n
    total = int(sizes.sum())
    blocks = [int(sizes[b : b + BLOCK].sum()) for b in range(0, len(sizes), BLOCK)]
    margins = draw_matrix(blocks, shard_sizes(total, shards), np.random.default_rng([seed, 0]))
    cells = max(1, -(-total // (shards * CELL_ROWS)))
    mask = (1 << AT_BITS) - 1

    @F.pandas_udf("shard int, key long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=4)
        def block_of(b: int) -> np.ndarray:
            return draw_matrix(sizes[b * BLOCK : (b + 1) * BLOCK].tolist(), margins[b], np.random.default_rng([seed, 1, b]))

        @lru_cache(maxsize=2)
        def places(p: int) -> tuple[np.ndarray, np.ndarray]:
            draw = np.random.default_rng([seed, 2, p])
            shard = draw.permutation(np.repeat(np.arange(shards, dtype=np.int32), block_of(p // BLOCK)[p % BLOCK]))
            return shard, draw.integers(0, 1 << KEY_BITS, len(shard))

        for batch in batches:
            ids = batch.to_numpy()
            own, inside = ids >> AT_BITS, ids & mask
            shard, key = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
            for p in np.unique(own).tolist():
                here = own == p
                s, k = places(p)
                shard[here], key[here] = s[inside[here]], k[inside[here]]
            yield pd.DataFrame({"shard": shard, "key": key})

    placed = dealt.withColumn("__to", place("__at"))
    placed = placed.select("*", F.col("__to.shard").alias("shard"), F.col("__to.key").alias("__key")).drop("__to")
    # the key's share of its range names the cell: whole numbers only, so both uses agree
    cell = F.shiftright(F.shiftright("__key", KEY_BITS - 31) * F.lit(cells), 31).cast("int")
    placed = placed.withColumn("__cell", cell)
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    first = first.select("shard", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy("shard", "__cell").orderBy("__key", "__at")
    ranked = placed.withColumn("__row", F.row_number().over(own) - 1).join(first, ["shard", "__cell"])
    return ranked.select(*rows.columns, "shard", (F.col("__first") + F.col("__row")).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 40, seed: int = 17) -> DataFrame:
    """Writes :func:`shuffle`'s rows as Parquet, a folder for each shard, and returns them read back. Within a shard
    rows stand in files by ranges of slots, in order of slots."""
    placed = shuffle(df, shards, seed).withColumn("__range", F.expr(f"slot div {CELL_ROWS}"))
    dealt = placed.repartition("shard", "__range").sortWithinPartitions("shard", "slot").drop("__range")
    dealt.write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def digest(placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of :func:`shuffle`'s result: the id, size (UTF-8 bytes of the text, null: none, plus 16),
    text_crc32 (unsigned), law (``rows``: counts at most one apart; a uniform shuffle can't keep equal texts together),
    shard, slot and grown_shard (null: a shuffle for one shard more is a new one)."""
    text = F.coalesce(text_col, F.lit(""))
    return placed.select(
        id_col, (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
