"""Packing by optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.lineage import written

#: Lengths up to here are kept apart in the histogram; beyond, by their leading ``STEP_BITS`` bits, so the
#: histogram that the driver receives has under FINE + 64 * 2**STEP_BITS rows whatever the corpus holds.
FINE, STEP_BITS = 131_072, 10


def length_bin(length: Column) -> Column:
    """The length itself up to FINE, else the length cut to its leading bits."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int") - STEP_BITS)
    coarse = F.call_function("shiftleft", F.call_function("shiftright", length, shift), shift)
    return F.when(length <= FINE, length).otherwise(coarse)


def best_boundaries(tops: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Positions in ``tops`` (ascending lengths) that end a bucket, for the least padding with at most
    ``buckets`` buckets: cost of positions i..j is tops[j] * documents - tokens. The best split moves right
    with j, so each layer of the dynamic program is filled by halving, a whole level at once."""
    n = len(tops)
    if not n:
        return []
    c = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    s = np.concatenate([[0.0], np.cumsum(sums, dtype=np.float64)])
    t = tops.astype(np.float64)
    cost = lambda i, j: t[j] * (c[j + 1] - c[i]) - (s[j + 1] - s[i])
    best = cost(np.zeros(n, np.int64), np.arange(n))
    cuts = [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        before = np.concatenate([[0.0], best])  # before[i]: positions under i, in one bucket fewer
        now, at = np.full(n, np.inf), np.zeros(n, np.int64)
        jobs = [(0, n - 1, 0, n - 1)]
        while jobs:
            mids = [((lo + hi) // 2, a, b) for lo, hi, a, b in jobs]
            widths = np.array([min(b, m) - a + 1 for m, a, b in mids])
            owner = np.repeat(np.arange(len(mids)), widths)
            start = np.repeat(np.cumsum(widths) - widths, widths)
            i = np.arange(len(owner)) - start + np.array([a for _, a, _ in mids])[owner]
            j = np.array([m for m, _, _ in mids])[owner]
            value = before[i] + cost(i, j)
            low = np.minimum.reduceat(value, np.cumsum(widths) - widths)
            hit = np.flatnonzero(value == low[owner])
            first = hit[np.unique(owner[hit], return_index=True)[1]]
            nxt = []
            for (lo, hi, a, b), (m, _, _), f in zip(jobs, mids, first, strict=True):
                now[m], at[m] = value[f], i[f]
                if lo < m:
                    nxt.append((lo, m - 1, a, int(i[f])))
                if m < hi:
                    nxt.append((m + 1, hi, int(i[f]), b))
            jobs = nxt
        best = now
        cuts.append(at)
    ends, j = [], n - 1
    for at in reversed(cuts):
        if j < 0:
            break
        ends.append(j)
        j = int(at[j]) - 1
    return ends[::-1]


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 16, budget: int = 65_536, batch_rows: int = 4096) -> DataFrame:
    """Assigns each document to a length bucket and a batch of at most ``budget`` padded tokens.

    ``length`` is a column of token counts; by default the number of non-space words of ``text_col``. Columns:
    id, n_tokens, bucket (from 0, by length), padded (length that the bucket pads to), batch (text, unique),
    slot (place in the batch, from 0). Documents of no tokens, and null texts, are in bucket -1 with padding 0
    and no batch (null). Rows of a repeated id and rows with a null id keep a row each, and are dealt to pieces by their
    texts too. Ties of length go by id. Columns of other names are ignored. An empty table gives an empty result.

    Boundaries come from a dynamic program over the histogram of all lengths, which is exact up to FINE tokens
    and has a bounded number of bins beyond, each 1 / 2**STEP_BITS of its lengths wide; no bucket pads to more than its longest document. Ranks are
    taken inside pieces of a bucket of about ``batch_rows`` documents, so no task holds a whole bucket; a
    document longer than the budget is a batch of its own.
    """
    size = length if length is not None else F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+"))
    # texts are read once; all that follows works on three numbers per document
    spread = F.xxhash64(id_col, text_col) if text_col in df.columns else F.xxhash64(id_col)
    rows = written(df.select(F.col(id_col), size.cast("long").alias("n_tokens"), spread.alias("__spread")), "lengths")
    bins = rows.filter("n_tokens > 0").groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("top")
    )
    found = sorted((r["top"], r["docs"], r["tokens"]) for r in bins.collect())
    tops, docs, tokens = (np.array([x[k] for x in found], np.int64) for k in range(3))
    ends = best_boundaries(tops, docs, tokens, buckets)
    upper = [int(tops[e]) for e in ends]
    starts = [0, *[e + 1 for e in ends]][: len(ends)]
    full = [int(docs[a : e + 1].sum()) for a, e in zip(starts, ends, strict=True)]
    pieces = [max(1, n // max(batch_rows, 16 * (budget // top))) for n, top in zip(full, upper, strict=True)]
    bucket = F.aggregate(F.array(*map(F.lit, upper)).cast("array<long>"), F.lit(0), lambda k, top: k + (top < F.col("n_tokens")).cast("int"))
    at = F.col("bucket") + 1
    placed = (
        rows.filter("n_tokens > 0")
        .withColumn("bucket", bucket)
        .withColumn("padded", F.element_at(F.array(*map(F.lit, upper)).cast("array<long>"), at))
        .withColumn("piece", F.pmod(F.xxhash64("__spread"), F.element_at(F.array(*map(F.lit, pieces)).cast("array<long>"), at)))
    )
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded"), F.lit(1)))).cast("long")
    packed = placed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("bucket", "piece").orderBy(id_col, "n_tokens", "__spread")) - 1
    )
    packed = packed.select(
        id_col, "n_tokens", "bucket", "padded",
        F.concat_ws("-", "bucket", "piece", F.floor(F.col("rank") / room)).alias("batch"),
        (F.col("rank") % room).cast("int").alias("slot"),
    )
    rest = rows.filter("n_tokens <= 0").select(
        id_col, "n_tokens", F.lit(-1).alias("bucket"), F.lit(0).cast("long").alias("padded"), F.lit(None).cast("string").alias("batch"), F.lit(None).cast("int").alias("slot")
    )
    return packed.unionByName(rest)
