"""Collinear gene sets: runs of hits whose genes step together along both chromosomes."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.scalars import same_strand
from genoloom.operators.ordering import carried, deal
from genoloom.operators.pieces import stream_pieces


def gene_rank(genes: DataFrame) -> DataFrame:
    """(annot_idx, grp_idx, rank): place of each gene along its chromosome, by start, longer first; counted by range."""
    key, order = ["grp_idx"], ["g_start", "-length", "annot_idx"]
    rows = genes.select("annot_idx", "grp_idx", "g_start", (F.col("g_end") - F.col("g_start")).alias("length"))
    ranked = carried(deal(rows, key, order), key, order, rank=("sum", F.lit(1), "upto"))
    return ranked.select("annot_idx", "grp_idx", F.col("rank").cast("int").alias("rank"))


def ranked_hits(hits: DataFrame, ranks: DataFrame) -> DataFrame:
    """Hits with a gene on both sides: hit_idx, hitnum, chromosomes, same (strand), rank1, rank2."""
    one = ranks.select(F.col("annot_idx").alias("annot1_idx"), F.col("rank").alias("rank1"))
    two = ranks.select(F.col("annot_idx").alias("annot2_idx"), F.col("rank").alias("rank2"))
    return hits.join(one, "annot1_idx").join(two, "annot2_idx").select("hit_idx", "hitnum", "grp1_idx", "grp2_idx", same_strand(F.col("strand")).alias("same"), "rank1", "rank2")


def diagonal_sets(ranked: DataFrame, least: int = 2) -> DataFrame:
    """Runs of distinct gene pairs (rank1, rank2) on a diagonal: rank2 - rank1 is constant on the same strand,
    rank2 + rank1 on opposite ones, and rank1 steps by 1. Returns the pairs of runs of ``least`` or more, with
    diag, run (first rank1) and size."""
    keys = ["grp1_idx", "grp2_idx", "same", "diag"]
    pairs = ranked.withColumn("diag", F.when(F.col("same"), F.col("rank2") - F.col("rank1")).otherwise(F.col("rank2") + F.col("rank1")))
    pairs = pairs.groupBy(*keys, "rank1", "rank2").agg(F.min("hitnum").alias("hitnum"))
    w = Window.partitionBy(*keys).orderBy("rank1")
    runs = pairs.withColumn("run", F.col("rank1") - F.row_number().over(w))
    sized = runs.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")))
    return sized.filter(F.col("size") >= least)


class RunScan:
    """The scans along a piece, side by side: hits come one after the other, and only the scans that are still open are held.

    From each hit that is in no set yet, in order, a run goes on to the next such hit one step further on both sides
    (``step`` is the sign of side 2) and ends at one that is over one step further on side 1 and not one on side 2; hits of
    sets are passed over. So a hit goes to the earliest open scan that waits for its ranks, or else begins one; and it ends
    those that it is too far on for, but not those that began after the one that took it, which don't see it."""

    def __init__(self, step: int) -> None:
        self.step, self.count = step, 0
        #: By rank1 and rank2 of the hit waited for: [place of the start, start's hit or None once the run has two], by place.
        self.open: dict[int, dict[int, list[list]]] = {}
        self.ranks: list[int] = []

    def _wait(self, scan: list, x: int, y: int) -> None:
        if x not in self.open:
            self.open[x] = {}
            insort(self.ranks, x)
        insort(self.open[x].setdefault(y, []), scan)

    def _clear(self, x: int, y: int) -> None:
        del self.open[x][y]
        if not self.open[x]:
            del self.open[x]
            del self.ranks[bisect_left(self.ranks, x)]

    def feed(self, rank1: list[int], rank2: list[int]) -> list[tuple[int, int]]:
        """(place of the hit in the piece, place of its run's first hit) of the hits that turn out to be in runs."""
        found = []
        for x, y in zip(rank1, rank2, strict=True):
            at, self.count = self.count, self.count + 1
            waiting = self.open.get(x, {}).get(y)
            taker = waiting.pop(0) if waiting else None
            if waiting is not None and not waiting:
                self._clear(x, y)
            for low in self.ranks[: bisect_left(self.ranks, x)]:
                for other in [k for k in self.open[low] if k != y]:
                    left = [] if taker is None else [s for s in self.open[low][other] if s[0] > taker[0]]
                    if left:
                        self.open[low][other] = left
                    else:
                        self._clear(low, other)
            if taker is None:
                taker = [at, False]
            else:
                if not taker[1]:
                    found.append((taker[0], taker[0]))
                    taker[1] = True
                found.append((at, taker[0]))
            self._wait(taker, x + 1, y + self.step)
        return found

    def held(self) -> list[int]:
        """Places of hits that may yet turn out to be a run's first."""
        return [s[0] for ys in self.open.values() for some in ys.values() for s in some if not s[1]]

    def last(self, later: int) -> int | None:
        """The first start whose scan has come to the last hit: no later one counts. ``later`` says what follows the piece,
        whose ranks on side 1 are all out of reach: nothing (-1), hits that end any scan (-2), or only hits of this one rank
        on side 2."""
        return min((s[0] for ys in self.open.values() for y, some in ys.items() if later in (-1, y) for s in some), default=None)


#: Hits that :func:`scan_runs` hands to a scan at once, less one.
PROBED = 24


def scan_runs(rank1: list[int], rank2: list[int], step: int, later: int) -> tuple[list[int], list[int]]:
    """(run, size) of each hit of a piece in hit order, 0 for hits of no set; see :class:`RunScan`."""
    scan, at_once = RunScan(step), PROBED + 1
    found = [f for lo in range(0, len(rank1), at_once) for f in scan.feed(rank1[lo : lo + at_once], rank2[lo : lo + at_once])]
    last = scan.last(later)
    runs: dict[int, list[int]] = {}
    for at, start in found:
        if last is None or start <= last:
            runs.setdefault(start, []).append(at)
    run, size = [0] * len(rank1), [0] * len(rank1)
    for number, start in enumerate(sorted(runs), 1):
        for at in runs[start]:
            run[at], size[at] = number, len(runs[start])
    return run, size


#: Last start that counts, in rows of hits.
ALL = 1 << 62


class _PieceScan:
    """:class:`RunScan` over the rows of a piece: rows of hits in runs with the place of their run's first hit (``start``), and at
    the end, if no start after some place counts, a row that says so (``last``)."""

    def __init__(self) -> None:
        self.scan: RunScan | None = None
        self.kept: dict[int, tuple] = {}
        self.seen = 0

    def feed(self, rows: dict[str, np.ndarray]) -> tuple:
        if self.scan is None:
            self.scan = RunScan(1 if rows["same"][0] else -1)
        found = self.scan.feed(rows["rank1"].tolist(), rows["rank2"].tolist())
        self.end_row = {n: c[-1] for n, c in rows.items()}
        own = [rows[c] for c in _SCANNED]
        row = lambda at: self.kept[at] if at < self.seen else tuple(c[at - self.seen] for c in own)
        out = [(*row(at), start, ALL) for at, start in found]
        self.kept = {at: row(at) for at in self.scan.held()}
        self.seen = self.scan.count
        return tuple(zip(*out, strict=True)) if out else ((),) * (len(_SCANNED) + 2)

    def end(self) -> tuple:
        low, high = self.end_row["low2"], self.end_row["high2"]
        last = self.scan.last(int(low) if low == high else -2)
        return ((),) * (len(_SCANNED) + 2) if last is None else tuple((v,) for v in (*(self.end_row[c] for c in _SCANNED), 0, last))


_SCANNED = {"hit_idx": "long", "hitnum": "int", "grp1_idx": "int", "grp2_idx": "int", "same": "boolean", "rank1": "int", "rank2": "int", "piece": "long"}


def scanned_sets(ranked: DataFrame) -> DataFrame:
    """Runs as the sequential rule finds them in hit order (:func:`scan_runs`), of two hits and more: each hit is in one run
    at most, hits between are skipped, and the walk along a chromosome pair and strand class ends with the first scan that
    comes to its last hit.

    Where all hits from one on have side-1 ranks two or more above all before it, no run goes on, so the class is cut there
    and each piece is walked alone, as a stream of which only the open scans are held (:class:`RunScan`), with the span of side-2 ranks of all that follows: that decides whether a scan still
    open at the piece's end is ended by what follows or comes to the last hit. Cuts and spans are running values that are
    carried from range to range. Runs are numbered through afterwards."""
    keys, order = ["grp1_idx", "grp2_idx", "same"], ["hitnum", "hit_idx"]
    dealt = deal(ranked.select(*[c for c in _SCANNED if c != "piece"]), keys, order)
    rows = carried(dealt, keys, order, before=("max", "rank1", "before"), rest=("min", "rank1", "from"), low2=("min", "rank2", "after"), high2=("max", "rank2", "after"))
    cut = F.when(F.col("rest") - F.col("before") <= 1, 0).otherwise(1)
    rows = carried(rows, keys, order, piece=("sum", cut, "upto")).withColumns({k: F.coalesce(k, F.lit(-1)) for k in ("low2", "high2")}).drop("before", "rest", "__range")
    found = stream_pieces(rows, [*keys, "piece"], order, _PieceScan, {**_SCANNED, "start": "long", "last": "long"}).repartition(*keys)
    of_piece, of_run = (Window.partitionBy(*keys, "piece", *some) for some in ([], ["start"]))
    found = found.withColumn("__end", F.min("last").over(of_piece)).filter((F.col("last") == ALL) & (F.col("start") <= F.col("__end")))
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("piece", "start")).cast("long")
    return found.select(*[c for c in _SCANNED if c != "piece"], number.alias("run"), F.count(F.lit(1)).over(of_run).alias("size"))


def renumber_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Sets (identified by ``keys`` within a chromosome pair) numbered per pair by size, largest first, then by
    first hit number: adds runnum and runsize."""
    per = sets.groupBy("grp1_idx", "grp2_idx", *keys).agg(F.max("size").alias("runsize"), F.min("hitnum").alias("first"))
    w = Window.partitionBy("grp1_idx", "grp2_idx").orderBy(F.desc("runsize"), F.asc("first"), *keys)
    return sets.join(per.withColumn("runnum", F.row_number().over(w)), ["grp1_idx", "grp2_idx", *keys])


def check_sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of sets that break the rule: a neighbour that is not one step away on both sides."""
    w = Window.partitionBy("grp1_idx", "grp2_idx", *keys).orderBy("rank1")
    d1, d2 = F.col("rank1") - F.lag("rank1").over(w), F.abs(F.col("rank2") - F.lag("rank2").over(w))
    return sets.withColumn("d1", d1).withColumn("d2", d2).filter("d1 is not null and (d1 <> 1 or d2 <> 1)")


def mirror_sets(hits: DataFrame) -> DataFrame:
    """Mirror rows (refidx > 0) of a self-comparison take set number and size from their originals."""
    own = hits.filter("refidx = 0").select(F.col("hit_idx").alias("refidx"), F.col("runnum").alias("r"), F.col("runsize").alias("s"))
    joined = hits.join(own, "refidx", "left")
    return joined.select(*[F.coalesce({"runnum": F.col("r"), "runsize": F.col("s")}.get(c, F.col(c)), F.col(c)).alias(c) for c in hits.columns])
