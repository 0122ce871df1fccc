"""Synteny blocks: chaining of hits, acceptance, merging, statistics, contig order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.intervals import bin_join, midpoint
from genoloom.functions.scalars import pearson, reverse_complement, same_strand
from genoloom.operators.chaining import ChainSearch, best_chain
from genoloom.operators.graph import connected_components
from genoloom.operators.hits import number_hits, swap_sides
from genoloom.operators.lineage import written
from genoloom.operators.ordering import carried, deal, global_rank

#: Smallest gap of the search, and the limits of the fit of small blocks.
MIN_GAP, FIT = 1000, (300_000, 4_000_000)
#: Least correlation of a chain (strict, else) and of all hits in its box, by case A to D.
CHAIN_R, BOX_R = (0.9, 0.98, 0.96, 0.94), (0.7, 0.9, 0.8, 0.7)
LOOSE_A = 0.8


@dataclass
class Cutoffs:
    """Limits of the block search for one project pair: greatest gaps, least hits, gaps to search by."""

    gap1: int
    gap2: int
    mindots: int = 7
    strict: bool = True
    orient: bool = False
    gaps: list[tuple[int, int]] = field(default_factory=list)


def synteny_cutoffs(hits: DataFrame, groups: DataFrame, strict: bool = True) -> DataFrame:
    """Per project pair: n_hits, gap1, gap2 (genome length over the root of the hits) and ``gaps``, the pairs of gaps
    to search by: half of the greatest, halved as long as both sides of the last are 2000 or more; strict leaves the
    first out if there are more than two."""
    length = lambda k: groups.groupBy(F.col("proj_idx").alias(f"proj{k}_idx")).agg(F.sum("length").cast("long").alias(f"length{k}"))
    rows = hits.groupBy("proj1_idx", "proj2_idx").agg(F.count(F.lit(1)).alias("n_hits")).join(length(1), "proj1_idx").join(length(2), "proj2_idx")
    for k in (1, 2):
        rows = rows.withColumn(f"gap{k}", F.floor(F.col(f"length{k}") / F.sqrt("n_hits")).cast("long"))
    halved = F.expr("transform(sequence(1, 40), k -> struct(shiftright(gap1, k) AS g1, shiftright(gap2, k) AS g2))")
    rows = rows.withColumn("all_gaps", halved)
    long_enough = F.expr(f"filter(all_gaps, x -> x.g1 >= {2 * MIN_GAP} AND x.g2 >= {2 * MIN_GAP})")
    rows = rows.withColumn("gaps", F.slice("all_gaps", F.lit(1), F.size(long_enough) + 1))
    if strict:
        rows = rows.withColumn("gaps", F.when(F.size("gaps") > 2, F.slice("gaps", 2, 40)).otherwise(F.col("gaps")))
    return rows.select("proj1_idx", "proj2_idx", "n_hits", "gap1", "gap2", "gaps")


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) <= 2 or x.std() == 0 or y.std() == 0:
        return 0.0
    return float(np.clip(np.corrcoef(x, y)[0, 1], -1, 1))


def accepted_case(n: int, r1: float, r2: float, space1: float, space2: float, cut: Cutoffs) -> str:
    """Case A to D of a chain of ``n`` hits, or '': correlations ``r1`` of the chain and ``r2`` of all hits in its box
    against limits that loosen with size; case A also limits the mean distance of its hits on each side."""
    m, r1, r2 = cut.mindots, abs(r1), abs(r2)
    first = CHAIN_R[0] if cut.strict else LOOSE_A
    if n >= m and space1 <= cut.gap1 / 15 and space2 <= cut.gap2 / 15 and r1 >= first and r2 >= BOX_R[0]:
        return "A"
    for case, least, c1, c2 in zip("BCD", (m, 3 * m // 2, 2 * m), CHAIN_R[1:], BOX_R[1:], strict=True):
        if n >= least and r1 >= c1 and r2 >= c2:
            return case
    return ""


def acceptable(chain: list[int], x: np.ndarray, y: np.ndarray, cut: Cutoffs, same: bool | None) -> bool:
    """Whether a chain passes; with orientation on, its direction must not contradict the strands."""
    n = len(chain)
    if n < cut.mindots:
        return False
    cx, cy = x[chain], y[chain]
    r1 = correlation(cx, cy)
    if cut.orient and same is not None and (r1 < 0 if same else r1 > 0):
        return False
    box = (x >= cx.min()) & (x <= cx.max()) & (y >= cy.min()) & (y <= cy.max())
    return accepted_case(n, r1, correlation(x[box], y[box]), (cx.max() - cx.min()) // n, (cy.max() - cy.min()) // n, cut) != ""


def search_blocks(x: np.ndarray, y: np.ndarray, cut: Cutoffs, same: bool | None) -> list[list[int]]:
    """For each gap of the list, from the greatest, while a good chain exists at it: bisection between it and the gap
    before finds (to within 1000) the greatest that has one; all good chains at that gap are taken, one by one, and
    their hits used up. A chain that is not good is passed over, with its hits, until the look ends."""
    free, found = np.ones(len(x), bool), []
    search = ChainSearch(x, y, (cut.gap1, cut.gap2))
    good: dict[tuple[int, ...], bool] = {}

    def good_chains(gap: tuple[int, int]) -> Iterator[list[int]]:
        for chain in search.chains(free, gap):
            key = tuple(chain)
            if key not in good:  # a chain is good or not whatever is free
                good[key] = acceptable(chain, x, y, cut, same)
            if good[key]:
                yield chain

    def has_good(gap: tuple[int, int]) -> bool:
        return next(good_chains(gap), None) is not None

    for k, gap in enumerate(cut.gaps):
        while has_good(gap):
            low, high = gap, cut.gaps[k - 1] if k else gap
            while high[0] - low[0] > MIN_GAP and high[1] - low[1] > MIN_GAP:
                mid = ((low[0] + high[0]) // 2, (low[1] + high[1]) // 2)
                if has_good(mid):
                    low = mid
                else:
                    high = mid
            for chain in list(good_chains(low)):
                found.append(chain)
                free[chain] = False
    return found


@dataclass
class Block:
    """Hits of a block (row numbers), its box, and whether its hits run on the same strand (None: mixed)."""

    hits: list[int]
    box: tuple[int, int, int, int]
    same: bool | None


def fits(big: Block, small: Block, num: np.ndarray, y: np.ndarray, gap2: int) -> bool:
    """Whether a small block lies near its neighbours in a big one: in side-1 order its first (last) hit and the hit of
    ``big`` before (after) it are closer on side 2 than half the small block's hits times the gap, within FIT; one
    end is enough, and an end without a neighbour fits."""
    near = min(max((len(small.hits) + 1) // 2 * gap2, FIT[0]), FIT[1])
    own, of = sorted(big.hits, key=lambda k: num[k]), sorted(small.hits, key=lambda k: num[k])
    order = num[own]
    after = lambda k: next((i for i in range(1, len(own)) if order[i] > num[k]), None)
    top, bottom = after(of[0]), after(of[-1])
    return top is None or bottom is None or abs(y[of[0]] - y[own[top - 1]]) < near or abs(y[of[-1]] - y[own[bottom]]) < near


def merge_to_fixpoint(blocks: list[Block], joins: Callable[[Block, Block], bool], orient: bool) -> list[Block]:
    """Blocks that ``joins`` links, directly or through others, become one, again and again until none is linked."""
    while True:
        parent = list(range(len(blocks)))

        def top(k: int, parent: list[int] = parent) -> int:
            while parent[k] != k:
                k = parent[k]
            return k

        for i, a in enumerate(blocks):
            for j in range(i + 1, len(blocks)):
                if not (orient and a.same != blocks[j].same) and joins(a, blocks[j]):
                    x, y = sorted((top(i), top(j)))
                    parent[y] = x
        groups: dict[int, list[Block]] = {}
        for k, b in enumerate(blocks):
            groups.setdefault(top(k), []).append(b)
        if len(groups) == len(blocks):
            return blocks
        blocks = [
            Block(list(dict.fromkeys(h for b in g for h in b.hits)), (min(b.box[0] for b in g), max(b.box[1] for b in g), min(b.box[2] for b in g), max(b.box[3] for b in g)), g[0].same)
            for g in groups.values()
        ]


def contained(a: Block, b: Block) -> bool:
    """On each side one box holds the other; which one may differ between the sides."""
    return all((a.box[k] <= b.box[k] and b.box[k + 1] <= a.box[k + 1]) or (b.box[k] <= a.box[k] and a.box[k + 1] <= b.box[k + 1]) for k in (0, 2))


def close(a: Block, b: Block, gap: tuple[int, int]) -> bool:
    return all(max(a.box[k], b.box[k]) - min(a.box[k + 1], b.box[k + 1]) <= gap[k // 2] for k in (0, 2))


def merge_blocks(blocks: list[Block], num: np.ndarray, y: np.ndarray, cut: Cutoffs, mode: int) -> list[Block]:
    """Blocks of one chromosome pair: first those contained in each other are merged, where one of the two has
    ``mindots`` hits and the other, if it has fewer, fits; then in mode 1 those of ``mindots`` hits that overlap, in
    mode 2 those within the first gap too."""
    m = cut.mindots
    gap = cut.gaps[0] if cut.gaps else (0, 0)

    def inside(a: Block, b: Block) -> bool:
        small, big = (a, b) if len(a.hits) < len(b.hits) else (b, a)
        if len(big.hits) < m or not contained(a, b):
            return False
        return len(small.hits) >= m or fits(big, small, num, y, gap[1])

    blocks = merge_to_fixpoint(blocks, inside, cut.orient)
    if mode:
        reach = gap if mode == 2 else (0, 0)
        blocks = merge_to_fixpoint(blocks, lambda a, b: min(len(a.hits), len(b.hits)) >= m and close(a, b, reach), cut.orient)
    return blocks


#: Columns of the cutoffs, as the hits carry them into the search.
_CUT = ["gap1", "gap2", "gaps"]


def _cut_of(row: object, mindots: int, strict: bool, orient: bool) -> Cutoffs:
    gaps = [tuple(map(int, g.split(":"))) for g in row["gaps"].split()]
    return Cutoffs(int(row["gap1"]), int(row["gap2"]), mindots, strict, orient, gaps)


def _limits(cutoffs: DataFrame) -> DataFrame:
    """The limits of each project pair, its list of gaps as one text: cheaper to carry with each hit than a list."""
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat_ws(":", g["g1"].cast("string"), g["g2"].cast("string"))), " ")
    return cutoffs.select("proj1_idx", "proj2_idx", "gap1", "gap2", gaps.alias("gaps"))


def search_pieces(hits: DataFrame, cutoffs: DataFrame, apart: bool = True) -> DataFrame:
    """Hits with midpoints x and y, the limits of their project pair, ``part`` (strand class, if searched ``apart``) and
    ``piece``: along side 2 of a chromosome pair, hits further apart than the greatest gap are in different pieces.
    No chain and no chain's box crosses pieces, so each can be searched alone."""
    same = same_strand(F.col("strand"))
    keys = ["grp1_idx", "grp2_idx", "part"]
    rows = hits.join(_limits(cutoffs), ["proj1_idx", "proj2_idx"]).select(
        "hit_idx", "grp1_idx", "grp2_idx", midpoint(F.col("start1"), F.col("end1")).cast("long").alias("x"), midpoint(F.col("start2"), F.col("end2")).cast("long").alias("y"),
        same.alias("same"), (F.when(same, 1).otherwise(2) if apart else F.lit(0)).alias("part"), *_CUT,
    )
    w = Window.partitionBy(*keys).orderBy("y", "x", "hit_idx")
    new = F.when(F.col("y") - F.lag("y").over(w) <= F.col("gap2"), 0).otherwise(1)
    return rows.withColumn("__new", new).withColumn("piece", F.sum("__new").over(w)).drop("__new")


#: Tasks of the search. Few bytes are much work there, so pieces are not put together by size.
SEARCHED = 192


def _per_piece(rows: DataFrame, work: Callable, kinds: str) -> DataFrame:
    keys = ["grp1_idx", "grp2_idx", "part", "piece"]
    return rows.repartition(SEARCHED, *keys).groupBy(*keys).applyInPandas(work, kinds)


def _sorted_piece(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, bool | None]:
    rows = pdf.sort_values(["y", "x", "hit_idx"], ignore_index=True)
    return rows, rows["x"].to_numpy(), rows["y"].to_numpy(), {0: None, 1: True, 2: False}[int(rows["part"].iloc[0])]


def _listed(rows: pd.DataFrame, chains: list[list[int]]) -> pd.DataFrame:
    out = [(int(rows["hit_idx"][i]), n + 1) for n, b in enumerate(chains) for i in b]
    made = pd.DataFrame(out, columns=["hit_idx", "chain"]).astype("int64")
    for c in ("grp1_idx", "grp2_idx", "part", "piece"):
        made[c] = int(rows[c].iloc[0])
    return made[["hit_idx", "grp1_idx", "grp2_idx", "part", "piece", "chain"]]


_CHAINS = "hit_idx long, grp1_idx int, grp2_idx int, part int, piece long, chain long"


def chain_hits(pieces: DataFrame) -> DataFrame:
    """The best chain of each piece of :func:`search_pieces` at its first gap, whether good or not."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, x, y, _ = _sorted_piece(pdf)
        cut = _cut_of(rows.iloc[0], 0, True, False)
        chain = best_chain(x, y, np.ones(len(x), bool), (cut.gap1, cut.gap2), cut.gaps[0])
        return _listed(rows, [chain] if chain else [])

    return _per_piece(pieces, work, _CHAINS)


def gap_search(pieces: DataFrame, mindots: int = 7, strict: bool = True, orient: bool = False) -> DataFrame:
    """The hits of all good chains of each piece, numbered by ``chain`` as found; see :func:`search_blocks`. The
    bisection for a gap sees its own piece only, so distant pieces of a chromosome pair don't share one gap."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, x, y, same = _sorted_piece(pdf)
        return _listed(rows, search_blocks(x, y, _cut_of(rows.iloc[0], mindots, strict, orient), same))

    return _per_piece(pieces, work, _CHAINS)


def accept_blocks(hits: DataFrame, block_hits: DataFrame, cutoffs: DataFrame, mindots: int = 7, strict: bool = True, width: int = 100_000) -> DataFrame:
    """Given blocks judged as chains: (block_idx, n, r1 of its hits, r2 of all hits of its chromosome pair in its box
    of midpoints, mean distances space1 and space2, ``case`` A to D or '')."""
    rows = hits.select(
        "hit_idx", "proj1_idx", "proj2_idx", "grp1_idx", "grp2_idx", midpoint(F.col("start1"), F.col("end1")).cast("long").alias("x"), midpoint(F.col("start2"), F.col("end2")).cast("long").alias("y")
    )
    ends = [f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = rows.join(block_hits, "hit_idx").groupBy("block_idx", "proj1_idx", "proj2_idx", "grp1_idx", "grp2_idx").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("r1"), *ends)
    held = bin_join(rows.select("grp1_idx", "grp2_idx", "x", F.col("x").alias("x_end"), "y"), boxes.select("block_idx", "grp1_idx", "grp2_idx", "lo_x", "hi_x", "lo_y", "hi_y"), ["grp1_idx", "grp2_idx"], "x", "x_end", "lo_x", "hi_x", width)
    inside = held.filter(F.col("y").between(F.col("lo_y"), F.col("hi_y"))).groupBy("block_idx").agg(pearson(F.col("x"), F.col("y")).alias("r2"))
    out = boxes.join(inside, "block_idx").join(cutoffs.select("proj1_idx", "proj2_idx", "gap1", "gap2"), ["proj1_idx", "proj2_idx"])
    out = out.withColumns({f"space{k}": F.floor((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / F.col("n")).cast("long") for k, c in ((1, "x"), (2, "y"))})
    a, b = F.abs("r1"), F.abs("r2")
    ok = lambda k, least, c1: (F.col("n") >= least) & (a >= c1) & (b >= BOX_R[k])
    tight = (F.col("space1") <= F.col("gap1") / 15) & (F.col("space2") <= F.col("gap2") / 15)
    case = F.when(tight & ok(0, mindots, CHAIN_R[0] if strict else LOOSE_A), "A")
    for k, name, least in ((1, "B", mindots), (2, "C", 3 * mindots // 2), (3, "D", 2 * mindots)):
        case = case.when(ok(k, least, CHAIN_R[k]), name)
    return out.select("block_idx", "n", "r1", "r2", "space1", "space2", case.otherwise("").alias("case"))


def merge_rectangles(boxes: DataFrame, keys: list[str], width: int = 100_000) -> DataFrame:
    """(id, merged): boxes of equal ``keys`` that lie within gap1 and gap2 of each other on both sides are one, again with
    the box around them, until no two are so near; ``merged`` is the smallest id. ``boxes``: keys, id, lo1, hi1, lo2, hi2,
    gap1, gap2. Each round is a join by bins of side 1 and the components of its pairs."""
    now, home = written(boxes.select(*keys, "id", "lo1", "hi1", "lo2", "hi2", "gap1", "gap2"), "boxes"), None
    while True:
        a = now.select(*keys, "id", "lo1", (F.col("hi1") + F.col("gap1")).alias("to1"), "lo2", (F.col("hi2") + F.col("gap2")).alias("to2"))
        b = a.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("id", "lo1", "to1", "lo2", "to2")])
        near = bin_join(a, b, keys, "lo1", "to1", "b_lo1", "b_to1", width).filter("id < b_id and lo2 <= b_to2 and b_lo2 <= to2")
        near = written(near.select("id", F.col("b_id").alias("other")), "near-boxes")
        if near.isEmpty():
            return boxes.select("id", F.col("id").alias("merged")) if home is None else home
        parts = connected_components(near, "id", "other").select(F.col("node").alias("id"), "component")
        step = now.join(parts, "id", "left").withColumn("merged", F.coalesce("component", "id"))
        now = written(step.groupBy(*keys, "merged").agg(F.min("lo1").alias("lo1"), F.max("hi1").alias("hi1"), F.min("lo2").alias("lo2"), F.max("hi2").alias("hi2"), F.max("gap1").alias("gap1"), F.max("gap2").alias("gap2")).withColumnRenamed("merged", "id"), "boxes")
        if home is None:
            home = step.select("id", "merged")
        else:
            home = home.join(parts.withColumnRenamed("id", "merged"), "merged", "left").select("id", F.coalesce("component", "merged").alias("merged"))
        home = written(home, "merged-boxes")


def chain_and_set_hits(hits: DataFrame, cutoffs: DataFrame, mindots: int = 7, strict: bool = True, orient: bool = False) -> DataFrame:
    """Hits of good chains (``piece`` and ``chain`` from :func:`gap_search`, else 0) and, where hits carry ``runnum`` and the
    search is strict without orientation, of collinear sets (``run``, else 0), numbered by side 1 first."""
    apart = strict or orient
    found = written(gap_search(search_pieces(hits, cutoffs, apart), mindots, strict, orient), "chains")
    rows = number_hits(hits).join(found.select("hit_idx", "piece", "chain"), "hit_idx", "left").join(_limits(cutoffs), ["proj1_idx", "proj2_idx"])
    part = F.when(same_strand(F.col("strand")), 1).otherwise(2) if apart else F.lit(0)
    run = F.col("runnum").cast("long") if "runnum" in hits.columns and strict and not orient else F.lit(0).cast("long")
    return rows.filter((F.col("chain").isNotNull()) | (run > 0)).select(
        "hit_idx", "grp1_idx", "grp2_idx", "hitnum", "start1", "end1", "start2", "end2", part.alias("part"), run.alias("run"),
        F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("chain", F.lit(0)).alias("chain"), *_CUT,
    )


def small_blocks(rows: DataFrame) -> DataFrame:
    """(hit_idx, small) of :func:`chain_and_set_hits`: the hits of collinear sets (``run`` over 0 within chromosome pair and
    ``part``) that have no hit in a chain, by the block that such sets of one strand make up where they lie within the
    first gap of ``gaps``."""
    own = ["grp1_idx", "grp2_idx", "part", "run"]
    first = F.split(F.split("gaps", " ")[0], ":")
    sets = rows.filter("run > 0").groupBy(*own).agg(
        F.min("hit_idx").alias("id"), F.max("chain").alias("chain"), F.min("start1").alias("lo1"), F.max("end1").alias("hi1"), F.min("start2").alias("lo2"), F.max("end2").alias("hi2"), F.max("gaps").alias("gaps"),
    )
    sets = written(sets.filter("chain = 0").withColumns({f"gap{k}": F.coalesce(F.get(first, F.lit(k - 1)).try_cast("long"), F.lit(0)) for k in (1, 2)}), "small-sets")
    merged = merge_rectangles(sets, own[:3])
    return rows.select("hit_idx", *own).join(sets.join(merged, "id").select(*own, F.col("merged").alias("small")), own).select("hit_idx", "small")


def synteny_blocks(hits: DataFrame, cutoffs: DataFrame, mindots: int = 7, strict: bool = True, orient: bool = False, merge: int = 0, prune: bool = True) -> DataFrame:
    """(hit_idx, grp1_idx, grp2_idx, block): the hits of the blocks of each chromosome pair, numbered by their boxes.

    Strict and oriented searches run the strands apart. If hits carry ``runnum`` (collinear set, 0 for none) and
    the search is strict without orientation, sets that lie partly in a block add their other hits to it; sets
    without a hit in any block become small blocks, merged among themselves on Spark (:func:`small_blocks`).
    Then blocks merge by :func:`merge_blocks`, and strict drops those under ``mindots`` hits (``prune``).

    The search is a task per piece (:func:`search_pieces`); the hits of blocks and of sets then meet per
    chromosome pair. Hits are numbered by side 1 first.
    """
    rows = written(chain_and_set_hits(hits, cutoffs, mindots, strict, orient), "block-hits")
    rows = rows.join(small_blocks(rows), "hit_idx", "left").fillna(-1, ["small"]) if "runnum" in hits.columns and strict and not orient else rows.withColumn("small", F.lit(-1))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(y=(pdf["start2"] + pdf["end2"]) // 2).sort_values(["y", "hit_idx"], ignore_index=True)
        s1, e1, s2, e2, num, y = (rows[c].to_numpy() for c in ("start1", "end1", "start2", "end2", "hitnum", "y"))
        cut = _cut_of(rows.iloc[0], mindots, strict, orient)

        def block(own: list[int]) -> Block:
            side = {0: None, 1: True, 2: False}[int(rows["part"][own[0]])]
            return Block(own, (int(s1[own].min()), int(e1[own].max()), int(s2[own].min()), int(e2[own].max())), side)

        held = [list(g.index) for _, g in rows[rows["chain"] > 0].groupby(["part", "piece", "chain"])]
        home = {k: n for n, b in enumerate(held) for k in b}
        for _, own in rows[(rows["run"] > 0) & (rows["small"] < 0)].groupby(["part", "run"]):
            into = next(home[k] for k in own.index if k in home)
            held[into] += [k for k in own.index if k not in home]
        small = [block(list(g.index)) for _, g in rows[rows["small"] >= 0].groupby("small")]
        blocks = merge_blocks(sorted([*map(block, held), *small], key=lambda b: b.box), num, y, cut, merge)
        if strict and prune:
            blocks = [b for b in blocks if len(b.hits) >= mindots]
        out = [(int(rows["hit_idx"][i]), n + 1) for n, b in enumerate(sorted(blocks, key=lambda b: b.box)) for i in b.hits]
        made = pd.DataFrame(out, columns=["hit_idx", "block"]).astype("int64")
        return made.assign(grp1_idx=int(rows["grp1_idx"].iloc[0]), grp2_idx=int(rows["grp2_idx"].iloc[0]))[["hit_idx", "grp1_idx", "grp2_idx", "block"]]

    return rows.groupBy("grp1_idx", "grp2_idx").applyInPandas(work, "hit_idx long, grp1_idx int, grp2_idx int, block long")


def finish_blocks(hits: DataFrame, block_hits: DataFrame) -> DataFrame:
    """Blocks from their hits: intervals, hits, correlation of midpoints, mean gap per side (distance of each start
    from the end before, in start order), mean identity, and number by start1, end1 per chromosome pair."""
    rows = hits.join(block_hits, "hit_idx")
    gap = lambda k: F.abs(F.lead(f"start{k}").over(Window.partitionBy("block_idx").orderBy(f"start{k}", f"end{k}", "hit_idx")) - F.col(f"end{k}"))
    rows = rows.withColumn("gap1", gap(1)).withColumn("gap2", gap(2)).withColumn("x", midpoint(F.col("start1"), F.col("end1"))).withColumn("y", midpoint(F.col("start2"), F.col("end2")))
    out = rows.groupBy("block_idx", "proj1_idx", "proj2_idx", "grp1_idx", "grp2_idx").agg(
        F.min("start1").alias("start1"), F.max("end1").alias("end1"), F.min("start2").alias("start2"), F.max("end2").alias("end2"), F.count(F.lit(1)).alias("score"),
        pearson(F.col("x"), F.col("y")).alias("corr"), F.avg("gap1").alias("avg_gap1"), F.avg("gap2").alias("avg_gap2"), F.round(F.avg("pctid"), 1).alias("avg_pctid"),
    )
    return out.withColumn("blocknum", F.row_number().over(Window.partitionBy("grp1_idx", "grp2_idx").orderBy("start1", "end1", "block_idx")))


def block_genes(blocks: DataFrame, genes: DataFrame, block_hits: DataFrame, hit_annot: DataFrame) -> DataFrame:
    """Per block and side: genes that overlap its interval by two bases or more, and the share of them with a hit of the block.

    Genes are counted, not paired with blocks: those that start before the block's end less those that end by its start, as
    running counts along the chromosome. Only the genes of a block's own hits are looked at one by one."""
    spans = genes.select("annot_idx", "grp_idx", "g_start", "g_end").filter("g_start < g_end")
    sides = [
        blocks.select("block_idx", F.lit(k).alias("side"), F.col(f"grp{k}_idx").alias("grp_idx"), F.col(f"start{k}").alias("b_start"), F.col(f"end{k}").alias("b_end")) for k in (1, 2)
    ]
    both = sides[0].union(sides[1]).filter("b_start < b_end")
    # at one place: ends of genes, then starts of blocks, ends of blocks, starts of genes
    none = [F.lit(None).cast(t).alias(c) for c, t in (("block_idx", blocks.schema["block_idx"].dataType), ("side", "int"))]
    event = lambda rows, at, kind, of: rows.select("grp_idx", F.col(at).cast("long").alias("at"), F.lit(kind).alias("kind"), *of)
    own = ["block_idx", "side"]
    events = event(spans, "g_end", 0, none).union(event(both, "b_start", 1, own)).union(event(both, "b_end", 2, own)).union(event(spans, "g_start", 3, none))
    key, order = ["grp_idx"], ["at", "kind"]
    seen = carried(deal(events, key, order), key, order, ended=("sum", (F.col("kind") == 0).cast("int"), "upto"), begun=("sum", (F.col("kind") == 3).cast("int"), "upto"))
    signed = F.when(F.col("kind") == 2, F.coalesce("begun", F.lit(0))).otherwise(-F.coalesce("ended", F.lit(0)))
    counts = seen.filter("kind in (1, 2)").groupBy("block_idx", "side").agg(F.sum(signed).alias("n_genes")).filter("n_genes > 0")
    held = block_hits.join(hit_annot, "hit_idx").select("block_idx", "side", "annot_idx").distinct()
    inside = F.greatest("b_start", "g_start") < F.least("b_end", "g_end")
    hit = held.join(both, ["block_idx", "side"]).join(spans, ["annot_idx", "grp_idx"]).filter(inside).groupBy("block_idx", "side").agg(F.count(F.lit(1)).alias("hit"))
    return counts.join(hit, ["block_idx", "side"], "left").select("block_idx", "side", "n_genes", (F.coalesce("hit", F.lit(0)) / F.col("n_genes")).alias("share"))


def drop_diagonal_blocks(blocks: DataFrame, hits: DataFrame, block_hits: DataFrame) -> DataFrame:
    """Self-comparison: blocks of one chromosome are dropped if both sides overlap by 0.8 of side 2's length or
    more, or by 0.4 unless hits with two genes are over twice the others."""
    two = block_hits.join(hits, "hit_idx").groupBy("block_idx").agg(F.sum((F.col("gene_overlap") == 2).cast("int")).alias("two"), F.sum((F.col("gene_overlap") != 2).cast("int")).alias("rest"))
    share = F.greatest(F.lit(0), F.least("end1", "end2") - F.greatest("start1", "start2") + 1) / (F.col("end2") - F.col("start2") + 1)
    near = (F.col("grp1_idx") == F.col("grp2_idx")) & ((share >= 0.8) | ((share >= 0.4) & ~(F.col("two") > 2 * F.col("rest"))))
    return blocks.join(two, "block_idx").filter(~near).drop("two", "rest")


def strict_prune(blocks: DataFrame, mindots: int = 7) -> DataFrame:
    return blocks.filter(F.col("score") >= mindots)


def mirror_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks and, for each, its mirror with sides exchanged and gaps of 0."""
    turned = swap_sides(blocks)
    for c in ("avg_gap1", "avg_gap2"):
        if c in blocks.columns:
            turned = turned.withColumn(c, F.lit(0).cast(blocks.schema[c].dataType))
    return blocks.withColumn("mirror", F.lit(False)).unionByName(turned.withColumn("mirror", F.lit(True)))


def order_contigs(blocks: DataFrame, contigs: DataFrame) -> DataFrame:
    """Each contig (side 1) on the chromosome of its best block: position, flip if the correlation is negative,
    place in order; contigs without a block have chromosome null ('UNK') and come last."""
    best = Window.partitionBy("grp1_idx").orderBy(F.desc("score"), F.desc("block_idx"))
    top = blocks.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select(F.col("grp1_idx").alias("grp_idx"), F.col("grp2_idx").alias("chr"), F.col("start2").alias("at"), "score", (F.col("corr") < 0).alias("flip"))
    rows = contigs.select("grp_idx").join(top, "grp_idx", "left").fillna({"flip": False})
    return global_rank(rows, [F.asc_nulls_last("chr"), F.asc("at"), F.desc("score"), F.asc("grp_idx")], "place")


def build_ordered_sequence(order: DataFrame, seqs: DataFrame, spacer: int = 100) -> DataFrame:
    """Contigs of ``order`` joined per chromosome with ``spacer`` Ns, flipped ones as reverse complement:
    (chr, grp_idx, place, offset (from 1), piece); pieces stay rows, so no task holds a chromosome."""
    rows = order.filter("chr is not null").join(seqs, "grp_idx")
    w = Window.partitionBy("chr").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("seq") + spacer).over(w), F.lit(0)) + 1
    return rows.select("chr", "grp_idx", "place", offset.cast("long").alias("offset"), F.when(F.col("flip"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("piece"))
