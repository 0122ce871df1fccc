"""Small cases made by hand, and files."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from genoloom.functions import intervals as iv
from genoloom.operators import annotation as an
from genoloom.operators import blocks as bl
from genoloom.operators import chaining as ch
from genoloom.operators import cluster_bins as cb
from genoloom.operators import cluster_pairs as cp
from genoloom.operators import collinear as co
from genoloom.operators import conversion as cv
from genoloom.operators import hits as hi
from genoloom.operators import ordering as od
from genoloom.operators import query as qu
from genoloom.operators import reports as rp
from genoloom.operators.graph import connected_components
from genoloom.operators.lineage import written
from genoloom.operators.ordering import global_rank
from genoloom.sources import text as tx


def test_gene_numbers_nested_touching_equal(spark):
    rows = [(1, 100, 200), (2, 120, 150), (3, 200, 300), (4, 400, 500), (5, 400, 450), (6, 501, 600)]
    df = spark.createDataFrame([(a, 1, s, e) for a, s, e in rows], "annot_idx long, grp_idx int, g_start int, g_end int")
    got = {r["annot_idx"]: r["genenum"] for r in an.number_genes(df).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 3, 6: 4}


def test_suffix_runs_past_z(spark):
    df = spark.createDataFrame([(k, 1, 100 + k, 5000 - k) for k in range(1, 30)], "annot_idx long, grp_idx int, g_start int, g_end int")
    ex = spark.createDataFrame([], "gene_idx long, e_start int, e_end int")
    got = {r["annot_idx"]: r["suffix"] for r in an.gene_tags(an.number_genes(df), ex).collect()}
    assert got[1] == "a" and got[26] == "z" and got[27] == "a2" and got[29] == "c2"


def _slow_runs(rank1, rank2, step):
    """The rule of collinear runs over a whole chromosome pair and strand class, hit by hit."""
    n, run, number = len(rank1), [0] * len(rank1), 0
    ended = False
    for first in range(n):
        if run[first] or ended:
            continue
        members, ended = [first], True
        for j in range(first + 1, n):
            d1, d2 = rank1[j] - rank1[members[-1]], step * (rank2[j] - rank2[members[-1]])
            if run[j]:
                continue
            if (d1, d2) == (1, 1):
                members.append(j)
            elif d1 > 1 and d2 != 1:
                ended = False
                break
        if len(members) > 1:
            number += 1
            for j in members:
                run[j] = number
    return run


def test_collinear_scan_skips_and_stops():
    run, size = co.scan_runs([1, 2, 2, 3, 9, 10, 30], [1, 5, 2, 3, 8, 9, 1], 1, -1)
    assert run == [1, 0, 1, 1, 2, 2, 0] and size == [3, 0, 3, 3, 2, 2, 0]
    # opposite strands: a step of -1 on side 2 goes on; where side 1 goes too far it doesn't end a scan, any other does
    assert co.scan_runs([5, 7, 6], [9, 8, 8], -1, -1)[0] == [1, 0, 1]
    assert co.scan_runs([5, 7, 6, 90], [9, 10, 8, 1], -1, -1)[0] == [0, 0, 0, 0]
    # a hit of a set ends no scan
    assert co.scan_runs([1, 1, 2, 4, 3, 2, 9], [1, 7, 2, 4, 3, 8, 1], 1, -1)[0] == _slow_runs([1, 1, 2, 4, 3, 2, 9], [1, 7, 2, 4, 3, 8, 1], 1)
    # the walk ends with the first scan that comes to the last hit
    assert co.scan_runs([1, 2, 2, 3], [1, 2, 8, 9], 1, -1)[0] == [1, 1, 0, 0] == _slow_runs([1, 2, 2, 3], [1, 2, 8, 9], 1)


@pytest.mark.parametrize("step, probed", [(1, 24), (-1, 24), (1, 0), (-1, 1)])
def test_scan_equals_a_slow_walk(monkeypatch, step, probed):
    monkeypatch.setattr(co, "PROBED", probed)
    rng = np.random.default_rng(10 * step + probed + 50)
    for _ in range(150):
        n = int(rng.integers(1, 90))
        rank1 = np.sort(rng.integers(1, n // 2 + 3, n)) + rng.integers(0, 3, n)
        rank2 = (step * rank1 + 50 + rng.integers(-1, 2, n)).tolist()
        assert co.scan_runs(rank1.tolist(), rank2, step, -1)[0] == _slow_runs(rank1.tolist(), rank2, step)


def test_chain_needs_seven_hits():
    cut = bl.Cutoffs(10_000, 10_000, 7, True, False, [(5000, 5000)])
    x = np.arange(8) * 600
    assert bl.search_blocks(x[:6], x[:6], cut, True) == []
    assert [len(b) for b in bl.search_blocks(x, x, cut, True)] == [8]
    assert bl.search_blocks(np.array([]), np.array([]), cut, True) == []


def _slow_chain(pts, far, gap):
    """The chain rule point by point."""
    best = []
    for i, (x, y) in enumerate(pts):
        top, prev = 0, None
        for j in range(i - 1, -1, -1):
            u, v = pts[j]
            if y - v > far[1]:
                break
            if abs(x - u) <= far[0]:
                value = 1 + best[j][0] - int(abs(x - u) / gap[0] + abs(y - v) / gap[1])
                if value > top:
                    top, prev = value, j
        best.append((top, best[prev][1] + 1, prev) if prev is not None else (1, 1, None))
    ends = [i for i, b in enumerate(best) if b[2] is not None]
    if not ends:
        return []
    at, out = max(ends, key=lambda i: (best[i][0], best[i][1], -i)), []
    while at is not None:
        out.append(at)
        at = best[at][2]
    return out[::-1] if len(out) >= 3 else []


def test_best_chain_against_brute_force():
    rng = np.random.default_rng(5)
    for k in range(60):
        pts = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60 + 10 * k, (40, 2))}, key=lambda p: (p[1], p[0]))
        x, y = (np.array([p[i] for p in pts]) for i in (0, 1))
        far, gap = (40 + k, 30 + k), (10 + k // 2, 8 + k)
        assert bl.best_chain(x, y, np.ones(len(x), bool), far, gap) == _slow_chain(pts, far, gap)


@pytest.mark.parametrize("listed", [20_000_000, 0])
def test_chains_one_after_the_other(monkeypatch, listed):
    """Each chain in turn is the best of what those before it have left."""
    monkeypatch.setattr(ch, "LISTED", listed)
    rng = np.random.default_rng(8 + listed)
    several = 0
    for k in range(40):
        pts = sorted(((int(a), int(b)) for a, b in rng.integers(0, 80 + 12 * k, (70, 2))), key=lambda p: (p[1], p[0]))
        x, y = (np.array([p[i] for p in pts]) for i in (0, 1))
        far, gap = (40 + k, 30 + k), (6 + k // 2, 5 + k)
        free = rng.random(len(pts)) < 0.9
        left, want = [i for i in range(len(pts)) if free[i]], []
        while chain := _slow_chain([pts[i] for i in left], far, gap):
            want.append([left[i] for i in chain])
            left = [i for i in left if i not in want[-1]]
        assert list(ch.ChainSearch(x, y, far).chains(free, gap)) == want
        several += len(want) > 3
    assert several > 20


def _slow_search(pts, cut, same):
    """The search for blocks by the rule: halving gaps, bisection, all good chains at the gap found."""
    x, y = (np.array([p[i] for p in pts], np.int64) for i in (0, 1))
    left, found = list(range(len(pts))), []

    def chains(gap):
        free, out = list(left), []
        while chain := _slow_chain([pts[i] for i in free], (cut.gap1, cut.gap2), gap):
            chain = [free[i] for i in chain]
            free = [i for i in free if i not in chain]
            if bl.acceptable(chain, x, y, cut, same):
                out.append(chain)
        return out

    for k, low in enumerate(cut.gaps):
        while chains(low):
            a, b = low, cut.gaps[max(0, k - 1)]
            while b[0] - a[0] > 1000 and b[1] - a[1] > 1000:
                mid = ((a[0] + b[0]) // 2, (a[1] + b[1]) // 2)
                a, b = (mid, b) if chains(mid) else (a, mid)
            for chain in chains(a):
                found.append(chain)
                left = [i for i in left if i not in chain]
    return found


def _slow_merge(blocks, link):
    """blocks: sets of hits; those linked, also through others, become one, until no two are linked."""
    while True:
        groups = []
        for b in blocks:
            near = [g for g in groups if any(link(a, b) for a in g)]
            groups = [g for g in groups if g not in near] + [[b, *(a for g in near for a in g)]]
        if len(groups) == len(blocks):
            return blocks
        blocks = [frozenset().union(*g) for g in groups]


def _slow_blocks(hits, cut, merge, prune):
    """hits: of one chromosome pair, dicts with id, same, s1, e1, s2, e2, num, run. The rule of the whole block query."""
    mid = lambda h, k: (h[f"s{k}"] + h[f"e{k}"]) // 2
    by_id = {h["id"]: h for h in hits}
    blocks = []
    for same in (True, False):
        own = sorted((h for h in hits if h["same"] == same), key=lambda h: (mid(h, 2), mid(h, 1), h["id"]))
        blocks += [frozenset(own[i]["id"] for i in c) for c in _slow_search([(mid(h, 1), mid(h, 2)) for h in own], cut, same)]
    box = lambda b: [f(by_id[i][f"{n}{k}"] for i in b) for k in (1, 2) for f, n in ((min, "s"), (max, "e"))]
    near = lambda a, b, gap: all(max(box(a)[k], box(b)[k]) - min(box(a)[k + 1], box(b)[k + 1]) <= gap[k // 2] for k in (0, 2))
    gap, m = cut.gaps[0], cut.mindots
    small = []
    runs = {}
    for h in sorted(hits, key=lambda h: (mid(h, 2), h["id"])):
        if h["run"]:
            runs.setdefault((h["same"], h["run"]), []).append(h["id"])
    taken = {i: n for n, b in enumerate(blocks) for i in b}
    for own in runs.values():
        into = next((taken[i] for i in own if i in taken), None)
        if into is None:
            small.append(frozenset(own))
        else:
            blocks[into] |= {i for i in own if i not in taken}
    strand = lambda b: by_id[next(iter(b))]["same"]
    blocks += _slow_merge(small, lambda a, b: strand(a) == strand(b) and near(a, b, gap))

    def inside(a, b):
        few, many = sorted((a, b), key=len)
        p, q = box(a), box(b)
        if len(many) < m or not all((p[k] <= q[k] and q[k + 1] <= p[k + 1]) or (q[k] <= p[k] and p[k + 1] <= q[k + 1]) for k in (0, 2)):
            return False
        if len(few) >= m:
            return True
        reach = min(max((len(few) + 1) // 2 * gap[1], 300_000), 4_000_000)
        first, last = (by_id[f(few, key=lambda i: by_id[i]["num"])] for f in (min, max))
        order = sorted((by_id[i] for i in many), key=lambda h: h["num"])
        for end, side in ((first, 0), (last, 1)):
            k = next((k for k in range(1, len(order)) if order[k]["num"] > end["num"]), None)
            if k is None or abs(mid(end, 2) - mid(order[k - 1 + side], 2)) < reach:
                return True
        return False

    blocks = _slow_merge(blocks, inside)
    if merge:
        blocks = _slow_merge(blocks, lambda a, b: min(len(a), len(b)) >= m and near(a, b, gap if merge == 2 else (0, 0)))
    return {b for b in blocks if not prune or len(b) >= m}


@pytest.mark.parametrize("merge, prune", [(0, True), (0, False), (1, False), (2, True)])
def test_blocks_equal_the_slow_rule(spark, merge, prune):
    rng = np.random.default_rng(31)
    rows, pairs = [], {}
    for pair in range(3):
        own = []
        for line in range(6):
            a, b, same = int(rng.integers(0, 400_000)), int(rng.integers(0, 400_000)), bool(line % 2)
            for k in range(int(rng.integers(4, 14))):
                s1, s2 = a + 2500 * k + int(rng.integers(0, 900)), max(1, b + (2500 if same else -2500) * k + int(rng.integers(0, 900)))
                own.append((s1, s1 + 300, s2, s2 + 300, same))
        own += [(int(p), int(p) + 200, int(q), int(q) + 200, bool(s)) for p, q, s in zip(rng.integers(1, 450_000, 50), rng.integers(1, 450_000, 50), rng.integers(0, 2, 50), strict=True)]
        for s1, e1, s2, e2, same in own:
            rows.append((len(rows), 1, 2, pair + 1, 9, s1, e1, s2, e2, "+/+" if same else "+/-", int(rng.integers(1, 25)) if rng.random() < 0.4 else 0))
    hits = spark.createDataFrame(rows, "hit_idx long, proj1_idx int, proj2_idx int, grp1_idx int, grp2_idx int, start1 int, end1 int, start2 int, end2 int, strand string, runnum int")
    gaps = [(16_000, 18_000), (8000, 9000), (4000, 4500)]
    cutoffs = spark.createDataFrame([(1, 2, 40_000, 42_000, gaps)], "proj1_idx int, proj2_idx int, gap1 long, gap2 long, gaps array<struct<g1:long,g2:long>>")
    cut = bl.Cutoffs(40_000, 42_000, 7, True, False, gaps)
    for r in hi.number_hits(hits).collect():
        pairs.setdefault(r["grp1_idx"], []).append({"id": r["hit_idx"], "same": r["strand"] == "+/+", "s1": r["start1"], "e1": r["end1"], "s2": r["start2"], "e2": r["end2"], "num": r["hitnum"], "run": r["runnum"]})
    # pieces along side 2 are searched alone, so the slow rule gets them apart too: here each pair is one piece
    found = {}
    for r in bl.synteny_blocks(hits, cutoffs, merge=merge, prune=prune).collect():
        found.setdefault((r["grp1_idx"], r["block"]), set()).add(r["hit_idx"])
    want = {(pair, b) for pair, own in pairs.items() for b in _slow_blocks(own, cut, merge, prune)}
    assert {(pair, frozenset(b)) for (pair, _), b in found.items()} == want and len(want) > 2


def _block(hits, *box, same=True):
    return bl.Block(list(hits), box, same)


def test_blocks_merge_when_each_side_holds_or_is_held():
    cut = bl.Cutoffs(10_000, 10_000, 7, True, False, [(100, 100)])
    num = y = np.arange(40) * 10
    merged = lambda *b, mode=0: [len(x.hits) for x in bl.merge_blocks(list(b), num, y, cut, mode)]
    wide, tall = _block(range(8), 0, 1000, 400, 500), _block(range(8, 16), 100, 200, 0, 1000)
    assert merged(wide, tall) == [16]
    # two blocks under the least size don't merge; one of them merges with a large one that it fits
    few, fewer = _block([20, 21], 150, 180, 10, 20), _block([22], 160, 170, 12, 14)
    assert merged(few, fewer) == [2, 1] and merged(tall, few) == [10]
    far = np.where(np.arange(40) >= 20, 9_000_000, y)
    assert [len(x.hits) for x in bl.merge_blocks([_block([*range(8, 16), 30], 100, 200, 0, 1000), few], num, far - (np.arange(40) == 30) * 9_000_000, cut, 0)] == [9, 2]
    near = _block(range(30, 38), 1050, 2000, 560, 900)
    assert merged(wide, near) == [8, 8] and merged(wide, near, mode=1) == [8, 8] and merged(wide, near, mode=2) == [16]


def _synteny_hits(spark, rows):
    kinds = "hit_idx long, proj1_idx int, proj2_idx int, grp1_idx int, grp2_idx int, start1 int, end1 int, start2 int, end2 int, strand string, runnum int"
    return spark.createDataFrame([(h, 1, 2, 11, 21, a, a + 9, b, b + 9, "+/+", r) for h, a, b, r in rows], kinds)


def test_collinear_sets_make_and_extend_blocks(spark):
    line = [(k, 100 + k * 600, 100 + k * 600, 1 if k == 7 else 0) for k in range(8)]
    # set 1 has one hit in the block and one outside; set 2 lies far off
    hits = _synteny_hits(spark, [*line, (20, 90_000, 300_000, 1), (30, 900_000, 700_000, 2), (31, 901_000, 701_000, 2)])
    cut = spark.createDataFrame([(1, 2, 10_000, 10_000, [(5000, 5000)])], "proj1_idx int, proj2_idx int, gap1 long, gap2 long, gaps array<struct<g1: long, g2: long>>")
    blocks = lambda **k: sorted(tuple(sorted(r["h"])) for r in bl.synteny_blocks(hits, cut, **k).groupBy("block").agg(F.collect_list("hit_idx").alias("h")).collect())
    assert blocks(prune=False) == [(*range(8), 20), (30, 31)] and blocks() == [(*range(8), 20)]


def test_cutoffs_halve_until_both_sides_are_short(spark):
    hits = _synteny_hits(spark, [(k, 1, 1, 0) for k in range(4)])
    groups = spark.createDataFrame([(1, 30_000), (2, 50_000)], "proj_idx int, length long")
    (r,) = bl.synteny_cutoffs(hits, groups, strict=False).collect()
    assert (r["gap1"], r["gap2"], [tuple(g) for g in r["gaps"]]) == (15_000, 25_000, [(7500, 12_500), (3750, 6250), (1875, 3125)])
    assert len(bl.synteny_cutoffs(hits, groups).first()["gaps"]) == 2


def test_kept_types_take_no_place_in_a_pile(spark):
    rows = [(1, 1, "EE", 100), (2, 1, "EE", 99), (3, 1, "II", 90), (4, 1, "In", 85), (5, 1, "II", 84), (6, 1, "EE", 5), (7, 1, "II", 79)]
    df = spark.createDataFrame(rows, "hit_idx long, pile int, type string, length int")
    assert {r["hit_idx"] for r in cp.filter_piles(df).collect()} == {1, 2, 3, 4, 6}


def test_global_rank_over_ranges(spark):
    df = spark.createDataFrame([((k * 37) % 101, k % 3) for k in range(101)], "a int, b int")
    got = sorted((r["a"], r["place"]) for r in global_rank(df.repartition(5), [F.desc("a")], "place").collect())
    assert got == [(a, 101 - a) for a in range(101)] and global_rank(df.limit(0), [F.asc("a")], "place").count() == 0


def _slow_piles(rows, frac=0.4):
    """rows: (id, start, end); every cluster, in a pile or not, takes those after it that are in none."""
    rows = sorted(rows, key=lambda r: (r[1], -r[2], r[0]))
    pile = {}
    for k, (i, a, b) in enumerate(rows):
        for j, c, d in rows[k + 1 :]:
            shared = min(b, d) - max(a, c) + 1
            if j not in pile and shared > 0 and (shared > frac * (b - a + 1) or shared > frac * (d - c + 1)):
                pile[j] = pile.setdefault(i, i)
    return {i: pile.get(i, i) for i, _, _ in rows}


def _piles(spark, rows):
    df = spark.createDataFrame([(i, a, b, 1 + i % 2 if len(rows) > 50 else 1) for i, a, b in rows], "hit_idx long, start1 int, end1 int, grp1_idx int").withColumn("grp2_idx", F.lit(2))
    return {r["hit_idx"]: r["pile"] for r in cp.find_piles(df, 1).collect()}


def test_members_of_a_pile_take_others_in(spark):
    chain = [(1, 1, 100), (2, 50, 149), (3, 100, 199), (4, 400, 500), (5, 199, 300)]
    assert _piles(spark, chain) == _slow_piles(chain) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    # the first before it decides, even if it begins no pile of others
    mixed = [(1, 1, 10), (2, 8, 60), (3, 9, 12), (4, 20, 25), (5, 24, 70)]
    assert _piles(spark, mixed) == _slow_piles(mixed)


@pytest.mark.parametrize("compared, width", [(4096, 90), (3, 90), (4096, 1500)])
def test_piles_equal_a_slow_walk(spark, monkeypatch, compared, width):
    monkeypatch.setattr(cp, "COMPARED", compared)
    rng = np.random.default_rng(width + compared)
    rows = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(1, 6000, 400), rng.integers(5, width, 400), strict=True))]
    want = {i: p for g in (0, 1) for i, p in _slow_piles([r for r in rows if r[0] % 2 == g]).items()}
    found = _piles(spark, rows)
    assert found == want and 1 < len(set(found.values())) < 300


def test_components_chain_star_and_empty(spark):
    chain = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and all(got[k] == 100 for k in range(100, 140)) and len(got) == 80
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_coverage_nested_adjacent(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 3, 5), (1, 11, 12), (2, 7, 7)], "g int, s int, e int")
    got = {r["g"]: (r["cover1"], r["cover2"]) for r in iv.coverage(df, ["g"], "s", "e").collect()}
    assert got == {1: (12, 3), 2: (1, 0)}


def test_fasta_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">C1 first\nACGTNNNNacgtRYK\n\n#note\nAC\n>C2\nA\n>D3\nACGTACGT\n>C1 again\nAAAAAA\n")
    got = {r["name"]: r["seq"] for r in tx.read_fasta(spark, str(tmp_path / "a.fa.gz"), "C", 2).collect()}
    assert got == {"1": "ACGTNNNNacgtNNNAC"}


def test_fasta_in_blocks_and_chunks(spark, tmp_path):
    """A file read in blocks of 64 bytes gives the same lines in order, and sequences in chunks that its lines run across."""
    rng = np.random.default_rng(2)
    want, text = {}, []
    for k in range(9):
        bases = "".join(rng.choice(list("ACGTNacgtR"), int(rng.integers(0, 260))))
        want[f"q{k}"] = "".join(b if b != "R" else "N" for b in bases)
        text += [f">q{k} of nine", *(bases[i : i + 17] for i in range(0, len(bases), 17))]
    (tmp_path / "b.fa").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        lines = tx.read_lines(spark, str(tmp_path / "b.fa"))
        assert lines.rdd.getNumPartitions() >= 1 and [r["value"] for r in lines.orderBy("line").collect()] == text
        assert [r["line"] for r in lines.orderBy("line").collect()] == list(range(1, len(text) + 1))
        got = tx.fasta_chunks(lines, "", 1, 50).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r["name"], r["chunk"], r["seq"]) for r in got} == {(n, i // 50, s[i : i + 50]) for n, s in want.items() for i in range(0, len(s), 50)}
    assert all(r["length"] == len(want[r["name"]]) and r["fullname"] == f"{r['name']} of nine" for r in got)
    assert tx.fasta_chunks(lines.limit(0)).count() == 0


def _slow_trim(hits, gene, exon, better, gap, over):
    """hits: id to ((s1, e1), (s2, e2)); one gene pair, end by end, side 2 first."""
    left, before = dict(hits), None
    while len(left) > 1 and before != len(left):
        before = len(left)
        for k in (1, 0):
            span = (min(h[k][0] for h in left.values()), max(h[k][1] for h in left.values())) if left else None
            half = int(max(0, min(span[1], gene[k][1]) - max(span[0], gene[k][0]) + 1) / 2 + 0.5) if left else 0
            for last in (False, True):
                order = sorted(left, key=lambda i: (*left[i][k], i))
                if not order:
                    continue
                i = order[-1] if last else order[0]
                s, e = left[i][k]
                go = False
                if len(order) > 1:
                    wide = abs(s - left[order[-2]][k][1]) if last else abs(left[order[1]][k][0] - e) + 1
                    go = wide > gap and not exon[i][k]
                out = e - gene[k][1] if last else gene[k][0] - s
                if go or (out > over and (out > half or not exon[i][k]) and better[i]):
                    del left[i]
    return set(left)


def test_ends_are_trimmed_by_the_rule(spark):
    rng = np.random.default_rng(14)
    genes, hits, pairs, want, other = [], [], [], set(), 5000
    for pair in range(40):
        g1, g2 = 2 * pair + 1, 2 * pair + 2
        model = [(int(a), int(a + n)) for a, n in zip(rng.integers(1000, 1400, 2), rng.integers(200, 900, 2), strict=True)]
        genes += [(g1, 1, *model[0]), (g2, 2, *model[1])]
        own, exon, better = {}, {}, {}
        for n in range(int(rng.integers(1, 7))):
            i = pair * 100 + n
            s1, s2 = (int(x) for x in rng.integers(300, 3000, 2))
            own[i] = ((s1, s1 + int(rng.integers(20, 900))), (s2, s2 + int(rng.integers(20, 900))))
            exon[i] = tuple(int(x) * 40 for x in rng.integers(0, 3, 2))
            hits.append((i, own[i][0][0], own[i][0][1], own[i][1][0], own[i][1][1]))
            pairs.append((i, g1, g2, True, *exon[i]))
            better[i] = bool(rng.random() < 0.5)
            if better[i]:  # another pair of genes that the hit fits better
                other += 2
                genes += [(other, 1, 1, 2), (other + 1, 2, 1, 2)]
                pairs.append((i, other, other + 1, True, 500, 500))
                want.add((i, other))
        want |= {(i, g1) for i in _slow_trim(own, model, exon, better, 300, 60)}
    found = cp.trim_ends(
        spark.createDataFrame(pairs, "hit_idx long, gene1 long, gene2 long, same boolean, exon1 long, exon2 long"), spark.createDataFrame(hits, "hit_idx long, start1 int, end1 int, start2 int, end2 int"),
        spark.createDataFrame(genes, "annot_idx long, grp_idx int, g_start int, g_end int"), 300, 60,
    )
    got = [(r["hit_idx"], r["gene1"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and len(want) < len(pairs)


def test_hits_line_of_fifteen_and_thirteen_fields(spark, tmp_path):
    wide = "7001 7240 33960 33721 240 240 84.26 91.55 0.00 52000 61000 3 -2 chr8 chr2"
    (tmp_path / "a.mum").write_text(wide + "\n1 100 5 104 100 100 88.5 1 1 1 1 chrT chrQ\nbad line\n")
    rows = sorted(tx.read_hits(spark, str(tmp_path / "a.mum")).collect(), key=lambda r: r["start1"])
    assert (rows[1]["query"], rows[1]["target"], rows[1]["start1"], rows[1]["end1"], rows[1]["pctid"], rows[1]["pctsim"], rows[1]["strand"]) == ("chr2", "chr8", 33721, 33960, 84, 92, "-/+")
    assert (rows[0]["query"], rows[0]["target"], rows[0]["pctsim"], rows[0]["pctid"]) == ("chrQ", "chrT", 0, 89)


def test_gff_quotes_reversed_and_short_lines(spark, tmp_path):
    (tmp_path / "a.gff").write_text('#c\nC1\tx\tgene\t300\t100\t.\t.\t.\tID="g1";Name=n\nC1\tx\tgene\t1\t2\nC1\tx\tother\t1\t2\t.\t+\t.\tID=o\n')
    (row,) = tx.read_gff(spark, str(tmp_path / "a.gff")).collect()
    assert (row["g_start"], row["g_end"], row["strand"], row["attrs"]["ID"]) == (100, 300, "+", "g1")


def test_tables_and_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([("C1", 1, 5, "x,y"), ("s2", 2, 9, None)], "seqid string, g_start int, g_end int, text string")
    tx.write_tables({"t": df}, str(tmp_path / "w"), "seqid")
    assert tx.read_tables(spark, str(tmp_path / "w"), ["t"])["t"].count() == 2
    tx.write_delimited(df, str(tmp_path / "c"), "\t", ["made"])
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()}
    assert "### made" in lines and "C1\t1\t5\tx,y" in lines
    tx.split_by_sequence(df, str(tmp_path / "s"))
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "s")).select("chr_or_scaf").collect()} == {"C1", "scaffolds"}


def test_few_sequences_have_no_cutoffs(spark):
    assert cv.length_cutoffs(spark.createDataFrame([("ACGT",)] * 9, "seq string")).count() == 0


def test_repeated_attribute_keys_do_not_fail(spark):
    (row,) = spark.createDataFrame([("a=1;b;a=2=3",)], "t string").select(an.parse_attributes(F.col("t")).alias("m")).collect()
    assert row["m"] == {"a": "2=3"}


def _gene_world(spark):
    genes = [(1, 11, 1000, 2000), (2, 21, 1000, 2000), (3, 21, 1500, 2600), (4, 21, 9000, 10000), (5, 11, 5000, 6000), (6, 11, 20000, 40000), (7, 21, 20000, 40000)]
    exons = [(g, s, e) for g, _, s, e in genes if g < 6] + [(6, 20000, 21000), (7, 20000, 21000)]
    hits = [(1, 1000, 1400, 1000, 1400), (2, 1600, 2000, 1600, 2000), (3, 5000, 6000, 9000, 10000), (4, 20000, 20400, 20000, 20400), (5, 20500, 20900, 20500, 20900), (6, 35000, 35100, 35000, 35100)]
    return (
        spark.createDataFrame([(g, c, s, e, "+") for g, c, s, e in genes], "annot_idx long, grp_idx int, g_start int, g_end int, strand string"),
        spark.createDataFrame(exons, "gene_idx long, e_start int, e_end int"),
        spark.createDataFrame([(h, 11, 21, a, b, c, d, "+/+", 90, 80) for h, a, b, c, d in hits], "hit_idx long, grp1_idx int, grp2_idx int, start1 int, end1 int, start2 int, end2 int, strand string, pctid int, cvgpct int"),
    )


def test_gene_pairs_trimmed_scored_and_assigned(spark):
    genes, exons, hits = _gene_world(spark)
    pairs = written(cp.gene_pairs(hits, cp.hit_exon_cover(hits, genes, exons, 1), cp.hit_exon_cover(hits, genes, exons, 2), genes), "pairs")
    of = lambda df: {(r["gene1"], r["gene2"], r["hit_idx"]) for r in df.collect()}
    assert of(pairs) == {(1, 2, 1), (1, 2, 2), (1, 3, 2), (5, 4, 3), (6, 7, 4), (6, 7, 5), (6, 7, 6)}
    trimmed = written(cp.trim_ends(pairs, hits, genes), "trimmed")
    # the last sub-hit of genes 6 and 7 lies off the exons behind a gap of 14,000
    assert of(pairs) - of(trimmed) == {(6, 7, 6)}
    scores = {(r["gene1"], r["gene2"]): r for r in cp.pair_scores(trimmed, hits, genes, exons).collect()}
    r = scores[1, 2]
    assert (r["subs"], r["m1"], r["x1"], r["longest"], r["pctid"], r["pctsim"], r["cov1"], r["golap1"]) == (2, 802, 802, 802, 90, 80, round(80200 / 1001, 6), 100)
    assert (scores[1, 3]["gcov2"], scores[6, 7]["frac1"], scores[6, 7]["golap1"]) == (round(40100 / 1101, 6), round(80200 / 1001, 6), round(90100 / 20001, 6))
    passed = written(cp.filter_gene_pairs(cp.pair_scores(trimmed, hits, genes, exons), trimmed, hits, genes, exons), "passed")
    got = {(r["gene1"], r["gene2"]): (r["role"], r["bin"]) for r in cp.good_enough_and_minor(passed, trimmed, genes).collect()}
    # gene 3's only sub-hit is among those of its overlapping neighbour's pair
    assert {k: v[0] for k, v in got.items()} == {(1, 2): "major", (1, 3): "minor", (5, 4): "major", (6, 7): "major"}
    assert got[1, 3][1] == got[1, 2][1] != got[5, 4][1]
    none = cp.filter_gene_pairs(cp.pair_scores(trimmed.limit(0), hits, genes, exons), trimmed.limit(0), hits, genes, exons)
    assert cp.good_enough_and_minor(none, trimmed.limit(0), genes).count() == 0 and cp.trim_ends(trimmed.limit(0), hits, genes).count() == 0


def test_roles_by_conflicts_equal_one_walk(spark, monkeypatch):
    """Walked by components of pairs that share a gene or a sub-hit, roles and bins are those of one walk over all."""
    rng = np.random.default_rng(21)
    genes = [(g, g % 2 + 1, int(a), int(a) + 400) for g, a in enumerate(rng.integers(1, 9000, 60))]
    shares = [f"{c}{k}" for c in ("exon", "golap", "cov", "frac", "gcov") for k in (1, 2)]
    passed, pairs, seen = [], [], set()
    for g1, g2 in rng.integers(0, 30, (90, 2)).tolist():
        key = (2 * g1, 2 * g2 + 1, True)  # one class
        if key in seen:
            continue
        seen.add(key)
        subs = sorted({int(h) for h in rng.integers(g1 * 4, g1 * 4 + 12, rng.integers(1, 5))})
        at = [int(x) for x in rng.integers(1, 9000, 2)]
        passed.append((*key, 0, subs[0], 1, 2, *(float(x) for x in rng.integers(0, 101, 10)), float(rng.random()), len(subs), int(rng.integers(100, 9000)), at[0], at[0] + 300, at[1] // 500 * 500, at[1] // 500 * 500 + 300))
        pairs += [(h, *key) for h in subs]
    df = spark.createDataFrame(passed, "gene1 long, gene2 long, same boolean, part long, first long, grp1 int, grp2 int, " + ", ".join(f"{c} double" for c in shares) + ", ratio double, subs long, longest long, lo1 long, hi1 long, lo2 long, hi2 long")
    hits, genes = spark.createDataFrame(pairs, "hit_idx long, gene1 long, gene2 long, same boolean"), spark.createDataFrame(genes, "annot_idx long, grp_idx int, g_start int, g_end int")
    got = sorted(map(tuple, cp.good_enough_and_minor(df, hits, genes).collect()))
    monkeypatch.setattr(cp, "connected_components", lambda edges, a, b: edges.select(F.col(a).alias("node"), F.lit(1).cast("long").alias("component")).distinct())
    assert got == sorted(map(tuple, cp.good_enough_and_minor(df, hits, genes).collect())) and len(got) == len(passed)
    assert {r[4] for r in got} == {"major", "minor", "none"}


def test_majors_in_the_same_place(spark):
    """Of majors next to each other, in the order of a walk."""
    rng = np.random.default_rng(23)
    rows = []
    for p, (a, b, n, g) in enumerate(rng.integers(0, 6, (160, 4)).tolist()):
        rows.append((p, p % 2, 5, True, a * 100, a * 100 + 90 + n % 2, b * 100, b * 100 + 90, g, g + 1, g % 3, n % 3, bool(g % 2), bool(n % 2)))
    names = "place long, grp1 int, grp2 int, same boolean, lo1 long, hi1 long, lo2 long, hi2 long, gene1 long, gene2 long, num1 int, num2 int, overlaps1 boolean, overlaps2 boolean"
    want = {}
    for grp in (0, 1):
        bins, before = {}, None
        for r in sorted((r for r in rows if r[1] == grp), key=lambda r: (r[6], r[0])):
            if before is not None:
                x, y = before, r
                kin = ((x[12] and y[12] and x[10] == y[10]) or (x[13] and y[13] and x[11] == y[11])) and (x[8] == y[8] or x[9] == y[9])
                one, two = min(x[5], y[5]) - max(x[4], y[4]), min(x[7], y[7]) - max(x[6], y[6])
                if x[4:8] == y[4:8] or (kin and one >= 0 and two >= 0 and (one in (x[5] - x[4], y[5] - y[4]) or two in (x[7] - x[6], y[7] - y[6]))):
                    keep, lose = sorted((x[0], y[0]))
                    bins[lose] = bins.get(keep, keep)
            before = r
        want |= bins
    got = {r["place"]: r["of"] for r in cp._one_of_each_place(spark.createDataFrame(rows, names).repartition(3)).collect()}
    assert got == want and len(want) > 5


def test_rectangles_merge_until_none_are_near(spark):
    rng = np.random.default_rng(17)
    rows = [(int(g), i, int(a), int(a + n), int(b), int(b + m), 40, 50) for i, (g, a, n, b, m) in enumerate(zip(rng.integers(0, 2, 140), rng.integers(1, 9000, 140), rng.integers(5, 700, 140), rng.integers(1, 9000, 140), rng.integers(5, 700, 140), strict=True))]
    groups = [([r[1]], r[0], list(r[2:6])) for r in rows]
    again = True
    while again:
        again = False
        for x in groups:
            near = [y for y in groups if y is not x and y[1] == x[1] and all(max(x[2][k], y[2][k]) - min(x[2][k + 1], y[2][k + 1]) <= (40, 50)[k // 2] for k in (0, 2))]
            if near:
                y = near[0]
                groups = [z for z in groups if z is not x and z is not y] + [(x[0] + y[0], x[1], [min(x[2][0], y[2][0]), max(x[2][1], y[2][1]), min(x[2][2], y[2][2]), max(x[2][3], y[2][3])])]
                again = True
                break
    boxes = spark.createDataFrame(rows, "k int, id long, lo1 long, hi1 long, lo2 long, hi2 long, gap1 long, gap2 long")
    got = {r["id"]: r["merged"] for r in bl.merge_rectangles(boxes, ["k"], 500).collect()}
    assert got == {i: min(g[0]) for g in groups for i in g[0]} and 10 < len(groups) < 120
    assert bl.merge_rectangles(boxes.limit(0), ["k"]).count() == 0


# --- clusters with a gene on one side or none, against the rules applied base by base ---


def _bases(pairs):
    return {b for s, e in pairs for b in range(s, e + 1)}


def _share(a, b):
    return min(100.0, 100.0 * a / max(b, 1))


def _slow_chains(hits, links):
    """First come, first taken: each hit in order takes all free later ones that link to it."""
    home = {}
    for i, a in enumerate(hits):
        for b in hits[i + 1 :]:
            if b[0] not in home and links(a, b):
                home.setdefault(a[0], a[0])
                home[b[0]] = home[a[0]]
    groups = {}
    for h in hits:
        if h[0] in home:
            groups.setdefault(home[h[0]], []).append(h)
    return list(groups.values())


def _lose(own, k, last, wide):
    """``own`` (id, s1, e1, s2, e2, ...) without the first or last hit along side k, if its gap is too wide."""
    s, e = (1, 2) if k == 1 else (3, 4)
    order = sorted(own, key=lambda h: (h[s], h[e], h[0]))
    if len(order) < 2:
        return own
    at, by = (order[-1], order[-2]) if last else order[:2]
    return [h for h in own if h != at] if wide(max(at[s], by[s]) - min(at[e], by[e]) - 1, at) else own


def _spans(own):
    one, two = (max(h[e] for h in own) - min(h[s] for h in own) + 1 for s, e in ((1, 2), (3, 4)))
    return min(one, two) / max(one, two)


def _slow_one_gene(hits, gene, exons, intron2, rm, cover2):
    inside = lambda h: len(_bases([h[1:3]]) & _bases(exons))
    order = sorted(hits, key=lambda h: (h[3], -h[4], h[0]))
    kept, loose = [], {h[0]: h for h in hits}

    def good(own):
        one, two = _bases([h[1:3] for h in own]), _bases([h[3:5] for h in own])
        lo, hi = min(h[1] for h in own), max(h[2] for h in own)
        g = _bases([gene])
        cov1, cov2 = _share(len(one), hi - lo + 1), _share(len(two), max(h[4] for h in own) - min(h[3] for h in own) + 1)
        gcov, golap, exon = _share(len(one & g), len(g)), _share(len(_bases([(lo, hi)]) & g), len(g)), _share(len(one & _bases(exons)), len(_bases(exons)))
        frac = sum(100.0 * len(one & _bases([x])) / len(_bases([x])) for x in exons) / len(exons)
        size, n, ratio = max(len(one), len(two)), len(own), _spans(own)
        if cov2 * 3 < cov1 or ratio < 0.25 or (frac < 25 and gcov < 1 and golap < 1):
            return False
        if min(exon, golap, cov1) >= 97 or (size > 5000 and max(exon, frac) >= 60 and max(gcov, golap) >= 60 and cov1 >= cover2):
            return True
        if exon <= 0.001:
            return size >= 3000 and max(gcov, golap) >= 50 and max(cov1, cov2) >= 60 and ratio >= 0.5
        if size < 300:
            return False
        for k, (e, o) in enumerate([(60, 90), (35, 80), (30, 70), (25, 60)]):
            if size < 1000 * (k + 1) and max(frac, exon) < e and max(golap, gcov) < o:
                return False
        if size < 5000 and exon < 30 and max(gcov, golap) < 25 or n == 2 and gcov < 25 and max(cov1, cov2) < 40:
            return False
        points = (max(exon, frac) > 25) + (max(gcov, golap) > 35)
        if n > 1:
            points += (min(cov1, cov2) > (60 if exon > 25 else 80)) + (size > 10000 and ratio > 0.5)
        return points >= 2

    for own in _slow_chains(order, lambda a, b: abs(b[3] - a[4]) <= intron2):
        while True:
            left = own
            for last in (False, True):
                left = _lose(left, 1, last, lambda gap, h: gap > intron2 or (gap > rm and not inside(h)))
            if left == own:
                break
            own = left
        while len(own) > 1 and _spans(own) < 0.7:
            left = own
            for last in (False, True):
                left = _lose(left, 2, last, lambda gap, h: gap > rm)
            if left == own:
                break
            own = left
        if len(own) > 1 and good(own):
            kept.append(sorted(h[0] for h in own))
            for h in own:
                del loose[h[0]]
    return sorted(kept + [[i] for i, h in loose.items() if good([h])])


def test_one_gene_clusters_against_the_rules(spark):
    rng = np.random.default_rng(8)
    genes = {1: (2000, 9000), 2: (15_000, 15_900), 3: (20_000, 32_000)}
    exons = {1: [(2000, 2600), (4000, 4500), (8000, 9000)], 2: [(15_000, 15_900)], 3: [(20_000, 22_000), (25_000, 25_400), (30_000, 32_000)]}
    hits = []
    for g, (s, e) in genes.items():
        for place in (5000, 60_000, 200_000):
            at, far = int(rng.integers(s, e)), place
            for _ in range(int(rng.integers(4, 9))):
                n, m = int(rng.integers(80, 2600)), int(rng.integers(80, 2600))
                at = int(np.clip(at + rng.integers(-1500, 2500), s - 200, e))
                hits.append((len(hits) + 1, at, at + n, far, far + (n if rng.random() < 0.7 else m), g))
                far += n + int(rng.choice([20, 300, 900, 1300, 4000]))
        hits += [(len(hits) + 1, *exons[g][0], 400_000, 400_000 + exons[g][0][1] - exons[g][0][0], g)]
    want = sorted(x for g in genes for x in _slow_one_gene([h[:5] for h in hits if h[5] == g], genes[g], exons[g], 1500, 700, 40))
    kinds = "hit_idx long, proj1_idx int, proj2_idx int, grp1_idx int, grp2_idx int, start1 int, end1 int, start2 int, end2 int, annot1_idx long, annot2_idx long, strand string, pctid int, cvgpct int"
    for side in (1, 2):  # the same world with its sides exchanged
        pos = (lambda h: h[1:5]) if side == 1 else (lambda h: (*h[3:5], *h[1:3]))
        df = spark.createDataFrame([(h[0], 1, 2, 11, 21, *pos(h), h[5] if side == 1 else None, h[5] if side == 2 else None, "+/+", 90, 80) for h in hits], kinds)
        g = spark.createDataFrame([(k, 11 if side == 1 else 21, *v, "+") for k, v in genes.items()], "annot_idx long, grp_idx int, g_start int, g_end int, strand string")
        x = spark.createDataFrame([(k, *y) for k, v in exons.items() for y in v], "gene_idx long, e_start int, e_end int")
        cuts = spark.createDataFrame([(1, 2, 1500, 3000, 700, 40)], "proj1_idx int, proj2_idx int, intron2 int, intron4 int, rm int, cover2 int")
        got = cp.one_gene_clusters(df, g, x, cp.hit_exon_cover(df, g, x, side), cuts, side).collect()
        assert sorted((r["chain"], r["subs"]) for r in got) == sorted((min(w), len(w)) for w in want)
    assert any(len(w) > 1 for w in want) and any(len(w) == 1 for w in want) and len(want) < len(hits)


def test_chains_are_streamed_and_hits_alone_have_none(spark):
    """Pieces cost no pandas group of their own: a genome has very many of a hit or two."""
    rows = spark.createDataFrame([(k, k // 2 if k < 20 else k, 5, k) for k in range(40)], "hit_idx long, gene long, start2 int, end2 int").withColumn("piece", F.lit(1).cast("long"))
    made = cp._chained(rows, ["gene"], ["start2", "-end2", "hit_idx"], lambda c: np.full(len(c["hit_idx"]), c["hit_idx"].min()))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    assert {(r.hit_idx, r.chain) for r in made.collect()} == {(k, k // 2 * 2 if k < 20 else 0) for k in range(40)}


def test_block_genes_of_wide_blocks_are_counted_not_paired(spark):
    rng = np.random.default_rng(4)
    genes = [(k, int(rng.integers(1, 3)), s := int(rng.integers(1, 400)), s + int(rng.integers(0, 60))) for k in range(120)]
    boxes = [(b, 1, 2, *sorted(map(int, rng.integers(1, 460, 2))), *sorted(map(int, rng.integers(1, 460, 2)))) for b in range(60)]
    hits = [(int(rng.integers(0, 60)), int(rng.integers(1, 3)), int(rng.integers(0, 120))) for _ in range(900)]
    g = spark.createDataFrame(genes, "annot_idx long, grp_idx int, g_start int, g_end int")
    b = spark.createDataFrame(boxes, "block_idx long, grp1_idx int, grp2_idx int, start1 int, end1 int, start2 int, end2 int")
    bh = spark.createDataFrame([(n, h[0]) for n, h in enumerate(hits)], "hit_idx long, block_idx long")
    ha = spark.createDataFrame([(n, h[2], h[1]) for n, h in enumerate(hits)], "hit_idx long, annot_idx long, side int")
    want = set()
    for i, *box in boxes:
        for side, (lo, hi) in ((1, box[2:4]), (2, box[4:6])):
            own = {k for k, c, s, e in genes if c == box[side - 1] and max(s, lo) < min(e, hi)}
            if own:
                want.add((i, side, len(own), round(len(own & {a for x, y, a in hits if (x, y) == (i, side)}) / len(own), 9)))
    made = bl.block_genes(b, g, bh, ha)
    assert {(r.block_idx, r.side, r.n_genes, round(r.share, 9)) for r in made.collect()} == want
    # blocks as wide as their chromosome: no step may make a row for each block and gene
    wide = spark.range(300).select(F.col("id").alias("block_idx"), F.lit(1).alias("grp1_idx"), F.lit(1).alias("grp2_idx"), *[F.lit(x).alias(c) for c, x in (("start1", 1), ("end1", 3_000_000), ("start2", 1), ("end2", 3_000_000))])
    many = spark.range(3000).select(F.col("id").alias("annot_idx"), F.lit(1).alias("grp_idx"), (F.col("id") * 1000 + 1).cast("int").alias("g_start"), (F.col("id") * 1000 + 600).cast("int").alias("g_end"))
    made = bl.block_genes(wide, many, bh.limit(0), ha.limit(0))
    assert {(r.side, r.n_genes, r.share) for r in made.collect()} == {(1, 3000, 0.0), (2, 3000, 0.0)}
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_only_pairs_with_no_hit_between_are_listed(monkeypatch):
    """On a dense line a hit has hundreds within reach, but one step at most is ever taken: the nearest."""
    monkeypatch.setattr(ch, "LISTED", 20_000)
    k = np.arange(5000, dtype=np.int64) * 1000
    to, before = ch.reachable(k, k, (300_000, 300_000))
    assert len(to) == 4999 and (to - before == 1).all()
    rng = np.random.default_rng(8)
    for _ in range(20):
        n = 60
        x, y = rng.integers(0, 50, n), np.sort(rng.integers(0, 50, n))
        far = (int(rng.integers(1, 40)), int(rng.integers(1, 40)))
        near = lambda i, j: y[i] - y[j] <= far[1] and abs(x[i] - x[j]) <= far[0]  # noqa: B023, E731
        between = lambda i, j: any(min(x[i], x[j]) <= x[m] <= max(x[i], x[j]) for m in range(j + 1, i))  # noqa: B023, E731
        want = [(i, j) for i in range(n) for j in range(i) if near(i, j) and not between(i, j)]
        assert list(zip(*(c.tolist() for c in ch.reachable(x, y, far)), strict=True)) == want


@pytest.mark.parametrize("length", [40, 700])
def test_assign_bin_of_wide_clusters(spark, length):
    rng = np.random.default_rng(length)
    bins = [(k, int(rng.integers(1, 3)), s := int(rng.integers(1, 20_000)), s + int(rng.integers(0, length))) for k in range(500)]
    some = [(n, int(rng.integers(1, 3)), *sorted(map(int, rng.integers(1, 20_000, 2)))) for n in range(120)] + [(200 + n, 1, s := int(rng.integers(1, 20_000)), s + n) for n in range(60)]
    c = spark.createDataFrame(some, "hit_idx long, grp1_idx int, start1 int, end1 int")
    b = spark.createDataFrame(bins, "bin long, grp_idx int, b_start int, b_end int")
    want = {}
    for n, g, s, e in some:
        found = [(s0 - 1 - e0 if s <= s0 and e0 <= e else max(s, s0) - min(e, e0) - 1, s0, -e0, k) for k, c0, s0, e0 in bins if c0 == g and s <= e0 and s0 <= e]
        if found:
            want[n] = min(found)[3]
    got = [(r.hit_idx, r.bin) for r in cb.assign_bin(c, b, 1, 10).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_wide_clusters_are_not_paired_with_all_bins_within(spark):
    c = spark.range(200).select(F.col("id").alias("hit_idx"), F.lit(1).alias("grp1_idx"), F.lit(5).alias("start1"), F.lit(40_000_000).alias("end1"))
    b = spark.range(4000).select(F.col("id").alias("bin"), F.lit(1).alias("grp_idx"), (F.col("id") * 10_000).cast("int").alias("b_start"), (F.col("id") * 10_000 + 20 + F.col("id") % 7).cast("int").alias("b_end"))
    made = cb.assign_bin(c, b, 1)
    assert {r.bin for r in made.select("bin").distinct().collect()} == {6}
    assert _most_rows(spark, made) < 200 * 4000 / 20


def _most_rows(spark, df):
    """The most rows that a join or expansion of the plan gives, counted with its own run."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        if inner is not None:
            todo.append(inner)
        if node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().length())]
    return max(found)


def test_a_scan_holds_open_scans_only_and_streams_a_long_piece(spark):
    """One piece of a whole chromosome, over many batches: what is held does not grow with it."""
    n = 6000
    rank1, rank2 = (np.arange(n) // 3).tolist(), [k // 3 if k % 3 else (k * 7919) % n for k in range(n)]
    walk, rows, held = co._PieceScan(), [], 0
    for lo in range(0, n, 100):
        part = {"hit_idx": range(lo, lo + 100), "hitnum": range(lo, lo + 100), "rank1": rank1[lo : lo + 100], "rank2": rank2[lo : lo + 100]} | dict.fromkeys(("grp1_idx", "grp2_idx", "same", "piece"), [1] * 100) | dict.fromkeys(("low2", "high2"), [-1] * 100)
        rows += list(zip(*walk.feed({c: np.array(v) for c, v in part.items()}), strict=True))
        held = max(held, len(walk.kept), sum(len(s) for ys in walk.scan.open.values() for s in ys.values()))
    assert held < 40 and len({r[-2] for r in rows}) > 1 and len(rows) > n // 3
    df = spark.createDataFrame([(k, k + 1, 1, 2, True, rank1[k], rank2[k]) for k in range(n)], "hit_idx long, hitnum int, grp1_idx int, grp2_idx int, same boolean, rank1 int, rank2 int")
    run, size = co.scan_runs(rank1, rank2, 1, -1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.hit_idx, r.run, r.size) for r in co.scanned_sets(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(k, run[k], size[k]) for k in range(n) if run[k]}


def test_placed_pairs_are_the_gene_pairs_with_few_shuffles(spark):
    rng = np.random.default_rng(12)
    genes = spark.createDataFrame([(k, k % 2 + 1, s := int(rng.integers(1, 3000)), s + 300, "+-"[k % 3 % 2]) for k in range(40)], "annot_idx long, grp_idx int, g_start int, g_end int, strand string")
    exons = spark.createDataFrame([(k, 1 + 900 * j, 700 + 900 * j) for k in range(30) for j in range(3)], "gene_idx long, e_start int, e_end int")
    hits = spark.createDataFrame(
        [(n, 1, 2, a := int(rng.integers(1, 3000)), a + 150, b := int(rng.integers(1, 3000)), b + 150, ("+/+", "+/-")[n % 2]) for n in range(200)],
        "hit_idx long, grp1_idx int, grp2_idx int, start1 int, end1 int, start2 int, end2 int, strand string",
    )
    covers = [cp.hit_exon_cover(hits, genes, exons, k) for k in (1, 2)]
    pairs, placed = cp.gene_pairs(hits, *covers, genes), cp.placed_pairs(hits, genes, exons)
    rows = lambda df: sorted(map(tuple, df.select(*cp._PAIR).collect()))
    assert rows(pairs) == rows(placed) and len(rows(pairs)) > 200
    assert rows(cp.trim_ends(pairs, hits, genes, 100, 20)) == rows(cp.trim_ends(placed, hits, genes, 100, 20))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = [cp.trim_ends(p, hits, genes)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(hit_idx") for p in (placed, cp.gene_pairs(hits, *covers, genes))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert shuffles[0] <= 4 < shuffles[1], shuffles  # two in each half, which run as one


def test_no_gene_clusters_against_the_rules(spark):
    rng = np.random.default_rng(9)
    hits, at, far = [], 1000, 50_000
    for k in range(90):
        n, m = int(rng.integers(100, 1500)), int(rng.integers(100, 1500))
        hits.append((k + 1, at, at + n, far, far + (n if rng.random() < 0.8 else m)))
        at += n + int(rng.choice([-50, 30, 400, 800, 2500]))
        far += int(rng.choice([1, 1, 1, -1])) * (n + int(rng.choice([30, 400, 800, 2500])))
    order, kept, used = sorted(hits, key=lambda h: (h[1], -h[2], h[0])), [], set()

    def good(own):
        for s, e in ((1, 2), (3, 4)):
            bases = _bases([(h[s], h[e]) for h in own])
            if len(bases) < 1000 or 100 * len(bases) < 40 * (max(h[e] for h in own) - min(h[s] for h in own) + 1):
                return False
        return _spans(own) >= 0.5

    for own in _slow_chains(order, lambda a, b: b[1] - a[2] <= 1200 and abs(b[3] - a[4]) <= 1200):
        used |= {h[0] for h in own}
        if _spans(own) < 0.1:
            continue
        for _ in range(5):
            left = _lose(_lose(own, 2, False, lambda gap, h: gap > 500), 1, True, lambda gap, h: gap > 500)
            used -= {h[0] for h in own} - {h[0] for h in left}
            if left == own:
                break
            own = left
        if len(own) > 1:
            if good(own):
                kept.append((min(h[0] for h in own), len(own)))
            else:
                used -= {h[0] for h in own}
    kept += [(h[0], 1) for h in hits if h[0] not in used and good([h])]
    kinds = "hit_idx long, proj1_idx int, proj2_idx int, grp1_idx int, grp2_idx int, start1 int, end1 int, start2 int, end2 int, annot1_idx long, annot2_idx long, strand string"
    df = spark.createDataFrame([(h[0], 1, 2, 11, 21, *h[1:], None, None, "+/+") for h in hits], kinds)
    cuts = spark.createDataFrame([(1, 2, 600, 1200, 500, 40)], "proj1_idx int, proj2_idx int, intron2 int, intron4 int, rm int, cover2 int")
    got = cp.no_gene_clusters(df, cuts).collect()
    assert sorted((r["chain"], r["subs"]) for r in got) == sorted(kept) and len(kept) > 5 and max(n for _, n in kept) > 1
    assert cp.no_gene_clusters(df.limit(0), cuts).count() == 0


def _slow_link_rows(edges, species):
    """Every gene of every other species is tried for every place of a row, in order of numbers."""
    linked = lambda a, b: (a, b) in edges or (b, a) in edges
    key = lambda a, b: (min(a, b), max(a, b))
    used, rows, kinds = set(), [], sorted(set(species.values()))
    for ref in sorted(species, key=lambda g: (species[g], g)):
        more = True
        while more:
            row = [ref]
            for kind in kinds:
                fit = [g for g in sorted(species) if species[g] == kind != species[ref] and linked(ref, g) and key(ref, g) not in used and all(linked(o, g) for o in row)]
                if fit:
                    used |= {key(o, fit[0]) for o in row}
                    row.append(fit[0])
            more = len(row) > 1
            for kind in kinds if more else ():
                if kind not in [species[g] for g in row]:
                    fit = [g for g in sorted(species) if species[g] == kind and all(linked(o, g) for o in row)]
                    if fit:
                        used |= {key(o, fit[0]) for o in row}
                        row.append(fit[0])
            if more:
                rows.append(sorted(row, key=lambda g: species[g]))
    assert used == {key(*e) for e in edges}
    return rows


def test_cluster_link_rows_against_a_slow_walk(spark):
    rng = np.random.default_rng(4)
    species = {g: g % 4 + 1 for g in range(1, 61)}
    pairs = [(int(a), int(b)) for a, b in [*rng.integers(1, 31, (500, 2)), *rng.integers(31, 61, (40, 2))]]
    edges = {(a, b) for a, b in pairs if species[a] < species[b]}
    hits = spark.createDataFrame([*edges, *list(edges)[:5]], "annot1_idx long, annot2_idx long")
    genes = spark.createDataFrame(list(species.items()), "annot_idx long, proj_idx int")
    clusters = qu.gene_clusters(hits)
    of = {r["annot_idx"]: r["cluster"] for r in clusters.collect()}
    want = []
    for c in set(of.values()):
        own = {g: species[g] for g in of if of[g] == c}
        want += [(c, k, ",".join(f"{species[g]}:{g}" for g in r), len(r), len(r) * (len(r) - 1) // 2) for k, r in enumerate(_slow_link_rows({e for e in edges if e[0] in own}, own), 1)]
    got = [(r["cluster"], r["row"], r["genes"], r["species"], r["links"]) for r in rp.cluster_link_rows(clusters, hits, genes).collect()]
    assert sorted(got) == sorted(want) and {w[3] for w in want} == {2, 3, 4}


RANKED = "hit_idx long, hitnum int, grp1_idx int, grp2_idx int, same boolean, rank1 int, rank2 int"


@pytest.mark.parametrize("partitions", [1, 4])
def test_sets_in_pieces_equal_a_slow_walk(spark, partitions):
    """Several chromosome pairs and both strands, in hit order with gaps, dealt out by range."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for grp1, same in [(g, s) for g in range(6) for s in (True, False)]:
        n = int(rng.integers(3, 160))
        rank1 = np.sort(np.concatenate([rng.integers(a, a + 12, n // 3 + 1) for a in (1, 15, 40)]))
        rank1 = np.maximum(1, rank1 + rng.integers(-1, 2, len(rank1)))
        step = 1 if same else -1
        rank2 = step * rank1 + 100 + rng.integers(0, 2, len(rank1))
        if grp1 == 5:  # what follows the first piece is of one rank on side 2
            rank1, rank2 = np.array([1, 1, 2, 2, 9, 9]), np.array([60, 70, 60 + step, 70 + step, 60 + 2 * step, 60 + 2 * step])
        ids = rng.permutation(len(rank1)) + 1000 * len(want)
        run = _slow_runs(rank1.tolist(), rank2.tolist(), step)
        for k, r in enumerate(run):
            rows.append((int(ids[k]), k + 1, grp1, 2, same, int(rank1[k]), int(rank2[k])))
            if r:
                want[int(ids[k])] = (r, run.count(r))
    df = spark.createDataFrame(rows, RANKED).repartition(partitions)
    found = co.scanned_sets(df).collect()
    assert {r["hit_idx"]: (r["run"], r["size"]) for r in found} == want and len(found) == len(want)
    assert co.scanned_sets(df.limit(0)).count() == 0


def test_carried_values_over_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k % 3 == 0), int(x), i) for i, (k, x) in enumerate(zip(rng.integers(0, 6, 300), rng.integers(0, 50, 300), strict=True))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        dealt = od.deal(spark.createDataFrame(rows, "k int, x int, id int").repartition(3), ["k"], ["-x", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt.select("__range").distinct().count() > 1
    got = {r["id"]: r for r in od.carried(dealt, ["k"], ["-x", "id"], top=("max", "id", "before"), low=("min", "id", "from"), total=("sum", "x", "upto"), rest=("max", "x", "after")).collect()}
    assert len(got) == 300
    for k in (0, 1):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))
        for p, (_, _, i) in enumerate(own):
            want = (max((r[2] for r in own[:p]), default=None), min(r[2] for r in own[p:]), sum(r[1] for r in own[: p + 1]), max((r[1] for r in own[p + 1 :]), default=None))
            assert (got[i]["top"], got[i]["low"], got[i]["total"], got[i]["rest"]) == want


def test_delimited_quotes_line_breaks(spark):
    df = spark.createDataFrame([("a\nb", 'c"d', "e,f", None)], "a string, b string, c string, d string")
    assert tx.delimited(df, ",").first()["value"] == '"a\nb","c""d","e,f",'
