"""Clustering of hits by annotation elements and bins (first algorithm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.intervals import bin_join
from genoloom.functions.scalars import same_strand
from genoloom.operators.hits import hit_gene_overlaps
from genoloom.operators.lineage import written
from genoloom.operators.ordering import carried, deal

#: Greatest length of a region without genes.
MAX_REGION = 100_000


def candidate_regions(raw: DataFrame, genes: DataFrame, side: int, tolerance: int = 1000, longest: int = 50_000) -> DataFrame:
    """(grp_idx, start, end): hits of a side that touch no gene, merged where closer than ``tolerance`` with no
    gene between, and cut at ``longest`` bases."""
    touching = hit_gene_overlaps(raw, genes, side).select("hit_idx").distinct()
    free = raw.join(touching, "hit_idx", "left_anti").select(F.col(f"grp{side}_idx").alias("grp_idx"), F.col(f"start{side}").alias("s"), F.col(f"end{side}").alias("e"), F.lit(0).alias("gene"))
    walls = genes.select("grp_idx", F.col("g_start").alias("s"), F.col("g_end").alias("e"), F.lit(1).alias("gene"))
    key, order = ["grp_idx"], ["s", "-gene", "-e"]
    # genes so far, carried from range to range of a chromosome; of rows alike in all, only genes count
    rows = carried(deal(free.union(walls), key, order), key, order, wall=("sum", "gene", "upto")).filter("gene = 0").drop("__range")
    v = Window.partitionBy("grp_idx", "wall").orderBy("s", F.desc("e"))
    reach = F.max("e").over(v.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(reach.isNull() | (F.col("s") - reach >= tolerance), 1).otherwise(0)).withColumn("part", F.sum("new").over(v))
    spans = rows.groupBy("grp_idx", "wall", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    size = min(longest, MAX_REGION)
    pieces = spans.withColumn("at", F.explode(F.sequence("s", "e", F.lit(size))))
    return pieces.select("grp_idx", F.col("at").alias("start"), F.least(F.col("at") + size - 1, F.col("e")).alias("end"))


def best_annotation(hits: DataFrame, elements: DataFrame, side: int) -> DataFrame:
    """(hit_idx, element, is_gene, overlap): the best overlapping element of a side: genes first, then larger
    overlap, then smaller differences of both ends, then the smaller number. ``elements``: element, grp_idx,
    el_start, el_end, is_gene."""
    h = hits.select("hit_idx", F.col(f"grp{side}_idx").alias("grp_idx"), F.col(f"start{side}").alias("h_start"), F.col(f"end{side}").alias("h_end"))
    pairs = bin_join(h, elements, ["grp_idx"], "h_start", "h_end", "el_start", "el_end")
    overlap = F.least("h_end", "el_end") - F.greatest("h_start", "el_start") + 1
    off = F.abs(F.col("h_start") - F.col("el_start")) + F.abs(F.col("h_end") - F.col("el_end"))
    rank = F.row_number().over(Window.partitionBy("hit_idx").orderBy(F.desc("is_gene"), F.desc("overlap"), "off", "element"))
    rows = pairs.withColumn("overlap", overlap).withColumn("off", off).withColumn("rank", rank)
    return rows.filter("rank = 1").select("hit_idx", "element", "is_gene", "overlap")


def cluster_by_annotation(hits: DataFrame) -> DataFrame:
    """Hits (with element1, element2, gene1, gene2) clustered per pair of elements and strand class.

    The larger class of a pair stays, both if tied, and any class of more than two hits. Cluster: bounds of both
    sides, sub-hits, identity and similarity weighted by length and rounded, match length (greater side of
    summed lengths less overlap with the sub-hit before), type GeneGene / GeneNonGene / NonGene.
    """
    keys = ["element1", "element2", "same"]
    rows = hits.withColumn("same", same_strand(F.col("strand"))).withColumn("len", F.greatest(F.col("end1") - F.col("start1") + 1, F.col("end2") - F.col("start2") + 1))
    net = []
    for k in (1, 2):
        before = F.lag(f"end{k}").over(Window.partitionBy(*keys).orderBy(f"start{k}", f"end{k}", "hit_idx"))
        size = F.col(f"end{k}") - F.col(f"start{k}") + 1
        lost = F.greatest(F.lit(0), F.coalesce(before - F.col(f"start{k}") + 1, F.lit(0)))
        net.append((size - lost).alias(f"net{k}"))
    rows = rows.select("*", *net)
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("len")) / F.sum("len")).cast("int")
    kind = F.when(F.col("gene1") & F.col("gene2"), "GeneGene").when(F.col("gene1") | F.col("gene2"), "GeneNonGene").otherwise("NonGene")
    out = rows.groupBy(*keys).agg(
        F.min("grp1_idx").alias("grp1_idx"), F.min("grp2_idx").alias("grp2_idx"), F.min("start1").alias("start1"), F.max("end1").alias("end1"), F.min("start2").alias("start2"), F.max("end2").alias("end2"),
        F.count(F.lit(1)).alias("subs"), weighted("pctid").alias("pctid"), weighted("cvgpct").alias("pctsim"), F.greatest(F.sum("net1"), F.sum("net2")).alias("length"), F.min("hit_idx").alias("hit_idx"),
        F.bool_and("gene1").alias("gene1"), F.bool_and("gene2").alias("gene2"),
    )
    best = F.max("subs").over(Window.partitionBy("element1", "element2"))
    return out.withColumn("best", best).filter((F.col("subs") == F.col("best")) | (F.col("subs") > 2)).drop("best").withColumn("type", kind)


def cluster_strand(same: Column, strand1: Column, strand2: Column, as_written: bool = True) -> Column:
    """Strand of a cluster that agrees with its genes (strands null where a side has none).

    Two genes: their strands, if they fit the class, else null (inconsistent). One gene of strand g: with
    ``as_written``, the same class gives g and its opposite, the opposite class g/g; without, the other way.
    """
    flip = lambda s: F.when(s == "+", "-").otherwise("+")
    both = F.when((strand1 == strand2) == same, F.concat_ws("/", strand1, strand2))
    turn = same if as_written else ~same
    one = F.when(turn, F.concat_ws("/", strand1, flip(strand1))).otherwise(F.concat_ws("/", strand1, strand1))
    two = F.when(turn, F.concat_ws("/", flip(strand2), strand2)).otherwise(F.concat_ws("/", strand2, strand2))
    none = F.when(same, "+/+").otherwise("+/-")
    return F.when(strand1.isNotNull() & strand2.isNotNull(), both).when(strand1.isNotNull(), one).when(strand2.isNotNull(), two).otherwise(none)


#: A node of the tree over a chromosome's bins is so many times as wide as the nodes below it.
RADIX = 16


def _rank(c_start: str, c_end: str) -> Column:
    """The order of bins for a cluster, best first: most overlap, smaller start, larger end, smaller number."""
    overlap = F.least(c_end, "b_end") - F.greatest(c_start, "b_start") + 1
    return F.struct((-overlap).alias("o"), "b_start", (-F.col("b_end")).alias("e"), "bin")


def assign_bin(clusters: DataFrame, bins: DataFrame, side: int, width: int = 10_000) -> DataFrame:
    """(hit_idx, bin): the bin of most overlap with a cluster's side; ties: smaller start, then larger end, then the smaller
    number. ``bins``: bin, grp_idx, b_start, b_end.

    A wide cluster is not paired with all bins within it. Its side is split into the stretches of its first and last
    ``width`` bases, whose bins are looked at one by one, and the largest nodes of a tree over the chromosome between
    them: of the bins that lie within one node only the best counts, and those that cross a node's end are met there."""
    c = clusters.select("hit_idx", F.col(f"grp{side}_idx").alias("grp_idx"), F.col(f"start{side}").cast("long").alias("c_start"), F.col(f"end{side}").cast("long").alias("c_end")).filter("c_start <= c_end")
    b = bins.select("bin", "grp_idx", F.col("b_start").cast("long").alias("b_start"), F.col("b_end").cast("long").alias("b_end")).filter("b_start <= b_end")
    cell = lambda x: F.floor(F.col(x) / width)
    c = c.withColumns({"lo": cell("c_start"), "hi": cell("c_end")})
    top = b.agg(F.max(cell("b_end"))).first()[0] or 0
    levels = 1
    while RADIX**levels <= top + 1:
        levels += 1
    # cells lo + 1 to hi - 1 lie within the cluster: on each level its whole nodes but for those in whole nodes of the next
    up = [F.ceil((F.col("lo") + 1) / RADIX**k) for k in range(levels + 1)]
    down = [F.floor(F.col("hi") / RADIX**k) - 1 for k in range(levels + 1)]
    run = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
    pieces, nodes = [], []
    for k in range(levels):
        rest = F.concat(run(up[k], up[k + 1] * RADIX - 1), run((down[k + 1] + 1) * RADIX, down[k]))
        some = F.when(up[k + 1] <= down[k + 1], rest).otherwise(run(up[k], down[k]))
        pieces.append(F.transform(some, lambda n: F.struct(F.lit(k).alias("level"), n.alias("node"))))  # noqa: B023
        nodes.append(tuple(F.floor(F.col(x) / (width * RADIX**k)) for x in ("b_start", "b_end")))
    wide = written(c.filter("hi - lo > 1").withColumn("at", F.explode(F.concat(*pieces))).select("hit_idx", "grp_idx", "c_start", "c_end", "at.*"), "wide-clusters")
    best = F.min(_rank("b_start", "b_end")).alias("b")
    inner = None
    if not wide.isEmpty():
        own = b.withColumn("at", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), n.alias("node"), (n == m).alias("whole")) for k, (n, m) in enumerate(nodes)])))
        own = own.select("bin", "grp_idx", "b_start", "b_end", "at.*")
        within = own.filter("whole").groupBy("grp_idx", "level", "node").agg(best).select("grp_idx", "level", "node", "b.b_start", (-F.col("b.e")).alias("b_end"), "b.bin")
        # bins that go on past the last base of a cell, which may be a node's
        crossing = b.withColumn("node", F.explode(F.sequence(cell("b_start"), cell("b_end") - 1))).filter(cell("b_start") < cell("b_end"))
        ends = wide.select("hit_idx", "grp_idx", "c_start", "c_end", ((F.col("node") + 1) * F.element_at(F.array(*[F.lit(RADIX**k) for k in range(levels)]), F.col("level") + 1) - 1).alias("node"))
        inner = wide.join(within, ["grp_idx", "level", "node"]).select("hit_idx", _rank("c_start", "c_end").alias("b"))
        inner = inner.union(ends.join(crossing, ["grp_idx", "node"]).select("hit_idx", _rank("c_start", "c_end").alias("b")))
    edge = c.withColumn("__bin", F.explode(F.array_distinct(F.array("lo", "hi"))))
    touched = b.withColumn("__bin", F.explode(F.sequence(cell("b_start"), cell("b_end"))))
    pairs = edge.join(touched, ["grp_idx", "__bin"]).filter("c_start <= b_end and b_start <= c_end").select("hit_idx", _rank("c_start", "c_end").alias("b"))
    return (pairs if inner is None else pairs.union(inner)).groupBy("hit_idx").agg(F.min("b").alias("b")).select("hit_idx", "b.bin")


def topn_filter(clusters: DataFrame, bin_col: str, n: int = 2, keep: float = 0.8) -> DataFrame:
    """Clusters that stay in their bin: annotated enough (two genes and length over 100, or one and two sub-hits
    or a length of 300); else not a single sub-hit of 100 or less, and of rank ``n`` or better by length, or at
    least trunc(``keep`` x length of rank n)."""
    w = Window.partitionBy(bin_col).orderBy(F.desc("length"), F.desc("start1"), "hit_idx")
    nth = F.nth_value("length", n).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    enough = F.when(F.col("gene1") & F.col("gene2"), F.col("length") > 100).when(F.col("gene1") | F.col("gene2"), (F.col("subs") >= 2) | (F.col("length") >= 300)).otherwise(False)
    small = (F.col("subs") == 1) & (F.col("length") <= 100)
    rows = clusters.withColumn("__rank", F.row_number().over(w)).withColumn("__nth", nth)
    ok = enough | (~small & ((F.col("__rank") <= n) | (F.col("length") >= F.floor(keep * F.col("__nth")))))
    return rows.filter(ok).drop("__rank", "__nth")


def topn_both_sides(clusters: DataFrame, n: int = 2, keep: float = 0.8) -> DataFrame:
    """Clusters (with bin1, bin2) kept on both sides."""
    return topn_filter(clusters, "bin1", n, keep).join(topn_filter(clusters, "bin2", n, keep).select("hit_idx"), "hit_idx", "left_semi")


def hit_annot_algo1(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """(hit_idx, annot_idx, side, olap): every gene that overlaps a hit, olap = round(100 overlap / (end - start))."""
    out = None
    for k in (1, 2):
        pairs = hit_gene_overlaps(hits, genes, k).join(hits.select("hit_idx", (F.col(f"end{k}") - F.col(f"start{k}")).alias("size")), "hit_idx")
        rows = pairs.select("hit_idx", "annot_idx", F.lit(k).alias("side"), F.floor(100.0 * F.col("overlap") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int").alias("olap"))
        out = rows if out is None else out.unionByName(rows)
    return out


def merge_diagonal_hits(hits: DataFrame) -> DataFrame:
    """Same-strand hits of one diagonal that overlap become one: (grp1_idx, grp2_idx, diag, start1, end1, n)."""
    rows = hits.filter(same_strand(F.col("strand"))).withColumn("diag", F.col("start2") - F.col("start1"))
    w = Window.partitionBy("grp1_idx", "grp2_idx", "diag").orderBy("start1", F.desc("end1"), "hit_idx")
    reach = F.max("end1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(reach.isNull() | (F.col("start1") > reach), 1).otherwise(0)).withColumn("part", F.sum("new").over(w))
    return rows.groupBy("grp1_idx", "grp2_idx", "diag", "part").agg(F.min("start1").alias("start1"), F.max("end1").alias("end1"), F.count(F.lit(1)).alias("n")).drop("part")
