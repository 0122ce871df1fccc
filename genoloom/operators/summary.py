"""Summaries of a genome, a pair of genomes and its blocks; the data behind the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.intervals import coverage, midpoint
from genoloom.functions.scalars import same_strand


def genome_summary(groups: DataFrame, genes: DataFrame, exons: DataFrame) -> DataFrame:
    """Per project: sequences, bases, genes and exons with cover in %, mean and greatest length."""
    part = lambda df, s, e, p: df.groupBy("proj_idx").agg(F.count(F.lit(1)).alias(f"{p}s"), F.sum(F.col(e) - F.col(s) + 1).alias(f"{p}_bases"), F.avg(F.col(e) - F.col(s) + 1).alias(f"avg_{p}"), F.max(F.col(e) - F.col(s) + 1).alias(f"max_{p}"))
    g = groups.groupBy("proj_idx").agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").alias("bases"))
    rows = g.join(part(genes, "g_start", "g_end", "gene"), "proj_idx", "left").join(part(exons, "e_start", "e_end", "exon"), "proj_idx", "left")
    share = lambda p: (100.0 * F.col(f"{p}_bases") / F.col("bases")).alias(f"{p}_cover")
    return rows.select("proj_idx", "sequences", "bases", "genes", share("gene"), "avg_gene", "max_gene", "exons", share("exon"), "avg_exon", "max_exon")


def cluster_summary(hits: DataFrame, block_hits: DataFrame) -> DataFrame:
    """Per project pair: hits, opposite strand, in blocks, with two, one or no gene, sub-hits."""
    rows = hits.join(block_hits.withColumn("b", F.lit(1)), "hit_idx", "left")
    n, count = F.col("gene_overlap"), lambda c: F.sum(c.cast("long"))
    return rows.groupBy("proj1_idx", "proj2_idx").agg(
        F.count(F.lit(1)).alias("hits"), count(~same_strand(F.col("strand"))).alias("opposite"), count(F.col("b").isNotNull()).alias("in_blocks"),
        count(n == 2).alias("two"), count(n == 1).alias("one"), count(n == 0).alias("none"), F.sum("countpct").alias("subhits"), F.avg("countpct").alias("avg_subhits"),
    )


def genes_with_hits(genes: DataFrame, hit_annot: DataFrame) -> DataFrame:
    """Per project: genes, genes with a hit, share in %."""
    seen = hit_annot.select("annot_idx").distinct().withColumn("hit", F.lit(1))
    rows = genes.join(seen, "annot_idx", "left").groupBy("proj_idx").agg(F.count(F.lit(1)).alias("genes"), F.count("hit").alias("with_hits"))
    return rows.withColumn("share", 100.0 * F.col("with_hits") / F.col("genes"))


def side_intervals(df: DataFrame, last: int = 0) -> DataFrame:
    """(grp_idx, s, e) of both sides; ``last`` bases are left out at the end."""
    side = lambda k: df.select(F.col(f"grp{k}_idx").alias("grp_idx"), F.col(f"start{k}").alias("s"), (F.col(f"end{k}") - last).alias("e"))
    return side(1).union(side(2))


def pair_coverage(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per chromosome: bases that hits cover, and that blocks (without their last base) cover once and twice."""
    h = coverage(side_intervals(hits), ["grp_idx"], "s", "e").select("grp_idx", F.col("cover1").alias("hit_cover"))
    b = coverage(side_intervals(blocks, 1), ["grp_idx"], "s", "e").select("grp_idx", F.col("cover1").alias("block_cover1"), F.col("cover2").alias("block_cover2"))
    return h.join(b, "grp_idx", "left").fillna(0, ["block_cover1", "block_cover2"])


def length_histogram(lengths: DataFrame, column: str, cuts: list[int]) -> DataFrame:
    """(bucket, n): rows by length, ``<cut`` for each cut and ``>=last``."""
    bucket = F.lit(f">={cuts[-1]}")
    for c in reversed(cuts):
        bucket = F.when(F.col(column) < c, f"<{c}").otherwise(bucket)
    return lengths.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def block_pair_summary(finished: DataFrame) -> DataFrame:
    """Per project pair: blocks, inverted ones (correlation under 0), hits, bases of side 1."""
    return finished.groupBy("proj1_idx", "proj2_idx").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum((F.col("corr") < 0).cast("long")).alias("inverted"), F.sum("score").alias("hits"), F.sum(F.col("end1") - F.col("start1") + 1).alias("bases1")
    )


# --- data of the views ---


def dotplot_points(hits: DataFrame, block_hits: DataFrame) -> DataFrame:
    """(hit_idx, x, y, pctid, gene_overlap, in_block, size): midpoints; size is negative on opposite strands."""
    rows = hits.join(block_hits.withColumn("b", F.lit(1)), "hit_idx", "left")
    size = F.col("end1") - F.col("start1") + 1
    return rows.select(
        "hit_idx", "grp1_idx", "grp2_idx", midpoint(F.col("start1"), F.col("end1")).alias("x"), midpoint(F.col("start2"), F.col("end2")).alias("y"), "pctid", "gene_overlap",
        F.col("b").isNotNull().alias("in_block"), F.when(same_strand(F.col("strand")), size).otherwise(-size).alias("size"),
    )


def dotplot_stats(points: DataFrame, pctid: int = 0) -> DataFrame:
    """Counts by block membership and number of genes, with totals (null)."""
    return points.filter(F.col("pctid") >= pctid).cube("in_block", "gene_overlap").agg(F.count(F.lit(1)).alias("n"))


def linked_groups(blocks: DataFrame) -> DataFrame:
    return blocks.select("grp1_idx", "grp2_idx").distinct()


def filter_hit_map(hits: DataFrame, block: bool = False, sets: bool = False, both_needed: bool = False, genes: tuple[int, ...] = (), pctid: int = 0, block_number: int | None = None) -> DataFrame:
    """Hits to show: identity first, then a given block alone, then block and set membership (any, or both with
    ``both_needed``) or a number of genes; all pass if nothing is asked."""
    asks = []
    if block_number is not None:
        return hits.filter((F.col("pctid") >= pctid) & (F.col("blocknum") == block_number))
    if block:
        asks.append(F.col("block_idx").isNotNull())
    if sets:
        asks.append(F.coalesce(F.col("runsize"), F.lit(0)) > 0)
    if asks and both_needed:
        shown = asks[0] if len(asks) == 1 else asks[0] & asks[1]
    else:
        shown = F.lit(not asks and not genes)
        for a in asks:
            shown = shown | a
    if genes:
        shown = shown | F.col("gene_overlap").isin(*genes)
    return hits.filter((F.col("pctid") >= pctid) & shown)


def conserved_three_way(left: DataFrame, right: DataFrame, both: bool = True) -> DataFrame:
    """Hits that conserve a reference gene to its two neighbours: (side, hit_idx, annot_idx, mark).

    ``left`` and ``right``: hit_idx, annot_idx (the reference gene), genes (2: a gene on both sides, 1: on the
    reference's alone) and visible. A two-gene hit that is not visible completes a gene that has visible ones to the
    other neighbour only; of several, the first. Marks: ``shared`` for visible two-gene hits of genes with such hits to
    both neighbours (``both``) or to exactly one; ``completes`` for the completing hit; ``may_complete`` for visible
    one-gene hits of genes with two-gene hits to the other neighbour and none marked on this side."""
    sides = {"L": left, "R": right}
    two = {k: v.filter("genes = 2") for k, v in sides.items()}
    seen = {k: v.filter("visible").select("annot_idx").distinct().withColumn(f"seen{k}", F.lit(True)) for k, v in two.items()}
    fill = {k: v.filter("not visible").groupBy("annot_idx").agg(F.min("hit_idx").alias(f"fill{k}")) for k, v in two.items()}
    state = seen["L"].join(seen["R"], "annot_idx", "full").join(fill["L"], "annot_idx", "left").join(fill["R"], "annot_idx", "left").fillna(False, ["seenL", "seenR"])
    for k, o in (("L", "R"), ("R", "L")):
        state = state.withColumn(f"fill{k}", F.when(~F.col(f"seen{k}") & F.col(f"seen{o}"), F.col(f"fill{k}"))).withColumn(f"has{k}", F.col(f"seen{k}") | F.col(f"fill{k}").isNotNull())
    green = F.col("hasL") & F.col("hasR") if both else F.col("hasL") != F.col("hasR")
    out = None
    for k, o in (("L", "R"), ("R", "L")):
        rows = sides[k].join(state.withColumn("green", green), "annot_idx")
        done = (F.col("green") & F.col(f"has{k}")) | F.col(f"fill{k}").isNotNull()
        mark = F.when((F.col("genes") == 2) & F.col("visible") & F.col("green"), "shared").when(F.col("hit_idx") == F.col(f"fill{k}"), "completes")
        mark = mark.when((F.col("genes") == 1) & F.col("visible") & F.col(f"has{o}") & ~done, "may_complete")
        part = rows.select(F.lit(k).alias("side"), "hit_idx", "annot_idx", mark.alias("mark")).filter("mark is not null")
        out = part if out is None else out.union(part)
    return out


def circle_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks of every project pair, in both directions."""
    turned = {"grp1_idx": "grp2_idx", "grp2_idx": "grp1_idx", "start1": "start2", "start2": "start1", "end1": "end2", "end2": "end1", "proj1_idx": "proj2_idx", "proj2_idx": "proj1_idx"}
    cols = ["block_idx", *turned]
    return blocks.select(*cols).unionByName(blocks.select("block_idx", *[F.col(b).alias(a) for a, b in turned.items()]))


def subhit_table(hits: DataFrame, subs: str = "subs") -> DataFrame:
    """Sub-hits with their order, length, gap to the one before (null for the first) and a mark where they step
    back."""
    rows = hits.select("hit_idx", F.posexplode_outer(subs).alias("k", "s")).select("hit_idx", (F.col("k") + 1).alias("n"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    w = Window.partitionBy("hit_idx").orderBy("n")
    gap = F.col("start") - F.lag("end").over(w) - 1
    return rows.withColumn("length", F.col("end") - F.col("start") + 1).withColumn("gap", gap).withColumn("disorder", F.coalesce(F.col("start") < F.lag("start").over(w), F.lit(False)))


def drop_disordered_subhits(table: DataFrame, opposite: bool = False) -> DataFrame:
    """Sub-hits that do not step back (forward, on opposite strands) against the one before."""
    w = Window.partitionBy("hit_idx").orderBy("n")
    before = F.lag("start").over(w)
    keep = before.isNull() | (F.col("start") <= before if opposite else F.col("start") >= before)
    return table.withColumn("__k", keep).filter("__k").drop("__k")


def exon_table(exons: DataFrame) -> DataFrame:
    """Exons of a gene with length and distance from the one before (null for the first)."""
    w = Window.partitionBy("gene_idx").orderBy("e_start")
    return exons.select("gene_idx", "e_start", "e_end", (F.col("e_end") - F.col("e_start") + 1).alias("length"), (F.col("e_start") - F.lag("e_end").over(w) - 1).alias("intron"))
