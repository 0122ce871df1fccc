"""Questions over hits, genes and blocks: views, filters, groups, clusters, families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.intervals import bin_join, merge_intervals
from genoloom.operators.annotation import parse_attributes
from genoloom.operators.graph import connected_components
from genoloom.operators.ordering import global_rank


def hit_gene_block_view(hits: DataFrame, hit_annot: DataFrame, genes: DataFrame, block_hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hits with all their genes and their block; nulls where a hit has none."""
    g = genes.select("annot_idx", "g_start", "g_end", F.col("strand").alias("g_strand"))
    return hits.join(hit_annot, "hit_idx", "left").join(g, "annot_idx", "left").join(block_hits, "hit_idx", "left").join(blocks.select("block_idx", "blocknum"), "block_idx", "left")


def hit_rows(hits: DataFrame, genes: DataFrame, hit_annot: DataFrame) -> DataFrame:
    """One row per hit with the best gene of either side: its interval, length, strand, overlap and attributes."""
    out = hits
    for k in (1, 2):
        g = genes.select(
            F.col("annot_idx").alias(f"annot{k}_idx"), F.col("g_start").alias(f"gstart{k}"), F.col("g_end").alias(f"gend{k}"),
            (F.col("g_end") - F.col("g_start") + 1).alias(f"glen{k}"), F.col("strand").alias(f"gstrand{k}"), F.col("attrs").alias(f"attrs{k}"),
        )
        o = hit_annot.filter(F.col("side") == k).select("hit_idx", F.col("annot_idx").alias(f"annot{k}_idx"), F.col("olap").alias(f"olap{k}"))
        out = out.join(g, f"annot{k}_idx", "left").join(o, ["hit_idx", f"annot{k}_idx"], "left")
    return out


def with_minor(rows: DataFrame, overlaps: DataFrame) -> DataFrame:
    """``rows`` and one more row for each overlapping gene of a side that is not its best, with the other side
    filled from the best row; ``mark`` is '*' on these and '' otherwise. ``overlaps``: hit_idx, annot_idx, side."""
    out = rows.withColumn("mark", F.lit(""))
    for k in (1, 2):
        other = overlaps.filter(F.col("side") == k).select("hit_idx", F.col("annot_idx").alias("__minor"))
        extra = rows.join(other, "hit_idx").filter(~F.col("__minor").eqNullSafe(F.col(f"annot{k}_idx")))
        out = out.unionByName(extra.withColumn(f"annot{k}_idx", F.col("__minor")).drop("__minor").withColumn("mark", F.lit("*")))
    return out


# --- filters: boolean columns over hit rows ---


def in_pairs(pairs: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a | b, [(F.col("proj1_idx") == p) & (F.col("proj2_idx") == q) for p, q in pairs], F.lit(False))


def on_chromosomes(groups: list[int]) -> Column:
    """One chromosome: on either side; several: both sides in the list."""
    one, two = F.col("grp1_idx").isin(groups), F.col("grp2_idx").isin(groups)
    return one | two if len(groups) == 1 else one & two


def in_location(group: int, start: int = 0, end: int = 0) -> Column:
    """A side on ``group`` lies inside start to end (0: open)."""
    inside = lambda k: (F.col(f"grp{k}_idx") == group) & (F.lit(start == 0) | (F.col(f"start{k}") >= start)) & (F.lit(end == 0) | (F.col(f"end{k}") <= end))
    return inside(1) | inside(2)


def at_least(pctid: int = 0, sim: int = 0, cov: int = 0) -> Column:
    return (F.col("pctid") >= pctid) & (F.col("cvgpct") >= sim) & (F.col("score") >= cov)


def gene_mode(mode: str) -> Column:
    n = F.col("gene_overlap")
    return {"every": n > 0, "every+": n > 0, "one": n == 1, "both": n == 2, "none": n == 0}[mode]


def collinear_size(op: str, n: int) -> Column:
    size = F.col("runsize")
    return {">=": size >= n, "=": size == n, "<=": (size <= n) & (size > 0)}[op]


def gene_overlap_at_least(pct: int, both: bool) -> Column:
    one, two = (F.coalesce(F.col(f"olap{k}") >= pct, F.lit(False)) for k in (1, 2))
    return one & two if both else one | two


def describes(text: str, groups: list[int] | None = None) -> Column:
    """Case-insensitive substring of a side's attributes, for sides on the given chromosomes."""
    side = lambda k: F.coalesce(F.contains(F.lower(f"attrs{k}"), F.lit(text.lower())), F.lit(False)) & (F.lit(True) if groups is None else F.col(f"grp{k}_idx").isin(groups))
    return side(1) | side(2)


def self_half(lower: bool = True) -> Column:
    """A triangle of a self-comparison."""
    up = (F.col("grp1_idx") > F.col("grp2_idx")) | ((F.col("grp1_idx") == F.col("grp2_idx")) & (F.col("start1") > F.col("start2")))
    return up if lower else ~up


def filter_block(rows: DataFrame, block_hits: DataFrame, mode: str, number: int | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """yes: in a block; no: in none; number: in the blocks of that number."""
    if mode == "no":
        return rows.join(block_hits, "hit_idx", "left_anti")
    if mode == "number":
        block_hits = block_hits.join(blocks.filter(F.col("blocknum") == number).select("block_idx"), "block_idx")
    return rows.join(block_hits.select("hit_idx"), "hit_idx", "left_semi")


def filter_gene_number(rows: DataFrame, numbered: DataFrame, label: str, groups: list[int]) -> DataFrame:
    """Rows with a gene ``N`` or ``N.suffix`` of the given chromosomes on either side."""
    number, _, suffix = label.partition(".")
    genes = numbered.filter((F.col("genenum") == int(number)) & F.col("grp_idx").isin(groups))
    if suffix:
        genes = genes.filter(F.col("suffix") == suffix)
    ids = [genes.select(F.col("annot_idx").alias(f"annot{k}_idx")) for k in (1, 2)]
    found = rows.join(ids[0], "annot1_idx", "left_semi").select("hit_idx").union(rows.join(ids[1], "annot2_idx", "left_semi").select("hit_idx"))
    return rows.join(found.distinct(), "hit_idx", "left_semi")


# --- genes ---


def gene_links(hits: DataFrame) -> DataFrame:
    """Both directions of the hits between genes: (hit_idx, annot_idx, proj_idx, grp_idx, other, oproj, ogrp)."""
    rows = hits.filter("annot1_idx is not null and annot2_idx is not null")
    side = lambda a, b: rows.select("hit_idx", F.col(f"annot{a}_idx").alias("annot_idx"), F.col(f"proj{a}_idx").alias("proj_idx"), F.col(f"grp{a}_idx").alias("grp_idx"), F.col(f"annot{b}_idx").alias("other"), F.col(f"proj{b}_idx").alias("oproj"), F.col(f"grp{b}_idx").alias("ogrp"))
    return side(1, 2).union(side(2, 1))


def orphan_genes(genes: DataFrame, hit_annot: DataFrame, hits: DataFrame, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """Genes without a hit in the chosen project pairs (all, if None)."""
    if pairs is not None:
        hit_annot = hit_annot.join(hits.filter(in_pairs(pairs)).select("hit_idx"), "hit_idx", "left_semi")
    return genes.join(hit_annot.select("annot_idx"), "annot_idx", "left_anti")


def annotation_columns(genes: DataFrame, keys: list[str], attrs: str = "attrs") -> DataFrame:
    """A column for each keyword (repeated keys joined by ';', '---' if missing) and ``all`` with the whole text."""
    parts = F.split(F.col(attrs), ";")
    value = lambda k: F.array_join(F.transform(F.filter(parts, lambda p: F.startswith(p, F.lit(f"{k}="))), lambda p: F.substring(p, len(k) + 2, 1 << 20)), ";")
    return genes.select("annot_idx", *[F.when(value(k) == "", "---").otherwise(value(k)).alias(k.lower()) for k in keys], F.col(attrs).alias("all_text"))


def multi_hit_genes(links: DataFrame, n: int, same_chr: bool = False) -> DataFrame:
    """Hits of genes with ``n`` or more hits to another species (to one of its chromosomes, with ``same_chr``),
    with the group's size."""
    keys = ["annot_idx", "oproj"] + (["ogrp"] if same_chr else [])
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return links.withColumn("group_size", size).filter(F.col("group_size") >= n)


def tandem_multi_hits(multi: DataFrame, numbered: DataFrame, n: int) -> DataFrame:
    """Each multi-hit group split where the other genes' numbers do not follow each other; runs of ``n`` or more
    distinct numbers stay: (annot_idx, ogrp, run, size, first)."""
    num = numbered.select(F.col("annot_idx").alias("other"), F.col("genenum").alias("num"))
    rows = multi.join(num, "other").select("annot_idx", "ogrp", "num").distinct()
    run = F.col("num") - F.row_number().over(Window.partitionBy("annot_idx", "ogrp").orderBy("num"))
    return rows.withColumn("run", run).groupBy("annot_idx", "ogrp", "run").agg(F.count(F.lit(1)).alias("size"), F.min("num").alias("first")).filter(F.col("size") >= n)


def gene_number_groups(links: DataFrame, numbered: DataFrame) -> DataFrame:
    """(proj_idx, grp_idx, genenum, oproj, ogrp, size): hits by gene number and partner chromosome."""
    num = numbered.select("annot_idx", "genenum")
    return links.join(num, "annot_idx").groupBy("proj_idx", "grp_idx", "genenum", "oproj", "ogrp").agg(F.count(F.lit(1)).alias("size"))


def gene_clusters(hits: DataFrame) -> DataFrame:
    """(annot_idx, cluster): genes joined by two-gene hits, directly or through others; cluster is the smallest."""
    edges = hits.filter("annot1_idx is not null and annot2_idx is not null")
    return connected_components(edges, "annot1_idx", "annot2_idx").select(F.col("node").alias("annot_idx"), F.col("component").alias("cluster"))


def filter_clusters(clusters: DataFrame, genes: DataFrame, hits: DataFrame, n: int, include: list[int], exclude: list[int], per_species: bool = False, most: int | None = 20_000) -> DataFrame:
    """Clusters of ``n`` or more genes without genes of ``exclude`` and with genes of all of ``include`` (``n`` of
    each, if ``per_species``), of at most ``most`` hits; numbered by hits, largest first, then by cluster."""
    rows = clusters.join(genes.select("annot_idx", "proj_idx"), "annot_idx")
    count = lambda p: F.sum(F.when(F.col("proj_idx") == p, 1).otherwise(0))
    per = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_genes"), *[count(p).alias(f"p{p}") for p in {*include, *exclude}])
    need = n if per_species else 1
    ok = F.col("n_genes") >= n
    for p in include:
        ok = ok & (F.col(f"p{p}") >= need)
    for p in exclude:
        ok = ok & (F.col(f"p{p}") == 0)
    owned = hits.filter("annot2_idx is not null").select(F.col("annot1_idx").alias("annot_idx")).join(clusters, "annot_idx").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_hits"))
    kept = per.filter(ok).join(owned, "cluster").select("cluster", "n_genes", "n_hits")
    if most is not None:
        kept = kept.filter(F.col("n_hits") <= most)
    return global_rank(kept, [F.desc("n_hits"), F.asc("cluster")], "number")


def region_families(hits: DataFrame, width: int = 100_000, n: int = 1) -> DataFrame:
    """(hit_idx, family): hits linked when their intervals share a base on either side, on any two sides.

    The sides' intervals are merged into regions first, so a hit is linked to its regions, not to each hit there.
    """
    sides = [hits.select("hit_idx", F.col(f"proj{k}_idx").alias("proj_idx"), F.col(f"grp{k}_idx").alias("grp_idx"), F.col(f"start{k}").alias("s"), F.col(f"end{k}").alias("e")) for k in (1, 2)]
    both = sides[0].union(sides[1])
    regions = merge_intervals(both, ["grp_idx"], "s", "e").select("grp_idx", F.col("s").alias("rs"), F.col("e").alias("re"))
    owned = bin_join(both, regions, ["grp_idx"], "s", "e", "rs", "re", width)
    # a region's node number is negative, so it can't meet a hit's
    edges = owned.select("hit_idx", (-(F.col("grp_idx").cast("long") * (1 << 40) + F.col("rs"))).alias("region"))
    parts = connected_components(edges, "hit_idx", "region")
    named = parts.filter("node >= 0").select(F.col("node").alias("hit_idx"), "component")
    w = Window.partitionBy("component")
    return named.withColumn("family", F.min("hit_idx").over(w)).withColumn("size", F.count(F.lit(1)).over(w)).filter(F.col("size") >= n).select("hit_idx", "family", "size")


def filter_families(families: DataFrame, hits: DataFrame, include: list[int], exclude: list[int], unannotated: list[int] | None = None) -> DataFrame:
    """Families with hits on all of ``include``, on none of ``exclude`` and, for projects in ``unannotated``, with
    no gene there."""
    rows = families.join(hits.select("hit_idx", "proj1_idx", "proj2_idx", "annot1_idx", "annot2_idx"), "hit_idx")
    on = lambda p: (F.col("proj1_idx") == p) | (F.col("proj2_idx") == p)
    gene = lambda p: ((F.col("proj1_idx") == p) & F.col("annot1_idx").isNotNull()) | ((F.col("proj2_idx") == p) & F.col("annot2_idx").isNotNull())
    tests = [F.bool_or(on(p)) for p in include] + [~F.bool_or(on(p)) for p in exclude] + [~F.bool_or(gene(p)) for p in unannotated or []]
    per = rows.groupBy("family").agg(F.count(F.lit(1)).alias("size"), reduce(lambda a, b: a & b, tests, F.lit(True)).alias("ok"))
    return per.filter("ok").select("family", "size")


def family_regions(families: DataFrame, hits: DataFrame) -> DataFrame:
    """(family, proj_idx, regions): distinct merged regions of each family per species."""
    sides = [hits.select("hit_idx", F.col(f"proj{k}_idx").alias("proj_idx"), F.col(f"grp{k}_idx").alias("grp_idx"), F.col(f"start{k}").alias("s"), F.col(f"end{k}").alias("e")) for k in (1, 2)]
    rows = sides[0].union(sides[1]).join(families.select("hit_idx", "family"), "hit_idx")
    return merge_intervals(rows, ["family", "proj_idx", "grp_idx"], "s", "e").groupBy("family", "proj_idx").agg(F.count(F.lit(1)).alias("regions"))


def natural_key(text: Column, parts: int = 4) -> list[Column]:
    """Sort keys of dotted text in natural order, blanks last: per part its number, then its text."""
    pieces = F.split(text, r"\.")
    keys = [(text.isNull() | (text == "")).cast("int")]
    for k in range(parts):
        part = F.get(pieces, F.lit(k))
        keys += [F.coalesce(F.regexp_extract(part, r"^\D*(\d+)", 1).try_cast("long"), F.lit(-1)), F.coalesce(part, F.lit(""))]
    return keys


def result_summary(rows: DataFrame, block_hits: DataFrame) -> DataFrame:
    """One row: hits, hits in blocks, blocks, with two genes, one, none."""
    joined = rows.join(block_hits, "hit_idx", "left")
    n = F.col("gene_overlap")
    count = lambda c: F.sum(c.cast("long"))
    return joined.agg(
        F.count(F.lit(1)).alias("hits"), count(F.col("block_idx").isNotNull()).alias("block_hits"), F.countDistinct("block_idx").alias("blocks"),
        count(n == 2).alias("both"), count(n == 1).alias("one"), count(n == 0).alias("none"),
    )


def species_summary(rows: DataFrame) -> DataFrame:
    """Per species: hits, annotated hits, unique genes, chromosomes seen."""
    sides = [rows.select("hit_idx", F.col(f"proj{k}_idx").alias("proj_idx"), F.col(f"grp{k}_idx").alias("grp_idx"), F.col(f"annot{k}_idx").alias("annot_idx")) for k in (1, 2)]
    return sides[0].union(sides[1]).groupBy("proj_idx").agg(
        F.count(F.lit(1)).alias("hits"), F.count("annot_idx").alias("annotated"), F.countDistinct("annot_idx").alias("genes"), F.countDistinct("grp_idx").alias("chromosomes")
    )


def find_rows(rows: DataFrame, column: str, text: str, mode: str = "substring") -> DataFrame:
    """exact, substring (either case) or last (the last number of the text)."""
    col = F.col(column).cast("string")
    if mode == "exact":
        return rows.filter(col == text)
    if mode == "last":
        return rows.filter(F.regexp_extract(col, r"(\d+)\D*$", 1) == text)
    return rows.filter(F.contains(F.lower(col), F.lit(text.lower())))


def extent(rows: DataFrame, keys: list[str], pad: int = 0) -> DataFrame:
    """Least start and greatest end of both sides within ``keys``, with padding."""
    return rows.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.min("start1") - pad).alias("start1"), (F.max("end1") + pad).alias("end1"),
        F.greatest(F.lit(1), F.min("start2") - pad).alias("start2"), (F.max("end2") + pad).alias("end2"), F.count(F.lit(1)).alias("hits"),
    )


def gene_hits(hits: DataFrame, hit_annot: DataFrame, genes: DataFrame) -> DataFrame:
    """All hits of the given genes: overlap, the partner side's interval, and a mark where the gene is not the
    hit's best on its side."""
    rows = hit_annot.join(genes.select("annot_idx"), "annot_idx", "left_semi").join(hits, "hit_idx")
    first = F.col("side") == 1
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    best = pick("annot1_idx", "annot2_idx").eqNullSafe(F.col("annot_idx"))
    return rows.select("annot_idx", "hit_idx", "side", "olap", pick("grp2_idx", "grp1_idx").alias("ogrp"), pick("start2", "start1").alias("ostart"), pick("end2", "end1").alias("oend"), F.when(best, "").otherwise("*").alias("mark"))


def keyword_map(genes: DataFrame) -> DataFrame:
    return genes.withColumn("attr_map", parse_attributes(F.col("attrs")))
