"""Reports per reference gene, cluster and block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators.graph import connected_components
from genoloom.operators.pieces import walk_pieces


def gene_report(links: DataFrame, ref: int, species: list[int], all_species: bool = False) -> DataFrame:
    """One row per gene of project ``ref``: for each other species its partner genes, sorted, joined by commas
    (empty if none), and the number of species with a partner."""
    rows = links.filter((F.col("proj_idx") == ref) & F.col("oproj").isin(species)).select("annot_idx", "oproj", "other").distinct()
    per = rows.groupBy("annot_idx").pivot("oproj", species).agg(F.array_join(F.transform(F.sort_array(F.collect_list("other")), lambda x: x.cast("string")), ","))
    cols = [F.coalesce(F.col(str(p)), F.lit("")).alias(f"p{p}") for p in species]
    found = sum(((F.coalesce(F.col(str(p)), F.lit("")) != "").cast("int") for p in species), F.lit(0))
    out = per.select("annot_idx", *cols, found.alias("n_species"))
    return out.filter(F.col("n_species") == len(species)) if all_species else out


def gene_report_links(links: DataFrame, ref: int) -> DataFrame:
    """Per reference gene: partners, pairs of partners of different species that hit each other, and whether all
    such pairs do (complete)."""
    rows = links.filter(F.col("proj_idx") == ref).select("annot_idx", "oproj", "other").distinct()
    pair = links.select(F.col("annot_idx").alias("a"), F.col("other").alias("b")).distinct()
    linked = (
        rows.withColumnRenamed("other", "a").join(pair, "a")
        .join(rows.select("annot_idx", F.col("other").alias("b"), F.col("oproj").alias("bproj")), ["annot_idx", "b"])
        .filter("oproj < bproj")
        .groupBy("annot_idx").agg(F.count(F.lit(1)).alias("n_links"))
    )
    size = rows.groupBy("annot_idx", "oproj").agg(F.count(F.lit(1)).alias("n"))
    total = size.groupBy("annot_idx").agg(F.sum("n").alias("partners"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).cast("long").alias("possible"))
    out = total.join(linked, "annot_idx", "left").fillna(0, ["n_links"])
    return out.select("annot_idx", "partners", "n_links", ((F.col("possible") > 0) & (F.col("n_links") == F.col("possible"))).alias("complete"))


def multi_report(multi: DataFrame, ref: int) -> DataFrame:
    """Multi-hit groups of each reference gene as ``species:size`` parts, joined by blanks."""
    rows = multi.filter(F.col("proj_idx") == ref).groupBy("annot_idx", "oproj").agg(F.count(F.lit(1)).alias("n"))
    part = F.concat_ws(":", F.col("oproj").cast("string"), F.col("n").cast("string"))
    return rows.groupBy("annot_idx").agg(F.array_join(F.sort_array(F.collect_list(part)), " ").alias("groups"), F.sum("n").alias("hits"))


def collinear_report(sets: DataFrame, ref: int, species: list[int]) -> DataFrame:
    """Reference genes joined into unions when they share a collinear set: (union, genes, sets, species); unions
    that cover all of ``species`` only. ``sets``: set_id, annot_idx, proj_idx of a set's genes, oproj."""
    own = sets.filter(F.col("proj_idx") == ref).select("set_id", "annot_idx", "oproj").distinct()
    parts = connected_components(own.select("annot_idx", (-F.col("set_id") - 1).alias("s")), "annot_idx", "s")
    label = parts.filter("node > 0").select(F.col("node").alias("annot_idx"), "component")
    rows = own.join(label, "annot_idx").groupBy("component").agg(
        F.min("annot_idx").alias("union_gene"), F.countDistinct("annot_idx").alias("genes"), F.countDistinct("set_id").alias("sets"), F.countDistinct("oproj").alias("species")
    )
    return rows.filter(F.col("species") == len(species)).drop("component")


def cluster_report(clusters: DataFrame, hits: DataFrame, genes: DataFrame, species: list[int]) -> DataFrame:
    """Per cluster and species: its genes with their number of hits, sorted, as ``gene(n)`` joined by commas."""
    ends = hits.select(F.col("annot1_idx").alias("annot_idx")).union(hits.select("annot2_idx")).groupBy("annot_idx").agg(F.count(F.lit(1)).alias("n"))
    rows = clusters.join(genes.select("annot_idx", "proj_idx"), "annot_idx").join(ends, "annot_idx")
    entries = F.sort_array(F.collect_list(F.struct("annot_idx", "n")))
    text = F.array_join(F.transform(entries, lambda x: F.concat(x["annot_idx"].cast("string"), F.lit("("), x["n"].cast("string"), F.lit(")"))), ",")
    per = rows.groupBy("cluster").pivot("proj_idx", species).agg(text)
    return per.select("cluster", *[F.coalesce(F.col(str(p)), F.lit("")).alias(f"p{p}") for p in species])


def link_rows(links: list[tuple[int, int]], species: dict[int, int]) -> list[dict[int, int]]:
    """Rows (species to gene) of one cluster whose genes all link to each other, until every link stands in a row.

    Each gene in turn, by species and number, begins rows as long as it has a link that is in none: in each other species
    the first gene goes in whose link to it is still in none and which links to all others of the row; then, in species
    that are left, the first that links to all. A gene, and a link in second place, may stand in several rows."""
    near: dict[int, dict[int, list[int]]] = {g: {} for g in species}
    for a, b in sorted({(x, y) for p in links for x, y in (p, p[::-1])}):
        near[a].setdefault(species[b], []).append(b)
    linked = {g: {o for own in near[g].values() for o in own} for g in species}
    pair = lambda a, b: (a, b) if a < b else (b, a)
    open_ = {pair(*p) for p in links}
    kinds = sorted(set(species.values()))
    rows = []
    for gene in sorted(species, key=lambda g: (species[g], g)):
        while True:
            row = {species[gene]: gene}
            for strict in (True, False):
                if not strict and len(row) == 1:
                    break
                for kind in kinds:
                    if kind in row:
                        continue
                    for o in near[gene].get(kind, ()):
                        if (not strict or pair(gene, o) in open_) and all(o in linked[x] for x in row.values()):
                            open_.difference_update(pair(x, o) for x in row.values())
                            row[kind] = o
                            break
            if len(row) == 1:
                break
            rows.append(row)
    return rows


def _link_rows(cols: dict[str, np.ndarray]) -> tuple:
    a, b = cols["a"].tolist(), cols["b"].tolist()
    rows = link_rows(list(zip(a, b, strict=True)), dict(zip(a, cols["pa"].tolist(), strict=True)) | dict(zip(b, cols["pb"].tolist(), strict=True)))
    n = np.array([len(r) for r in rows], np.int64)
    text = np.array([",".join(f"{p}:{r[p]}" for p in sorted(r)) for r in rows], object)
    return np.full(len(rows), cols["cluster"][0]), np.arange(1, len(rows) + 1), text, n, n * (n - 1) // 2


def cluster_link_rows(clusters: DataFrame, hits: DataFrame, genes: DataFrame) -> DataFrame:
    """(cluster, row, genes, species, links): rows of genes that all link to each other, one per species, by
    :func:`link_rows`; a row is full when it has all species. Links are hits between two species. Clusters are streamed,
    each held alone, since a row's choices depend on the links that those before it have used."""
    place = lambda c, p: genes.select(F.col("annot_idx").alias(c), F.col("proj_idx").alias(p))
    rows = hits.select(F.col("annot1_idx").alias("a"), F.col("annot2_idx").alias("b")).filter("a is not null and b is not null").distinct()
    rows = rows.join(clusters.select(F.col("annot_idx").alias("a"), "cluster"), "a").join(place("a", "pa"), "a").join(place("b", "pb"), "b").filter("pa <> pb")
    kinds = {"cluster": "long", "row": "long", "genes": "string", "species": "long", "links": "long"}
    return walk_pieces(rows.select("cluster", "a", "b", "pa", "pb"), ["cluster"], ["a", "b"], _link_rows, kinds)


def report_annotation(genes: DataFrame, keys: list[str], width: int = 30, attrs: str = "attrs") -> DataFrame:
    """(annot_idx, note): values of the chosen keywords joined by '|', each cut to ``width``; '---' if none."""
    parts = F.split(F.col(attrs), ";")
    value = lambda k: F.element_at(F.concat(F.transform(F.filter(parts, lambda p: F.startswith(p, F.lit(f"{k}="))), lambda p: F.substring(p, len(k) + 2, width)), F.array(F.lit(None).cast("string"))), 1)
    note = F.concat_ws("|", *[value(k) for k in keys])
    return genes.select("annot_idx", F.when(note == "", "---").otherwise(note).alias("note"))


def block_summary(blocks: DataFrame) -> DataFrame:
    """Per chromosome pair: blocks and hits."""
    return blocks.groupBy("grp1_idx", "grp2_idx").agg(F.count(F.lit(1)).alias("blocks"), F.sum("score").alias("hits"))


def blocks_plus(finished: DataFrame, groups: DataFrame) -> DataFrame:
    """Block rows with chromosome names, hits, correlation, gaps, lengths and starts."""
    name = lambda k: groups.select(F.col("grp_idx").alias(f"grp{k}_idx"), F.col("name").alias(f"chr{k}"))
    size = lambda k: F.col(f"end{k}") - F.col(f"start{k}") + 1
    gap = lambda k: F.coalesce(F.col(f"avg_gap{k}"), size(k) / (F.col("score") - 1))
    rows = finished.join(name(1), "grp1_idx").join(name(2), "grp2_idx")
    return rows.select("block_idx", "chr1", "chr2", "blocknum", "score", "corr", gap(1).alias("gap1"), gap(2).alias("gap2"), size(1).alias("len1"), size(2).alias("len2"), "start1", "start2")


def blocks_genes(blocks: DataFrame, per_side: DataFrame, groups: DataFrame) -> DataFrame:
    """Block rows with names, intervals, number of genes and share of them with a block hit, per side."""
    name = lambda k: groups.select(F.col("grp_idx").alias(f"grp{k}_idx"), F.col("name").alias(f"chr{k}"))
    side = lambda k: per_side.filter(F.col("side") == k).select("block_idx", F.col("n_genes").alias(f"genes{k}"), F.col("share").alias(f"share{k}"))
    rows = blocks.join(name(1), "grp1_idx").join(name(2), "grp2_idx").join(side(1), "block_idx", "left").join(side(2), "block_idx", "left")
    return rows.select("block_idx", "chr1", "chr2", "blocknum", "start1", "end1", "start2", "end2", *[F.coalesce(f"{c}{k}", F.lit(0)).alias(f"{c}{k}") for k in (1, 2) for c in ("genes", "share")])
