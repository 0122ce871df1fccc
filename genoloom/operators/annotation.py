"""Building the annotation tables: gene numbers, tags, exons, keywords, per-project statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.ordering import carried, deal


def link_exons(gff: DataFrame) -> DataFrame:
    """Exons of each gene's first transcript, in file order (column ``line``).

    ``gff``: line, type, attrs (map). An exon belongs to the last gene above it, and only if its Parent is the
    first mRNA of that gene. Returns gene_id, mrna_id, line of the kept exons.
    """
    # a gene's rows stay together by file; the file is the unit that order is defined in
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = gff.withColumn("gene_line", F.last(F.when(F.col("type") == "gene", F.col("line")), ignorenulls=True).over(w))
    genes = rows.filter("type = 'gene'").select("file", F.col("line").alias("gene_line"), F.col("attrs")["ID"].alias("gene_id"))
    mrnas = rows.filter("type = 'mRNA'").select("file", "gene_line", "line", F.col("attrs")["ID"].alias("mrna_id"), F.col("attrs")["Parent"].alias("parent"))
    own = genes.join(mrnas, ["file", "gene_line"]).filter("parent = gene_id")
    first = own.groupBy("file", "gene_line", "gene_id").agg(F.min_by("mrna_id", "line").alias("mrna_id"))
    exons = rows.filter("type = 'exon'").select("file", "gene_line", "line", "g_start", "g_end", F.col("attrs")["Parent"].alias("mrna_id"))
    return exons.join(first, ["file", "gene_line", "mrna_id"]).select("gene_id", "mrna_id", "line", "g_start", "g_end")


def parse_attributes(text: Column) -> Column:
    """``k=v;k=v`` as a map; parts without '=' are left out; the last value of a repeated key stays."""
    parts = F.filter(F.split(text, ";"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def annot_keywords(genes: DataFrame, attrs: str = "attrs", keywords: list[str] | None = None, max_keys: int = 50) -> DataFrame:
    """(proj_idx, keyname, count) of attribute keys over genes, most frequent first, at most ``max_keys`` per
    project; only ``keywords`` if given."""
    rows = genes.select("proj_idx", F.explode(F.map_keys(parse_attributes(F.col(attrs)))).alias("keyname"))
    if keywords is not None:
        rows = rows.filter(F.col("keyname").isin(*keywords))
    counts = rows.groupBy("proj_idx", "keyname").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("proj_idx").orderBy(F.desc("count"), "keyname"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= max_keys)


def describe(genes: DataFrame, attrs: str = "attrs", keywords: list[str] | None = None) -> DataFrame:
    """``genes`` with ``description``: the kept ``k=v`` parts, '[no description]' if none is left."""
    parts = F.filter(F.split(F.col(attrs), ";"), lambda p: F.contains(p, F.lit("=")))
    if keywords is not None:
        parts = F.filter(parts, lambda p: F.substring_index(p, "=", 1).isin(*keywords))
    text = F.array_join(parts, ";")
    return genes.withColumn("description", F.when(text == "", "[no description]").otherwise(text))


def number_genes(genes: DataFrame) -> DataFrame:
    """``genes`` with ``genenum``: along each chromosome, genes that overlap by more than an end base, or lie
    inside one another, share a number; numbers run from 1 by start. The furthest end so far and the number are carried from range to range of
    a chromosome, so tasks follow the genes."""
    key, order = ["grp_idx"], ["g_start", "-g_end", "annot_idx"]
    rows = carried(deal(genes, key, order), key, order, __reach=("max", "g_end", "before"))
    new = F.when(F.col("__reach").isNull() | ((F.col("g_start") >= F.col("__reach")) & (F.col("g_end") > F.col("__reach"))), 1).otherwise(0)
    rows = carried(rows, key, order, genenum=("sum", new, "upto"))
    return rows.select(*genes.columns, F.col("genenum").cast("int").alias("genenum"))


def gene_suffix(rank: Column, size: Column) -> Column:
    """a to z, then a2 to z2, a3 and so on by rank (from 1); empty for a number of one gene."""
    letter = F.char((F.lit(97) + (rank - 1) % 26).cast("int"))
    turn = F.floor((rank - 1) / 26) + 1
    return F.when(size < 2, "").otherwise(F.concat(letter, F.when(turn > 1, turn.cast("string")).otherwise("")))


def gene_tags(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """``genes`` (numbered) with suffix and tag ``N.suffix (exons  total exon length)``."""
    per = exons.groupBy(F.col("gene_idx").alias("annot_idx")).agg(F.count(F.lit(1)).alias("n_exons"), F.sum(F.col("e_end") - F.col("e_start") + 1).alias("exon_len"))
    w = Window.partitionBy("grp_idx", "genenum")
    rank = F.row_number().over(w.orderBy(F.asc("g_start"), F.desc("g_end"), F.asc("annot_idx")))
    suffix = gene_suffix(rank, F.count(F.lit(1)).over(w))
    rows = genes.withColumn("suffix", suffix).join(per, "annot_idx", "left").fillna(0, ["n_exons", "exon_len"])
    tag = F.concat(F.col("genenum").cast("string"), F.lit("."), "suffix", F.lit(" ("), F.col("n_exons").cast("string"), F.lit(" "), F.lit(" "), F.format_number("exon_len", 0), F.lit(")"))
    return rows.withColumn("tag", tag)


def exon_numbers(exons: DataFrame, order: str = "e_start") -> DataFrame:
    """Exons numbered from 1 inside their gene."""
    return exons.withColumn("exon_num", F.row_number().over(Window.partitionBy("gene_idx").orderBy(order)))


def sort_groups(groups: DataFrame) -> DataFrame:
    """``groups`` with ``rank`` in natural order of their names per project: by text before the last number,
    then by that number."""
    w = Window.partitionBy("proj_idx").orderBy(F.regexp_replace("name", r"\d+$", ""), F.regexp_extract("name", r"(\d+)$", 1).try_cast("long"), "name", "grp_idx")
    return groups.withColumn("rank", F.row_number().over(w))


def project_view(groups: DataFrame, genes: DataFrame, exons: DataFrame) -> DataFrame:
    """Per chromosome: length, genes, mean gene length, exons, mean exon length; and a row of totals per project
    (grp_idx null) whose means are means of the chromosomes' means."""
    g = genes.groupBy("grp_idx").agg(F.count(F.lit(1)).alias("n_genes"), F.avg(F.col("g_end") - F.col("g_start") + 1).alias("avg_gene"))
    e = exons.groupBy("grp_idx").agg(F.count(F.lit(1)).alias("n_exons"), F.avg(F.col("e_end") - F.col("e_start") + 1).alias("avg_exon"))
    rows = groups.join(g, "grp_idx", "left").join(e, "grp_idx", "left").fillna(0, ["n_genes", "n_exons"])
    rows = rows.select("proj_idx", "grp_idx", "length", "n_genes", "avg_gene", "n_exons", "avg_exon")
    total = rows.groupBy("proj_idx").agg(
        F.lit(None).cast("int").alias("grp_idx"), F.sum("length").alias("length"), F.sum("n_genes").alias("n_genes"),
        F.avg("avg_gene").alias("avg_gene"), F.sum("n_exons").alias("n_exons"), F.avg("avg_exon").alias("avg_exon"),
    )
    return rows.unionByName(total)


def gene_model_stats(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """Per project: mean gene, exon and (positive) intron length, shortest and longest gene, exon cover in %."""
    intron = F.col("e_start") - F.lag("e_end").over(Window.partitionBy("gene_idx").orderBy("e_start")) - 1
    ex = exons.withColumn("intron", intron).groupBy("proj_idx").agg(
        F.avg(F.col("e_end") - F.col("e_start") + 1).alias("avg_exon"),
        F.avg(F.when(F.col("intron") > 0, F.col("intron"))).alias("avg_intron"),
        F.sum(F.col("e_end") - F.col("e_start") + 1).alias("sum_exon"),
    )
    size = F.col("g_end") - F.col("g_start") + 1
    ge = genes.groupBy("proj_idx").agg(F.avg(size).alias("avg_gene"), F.min(size).alias("min_gene"), F.max(size).alias("max_gene"), F.sum(size).alias("sum_gene"))
    return ge.join(ex, "proj_idx").select(
        "proj_idx", "avg_gene", "avg_exon", "avg_intron", "min_gene", "max_gene", (100.0 * F.col("sum_exon") / F.col("sum_gene")).alias("exon_cover")
    )
