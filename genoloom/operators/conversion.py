"""Preparation of sequence and annotation from public archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Percent codes that are decoded in descriptions.
CODES = {"%2C": ",", "%3B": ";", "%3D": "=", "%26": "&", "%25": "%", "%20": " "}
CUTS = [10_000, 100_000, 1_000_000, 10_000_000, 50_000_000, 100_000_000, 200_000_000]


def decode(text: Column) -> Column:
    for code, sign in CODES.items():
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def fasta_summary(seqs: DataFrame, cuts: list[int] = CUTS) -> DataFrame:
    """(kind, item, n): sequences by id prefix and by length range, total length, and count of each base letter."""
    size = F.length("seq").cast("long")
    bucket = F.lit(f">={cuts[-1]}")
    for c in reversed(cuts):
        bucket = F.when(size < c, f"<{c}").otherwise(bucket)
    prefix = F.regexp_extract("name", r"^(\D*)", 1)
    by = lambda kind, col: seqs.groupBy(col.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "item", "n")
    count = lambda b: F.coalesce(F.sum(F.length("seq") - F.length(F.replace(F.upper("seq"), F.lit(b), F.lit("")))), F.lit(0)).cast("long")
    totals = seqs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"), *[count(b).alias(b) for b in "ACGTN"])
    rows = totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("item"), F.col(c).alias("n")) for k, i, c in [("total", "bases", "total"), *(("base", b, b) for b in "ACGTN")]])).alias("x")).select("x.*")
    return by("prefix", prefix).union(by("length", bucket)).union(rows)


def classify_ids(headers: DataFrame, source: str = "ncbi", scaffolds: bool = True, organelles: bool = True) -> DataFrame:
    """(file, at, id, kind, newname): class of each header (chromosome, scaffold, mt, pt, unknown) and its new name.

    ncbi: NC_ is a chromosome, NT_ and NW_ are scaffolds, organelle words make mt or pt. ensembl: an id that is a
    number, X, Y or a Roman numeral of up to three letters, or a header that says so, is a chromosome. Only the
    first mt and pt stay; scaffolds and organelles may be left out. Names: Chr01, ChrX, s01, ChrMt, ChrPt.
    """
    text, word = F.lower("header"), F.regexp_extract("header", r"^>?\s*(\S+)", 1)
    mt, pt = text.rlike("mitochondri|(^|\\s)mt(\\s|$)"), text.rlike("chloroplast|plastid|(^|\\s)pt(\\s|$)")
    if source == "ncbi":
        chrom, scaf = F.startswith(word, F.lit("NC_")), word.rlike("^N[TW]_")
        told = F.regexp_extract("header", r"(?i)chromosome:?\s+([0-9]+|[XYZW])\b", 1)
    else:
        chrom, scaf = word.rlike(r"^([0-9]+|X|Y|[IVX]{1,3})$") | F.contains(text, F.lit("chromosome")), F.contains(text, F.lit("scaffold"))
        told = F.regexp_extract(word, r"^([0-9]+|[XYIV]+)$", 1)
    kind = F.when(mt, "mt").when(pt, "pt").when(chrom, "chromosome").when(scaf, "scaffold").otherwise("unknown")
    rows = headers.select("file", "at", word.alias("id"), kind.alias("kind"), told.alias("told"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("file", "at"))
    label = F.when(F.col("told") != "", F.col("told")).otherwise(F.col("nth").cast("string"))
    padded = F.when(label.rlike("^[0-9]$"), F.lpad(label, 2, "0")).otherwise(label)
    name = F.when(F.col("kind") == "chromosome", F.concat(F.lit("Chr"), padded)).when(F.col("kind") == "mt", "ChrMt").when(F.col("kind") == "pt", "ChrPt").otherwise(F.concat(F.lit("s"), F.when(F.col("nth") < 10, F.lpad(F.col("nth").cast("string"), 2, "0")).otherwise(F.col("nth").cast("string"))))
    out = rows.withColumn("nth", nth).withColumn("newname", name)
    keep = F.when(F.col("kind").isin("mt", "pt"), F.lit(organelles) & (F.col("nth") == 1)).when(F.col("kind").isin("scaffold", "unknown"), F.lit(scaffolds)).otherwise(True)
    return out.filter(keep).select("file", "at", "id", "kind", "newname")


def length_cutoffs(seqs: DataFrame, least: int = 10) -> DataFrame:
    """(rank, length): length at rank 10, 20 to 100 of the sorted lengths, as suggested least lengths; nothing for
    under ``least`` sequences. Only the 100 longest are ranked."""
    sizes = seqs.select(F.length("seq").cast("long").alias("length"))
    top = sizes.orderBy(F.desc("length")).limit(100)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("length"))))
    enough = sizes.limit(least).agg((F.count(F.lit(1)) >= least).alias("ok"))
    return ranked.filter("rank % 10 = 0").join(F.broadcast(enough.filter("ok")), how="left_semi", on=F.lit(True)).select("rank", "length")


def convert_gff(gff: DataFrame, id_map: DataFrame, source: str = "ncbi") -> DataFrame:
    """(seqid, type, g_start, g_end, strand, text): protein-coding genes on kept sequences, each with its first mRNA
    and that one's exons; ids lose their prefixes, codes are decoded, descriptions cut at '[Source'.

    ``id_map``: id, newname.
    """
    biotype, cut = ("gene_biotype", "^(gene|rna|exon)-") if source == "ncbi" else ("biotype", "^(gene|transcript|exon):")
    rows = gff.join(id_map.select(F.col("id").alias("seqid"), "newname"), "seqid")
    bare = lambda c: F.regexp_replace(c, cut, "")
    a = F.col("attrs")
    genes = rows.filter((F.col("type") == "gene") & (a[biotype] == "protein_coding")).withColumn("gene", a["ID"])
    mrna = rows.filter("type = 'mRNA'").withColumn("gene", a["Parent"])
    first = mrna.groupBy("gene").agg(F.min_by(F.struct("newname", "g_start", "g_end", "strand", "attrs", "line"), F.struct("file", "line")).alias("m"), F.count(F.lit(1)).alias("n"))
    kept = genes.join(first, "gene")
    # a source without descriptions takes the transcript's product
    desc = F.regexp_replace(decode(F.coalesce(F.get(F.array(a["description"]), F.lit(0)), F.col("m.attrs")["product"], F.lit(""))), r"\s*\[Source.*", "")
    g = kept.select(F.col("newname").alias("seqid"), F.lit("gene").alias("type"), "g_start", "g_end", "strand", F.concat(F.lit("ID="), bare(F.col("gene")), F.lit(";Name="), F.coalesce(a["Name"], F.lit("")), F.lit(";desc="), desc).alias("text"))
    m = kept.select(F.col("newname").alias("seqid"), F.lit("mRNA").alias("type"), F.col("m.g_start").alias("g_start"), F.col("m.g_end").alias("g_end"), "strand", F.concat(F.lit("ID="), bare(F.col("m.attrs")["ID"]), F.lit(";Parent="), bare(F.col("gene")), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text"))
    ids = kept.select(F.col("m.attrs")["ID"].alias("mrna"), "newname")
    ex = rows.filter("type = 'exon'").withColumn("mrna", a["Parent"]).drop("newname").join(ids, "mrna")
    e = ex.select(F.col("newname").alias("seqid"), F.lit("exon").alias("type"), "g_start", "g_end", "strand", F.concat(F.lit("Parent="), bare(F.col("mrna"))).alias("text"))
    return g.union(m).union(e)


def gff_summary(gff: DataFrame) -> DataFrame:
    """(kind, item, n): rows by type, genes by biotype, genes by attribute key."""
    by = lambda rows, kind, col: rows.groupBy(col.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "item", "n")
    genes = gff.filter("type = 'gene'")
    a = F.col("attrs")
    keys = genes.select(F.explode(F.map_keys("attrs")).alias("key"))
    return by(gff, "type", F.col("type")).union(by(genes, "biotype", F.coalesce(a["gene_biotype"], a["biotype"], F.lit("none")))).union(by(keys, "key", F.col("key")))


def genes_per_sequence(gff: DataFrame, id_map: DataFrame) -> DataFrame:
    """(seqid, kind, n): protein-coding genes per sequence; those on no kept sequence under kind 'not on sequence'."""
    a = F.col("attrs")
    genes = gff.filter((F.col("type") == "gene") & (F.coalesce(a["gene_biotype"], a["biotype"]) == "protein_coding"))
    rows = genes.join(id_map.select(F.col("id").alias("seqid"), "kind"), "seqid", "left")
    kind = F.coalesce("kind", F.lit("not on sequence"))
    return rows.groupBy(F.when(F.col("kind").isNull(), "").otherwise(F.col("seqid")).alias("seqid"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
