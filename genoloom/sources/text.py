"""Sequence, annotation and alignment text: parsing lines, reading and writing files.

Parsers take DataFrames of lines (file, line, value), so the same code serves files, gz files and tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoloom.operators.annotation import parse_attributes
from genoloom.operators.ordering import carried, deal, global_rank

FASTA_SUFFIXES = ("fa", "fna", "fas", "fasta", "seq")
#: Types of annotation rows that are loaded.
GFF_TYPES = ("gene", "mRNA", "exon", "gap", "centromere")
CHUNK = 1_000_000


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files (gz too) with their file and number from 1: (file, line, value).

    Large files are read in blocks by several tasks; a line is numbered by its block's place in the file and its place in
    the block, and counts are carried from range to range of a file. A gz file is one block.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    key, order = ["file"], ["block", "place"]
    return carried(deal(rows, key, order), key, order, line=("sum", F.lit(1), "upto")).select("file", "line", "value")


def fasta_chunks(lines: DataFrame, prefix: str = "", min_len: int = 0, size: int = CHUNK) -> DataFrame:
    """(file, at, name, fullname, length, chunk (from 0), seq): sequences in pieces of ``size`` bases, straight from lines.

    '#' and blank lines are skipped; the name is the first word without ``prefix`` (any case), headers without it
    are dropped, as are sequences under ``min_len`` and repeats of a name (the first stays). White space goes, and
    every letter but ACGTN (any case) becomes N.

    A line's header and its first base's place are running values that are carried from range to range of a file, so
    neither a file nor a sequence is in one task or cell; a row holds no more than ``size`` bases."""
    head = F.startswith(F.col("value"), F.lit(">"))
    key, order, own = ["file"], ["line"], ["file", "at"]
    rows = deal(lines.filter((F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#"))).select("file", "line", "value"), key, order)
    rows = carried(rows, key, order, at=("max", F.when(head, F.col("line")), "upto"))
    heads = rows.filter(head).select(*own, F.regexp_extract("value", r"^>\s*([\w.:-]+)", 1).alias("word"), F.expr("substring(value, 2)").alias("fullname"))
    heads = heads.filter(F.startswith(F.lower("word"), F.lit(prefix.lower()))).withColumn("name", F.expr(f"substring(word, {len(prefix) + 1})"))
    body = rows.filter(~head & F.col("at").isNotNull()).withColumn("bases", F.regexp_replace(F.regexp_replace("value", r"\s", ""), "[^acgtnACGTN]", "N"))
    body = body.withColumn("n", F.length("bases").cast("long")).drop("value")
    heads = heads.join(body.groupBy(*own).agg(F.sum("n").alias("length")), own).filter(F.col("length") >= min_len)
    first = heads.groupBy("name").agg(F.min(F.struct(*own)).alias("f")).select("f.*")
    body = carried(body, own, order, start=("sum", "n", "before")).filter("n > 0")
    chunk = F.explode(F.expr(f"sequence(start div {size}, (start + n - 1) div {size})"))
    pieces = body.withColumn("chunk", chunk).withColumn("from", F.greatest(F.lit(0), F.col("chunk") * size - F.col("start")))
    pieces = pieces.withColumn("piece", F.substring(F.col("bases"), (F.col("from") + 1).cast("int"), F.least(F.lit(size), (F.col("chunk") + 1) * size - F.col("start") - F.col("from")).cast("int")))
    listed = F.sort_array(F.collect_list(F.struct("line", "piece")))
    chunks = pieces.groupBy(*own, "chunk").agg(F.array_join(F.transform(listed, lambda x: x["piece"]), "").alias("seq"))
    return chunks.join(heads.join(first, own, "left_semi"), own).select(*own, "name", "fullname", "length", F.col("chunk").cast("int").alias("chunk"), "seq")


def parse_fasta(lines: DataFrame, prefix: str = "", min_len: int = 0) -> DataFrame:
    """(file, name, fullname, seq, length): one row per sequence, by the rules of :func:`fasta_chunks`; for sequences that
    fit into a cell."""
    listed = F.sort_array(F.collect_list(F.struct("chunk", "seq")))
    whole = fasta_chunks(lines, prefix, min_len).groupBy("file", "at", "name", "fullname", "length").agg(F.array_join(F.transform(listed, lambda x: x["seq"]), "").alias("seq"))
    return whole.select("file", "name", "fullname", "seq", "length")


def read_fasta(spark: SparkSession, paths: str | list[str], prefix: str = "", min_len: int = 0) -> DataFrame:
    return parse_fasta(read_lines(spark, paths), prefix, min_len)


def chunk_sequence(seqs: DataFrame, key: str = "name", size: int = CHUNK) -> DataFrame:
    """(key, chunk (from 0), seq): sequences cut into pieces of ``size`` bases."""
    last = F.greatest(F.lit(0), F.ceil(F.length("seq") / size).cast("int") - 1)
    rows = seqs.select(key, "seq", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select(key, "chunk", F.substring(F.col("seq"), F.col("chunk") * size + 1, F.lit(size)).alias("seq"))


def parse_gff(lines: DataFrame, types: tuple[str, ...] = GFF_TYPES) -> DataFrame:
    """(file, line, seqid, type, g_start, g_end, strand, attrs (map), text): rows of nine columns of the given types;
    quotes go, other strands become '+', reversed ends are exchanged."""
    rows = lines.filter(~F.startswith(F.col("value"), F.lit("#"))).withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 9)
    text = F.replace(F.col("f")[8], F.lit('"'), F.lit(""))
    a, b = F.col("f")[3].try_cast("int"), F.col("f")[4].try_cast("int")
    rows = rows.select(
        "file", "line", F.col("f")[0].alias("seqid"), F.col("f")[2].alias("type"), F.least(a, b).alias("g_start"), F.greatest(a, b).alias("g_end"),
        F.when(F.col("f")[6].isin("+", "-"), F.col("f")[6]).otherwise("+").alias("strand"), parse_attributes(text).alias("attrs"), text.alias("text"),
    )
    return rows.filter(F.col("type").isin(*types) & F.col("g_start").isNotNull() & F.col("g_end").isNotNull())


def read_gff(spark: SparkSession, paths: str | list[str], groups: DataFrame | None = None) -> DataFrame:
    """Annotation rows; only of sequences in ``groups`` (name), if given."""
    rows = parse_gff(read_lines(spark, paths))
    return rows if groups is None else rows.join(groups.select(F.col("name").alias("seqid")), "seqid", "left_semi")


def parse_hits(lines: DataFrame, most_sim: int | None = 110) -> DataFrame:
    """Alignment rows: query, target, start1, end1, start2, end2, len1, len2, match, pctid, pctsim, strand.

    Rows of 13 or more fields that begin with a digit; with more, field 8 is the similarity and names shift by
    two. A similarity over ``most_sim`` is 0. Strands come from the order of the ends, which are then sorted; the
    match length is the greater of both lengths.
    """
    f = F.col("f")
    rows = lines.filter(F.col("value").rlike(r"^\s*\d")).withColumn("f", F.split(F.trim("value"), r"\s+")).filter(F.size("f") >= 13)
    wide = F.size("f") > 13
    num = lambda k: f[k].cast("int")
    way = lambda a, b: F.when(num(a) <= num(b), "+").otherwise("-")
    sim = F.when(wide, F.floor(f[7].cast("double") + 0.5).cast("int")).otherwise(0)
    if most_sim is not None:
        sim = F.when(sim > most_sim, 0).otherwise(sim)
    return rows.select(
        "file", "line", F.when(wide, F.get(f, F.lit(14))).otherwise(f[12]).alias("query"), F.when(wide, F.get(f, F.lit(13))).otherwise(f[11]).alias("target"),
        F.least(num(2), num(3)).alias("start1"), F.greatest(num(2), num(3)).alias("end1"), F.least(num(0), num(1)).alias("start2"), F.greatest(num(0), num(1)).alias("end2"),
        num(5).alias("len1"), num(4).alias("len2"), F.greatest(num(4), num(5)).alias("match"), F.floor(f[6].cast("double") + 0.5).cast("int").alias("pctid"), sim.alias("pctsim"),
        F.concat_ws("/", way(2, 3), way(0, 1)).alias("strand"),
    )


def read_hits(spark: SparkSession, paths: str | list[str], groups: DataFrame | None = None) -> DataFrame:
    """Alignment rows; only of known sequences (``groups``: name), if given."""
    rows = parse_hits(read_lines(spark, paths))
    if groups is None:
        return rows
    for c in ("query", "target"):
        rows = rows.join(groups.select(F.col("name").alias(c)), c, "left_semi")
    return rows


# --- sinks ---


def write_tables(tables: dict[str, DataFrame], path: str, partition: str | None = None) -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def delimited(df: DataFrame, sep: str, row_number: list[Column] | None = None) -> DataFrame:
    """Rows as text of one column ``value``, nulls empty; with ``row_number``, numbered in that order first."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    quoted = [F.when(c.contains(sep) | c.rlike("[\"\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cols]
    if row_number:
        df, quoted = global_rank(df, row_number, "__place"), [F.col("__place").cast("string"), *quoted]
    return df.select(F.concat_ws(sep, *quoted).alias("value"))


def write_delimited(df: DataFrame, path: str, sep: str = ",", comments: list[str] | None = None) -> None:
    """Text files of ``df`` with a header row; ``###`` lines of comments go to a part of their own in the folder."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    if comments:
        spark = df.sparkSession
        spark.createDataFrame([(f"### {c}",) for c in comments], "value string").coalesce(1).write.mode("append").text(path)


def gff_text(rows: DataFrame, source: str = "genoloom") -> DataFrame:
    """Nine-column text (value) of rows: seqid, type, g_start, g_end, strand, text."""
    return rows.select(F.concat_ws("\t", "seqid", F.lit(source), "type", F.col("g_start").cast("string"), F.col("g_end").cast("string"), F.lit("."), "strand", F.lit("."), "text").alias("value"))


def fasta_text(rows: DataFrame) -> DataFrame:
    """Two lines per row (value): header ``>SEQ000001  species Chr c Start s End e Pair#n`` and bases, from rows with
    n, species, chr, start, end, pair, seq."""
    head = F.format_string(">SEQ%06d  %s Chr %s Start %d End %d Pair#%d", "n", "species", "chr", "start", "end", "pair")
    return rows.select("n", F.concat(head, F.lit("\n"), F.col("seq")).alias("value"))


def split_by_sequence(df: DataFrame, path: str, name: str = "seqid") -> None:
    """One folder per chromosome, all scaffolds together in one."""
    part = F.when(F.lower(name).rlike("^(s|scaf|unk)"), "scaffolds").otherwise(F.col(name))
    df.withColumn("chr_or_scaf", part).write.mode("overwrite").partitionBy("chr_or_scaf").parquet(path)


# --- sequence access ---


def fetch_sequence(regions: DataFrame, chunks: DataFrame, key: str = "name", size: int = CHUNK) -> DataFrame:
    """Bases start to end (1-based, inclusive) of each region: (region, seq), put together across chunks."""
    first, last = F.floor((F.col("start") - 1) / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int")
    rows = regions.withColumn("chunk", F.explode(F.sequence(first, last))).join(chunks, [key, "chunk"])
    lo = F.greatest(F.lit(1), F.col("start") - F.col("chunk") * size)
    hi = F.least(F.lit(size), F.col("end") - F.col("chunk") * size)
    piece = F.substring(F.col("seq"), lo.cast("int"), (hi - lo + 1).cast("int"))
    return rows.groupBy("region").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))


def find_gaps(chunks: DataFrame, key: str = "name", size: int = CHUNK, min_len: int = 30_000) -> DataFrame:
    """(key, start, end, length): runs of N longer than ``min_len``, joined across chunks."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        find = re.compile("[Nn]+")
        for pdf in batches:
            out = [(k, int(c) * size + m.start() + 1, int(c) * size + m.end()) for k, c, s in zip(pdf[key], pdf["chunk"], pdf["seq"], strict=True) for m in find.finditer(s)]
            yield pd.DataFrame(out, columns=[key, "s", "e"])

    parts = chunks.select(key, "chunk", "seq").mapInPandas(runs, f"`{key}` {chunks.schema[key].dataType.simpleString()}, s long, e long")
    w = Window.partitionBy(key).orderBy("s")
    rows = parts.withColumn("new", F.when(F.lag("e").over(w) + 1 == F.col("s"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    out = rows.groupBy(key, "run").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("run").withColumn("length", F.col("end") - F.col("start") + 1)
    return out.filter(F.col("length") > min_len)


def hard_mask(seqs: DataFrame) -> DataFrame:
    """Lower-case bases become N; ``masked`` counts them."""
    low = F.length("seq") - F.length(F.regexp_replace("seq", "[acgtn]", ""))
    return seqs.withColumn("masked", low.cast("long")).withColumn("seq", F.translate("seq", "acgtn", "NNNNN"))


def mask_non_genic(chunks: DataFrame, genes: DataFrame, key: str = "name", size: int = CHUNK) -> DataFrame:
    """Chunks with all bases outside genes (key, g_start, g_end) replaced by N; genes are dealt to the chunks they
    touch first, and each chunk is filled from its own merged genes."""
    spans = genes.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("g_start") - 1) / size).cast("int"), F.floor((F.col("g_end") - 1) / size).cast("int"))))
    base = F.col("chunk") * size
    spans = spans.select(key, "chunk", F.struct(F.greatest(F.lit(1), F.col("g_start") - base).cast("int").alias("s"), F.least(F.lit(size), F.col("g_end") - base).cast("int").alias("e")).alias("x"))
    held = spans.groupBy(key, "chunk").agg(F.sort_array(F.collect_set("x")).alias("spans"))

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for seq, keep in zip(pdf["seq"], pdf["spans"], strict=True):
                parts, at = [], 0
                for r in keep if keep is not None else []:
                    a, b = max(at, r["s"] - 1), min(len(seq), r["e"])
                    if b > a:
                        parts += ["N" * (a - at), seq[a:b]]
                        at = b
                out.append("".join(parts) + "N" * (len(seq) - at))
            yield pdf.assign(seq=out)[[key, "chunk", "seq"]]

    return chunks.select(key, "chunk", "seq").join(held, [key, "chunk"], "left").mapInPandas(fill, chunks.select(key, "chunk", "seq").schema)
