"""Queries of sources, sinks and conversion, over text views of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators import annotation as an
from genoloom.operators import conversion as cv
from genoloom.operators.lineage import new_folder
from genoloom.plans.fixtures import Views
from genoloom.plans.registry import query
from genoloom.sources import text as tx


def _fasta_lines(v: Views) -> DataFrame:
    """Each sequence as a header and lines of 500 letters, in 16 files."""
    file = F.concat(F.lit("f"), (F.col("seq_idx") % 16).cast("string"))
    heads = v.seqs.select(file.alias("file"), (F.col("seq_idx") * 100_000).alias("line"), F.concat(F.lit(">"), "name", F.lit(" draft")).alias("value"))
    body = tx.chunk_sequence(v.documents.select(F.col("doc_id").alias("seq_idx"), F.col("text").alias("seq")), "seq_idx", 500)
    # line breaks and marks inside a text would end a line, so they are letters of the sequence here
    clean = F.regexp_replace("seq", r"[\n#>\s]", "N")
    return heads.union(body.select(file.alias("file"), (F.col("seq_idx") * 100_000 + F.col("chunk") + 1).alias("line"), clean.alias("value")))


@query("s1_parse_fasta", " SELECT name, CAST(length(seq) AS BIGINT) AS length, seq FROM seqs WHERE length(seq) >= 1000")
def _(v: Views) -> DataFrame:
    return tx.parse_fasta(_fasta_lines(v), "", 1000).select("name", "length", "seq")


@query(
    "s1_fasta_chunks",
    """ SELECT name, CAST(length(seq) AS BIGINT) AS length, CAST(k AS INT) AS chunk, substr(seq, k * 700 + 1, 700) AS seq FROM (
  SELECT name, seq, unnest(range(0, (length(seq) + 699) // 700)) AS k FROM seqs WHERE length(seq) >= 300) x""",
)
def _(v: Views) -> DataFrame:
    return tx.fasta_chunks(_fasta_lines(v), "", 300, 700).select("name", "length", "chunk", "seq")


def _chunks(v: Views, size: int = 1000) -> DataFrame:
    return tx.chunk_sequence(v.seqs, "name", size)


@query("s2_chunk_sequence", " SELECT name, CAST(k AS INT) AS chunk, substr(seq, k * 1000 + 1, 1000) AS seq FROM (SELECT name, seq, unnest(range(0, greatest(1, (length(seq) + 999) // 1000))) AS k FROM seqs) x")
def _(v: Views) -> DataFrame:
    return _chunks(v)


def _gff(v: Views) -> DataFrame:
    return tx.parse_gff(v.gff_lines.select(F.lit("f").alias("file"), "line", "value"))


@query(
    "s3_parse_gff",
    """ SELECT annot_idx * 10 AS line, concat('g', grp_idx) AS seqid, 'gene' AS type, g_start, g_end, strand, concat('gene-', annot_idx) AS id FROM genes
UNION ALL SELECT annot_idx * 10 + 1, concat('g', grp_idx), 'mRNA', g_start, g_end, strand, concat('rna-', annot_idx) FROM genes
UNION ALL SELECT gene_idx * 10 + 1 + exon, concat('g', grp_idx), 'exon', e_start, e_end, '+', concat('exon-', gene_idx, '-', exon) FROM exons""",
)
def _(v: Views) -> DataFrame:
    return _gff(v).select("line", "seqid", "type", "g_start", "g_end", "strand", F.col("attrs")["ID"].alias("id"))


@query(
    "s4_parse_hits",
    """ SELECT hit_idx AS line, concat('g', grp1_idx) AS query, concat('g', grp2_idx) AS target, start1, end1, start2, end2, greatest(end1 - start1, end2 - start2) + 1 AS match, pctid, CASE WHEN cvgpct + 1 > 110 THEN 0 ELSE cvgpct + 1 END AS pctsim,
  CASE WHEN strand IN ('+/+', '-/-') THEN '+/+' ELSE '-/+' END AS strand FROM hits""",
)
def _(v: Views) -> DataFrame:
    rows = tx.parse_hits(v.mum_lines.select(F.lit("f").alias("file"), "line", "value"))
    return rows.select("line", "query", "target", "start1", "end1", "start2", "end2", "match", "pctid", "pctsim", "strand")


@query("s5_write_read_tables", " SELECT 'genes' AS name, proj_idx, count(*) AS n, CAST(sum(g_start) AS BIGINT) AS starts FROM genes GROUP BY 2 UNION ALL SELECT 'hits', proj1_idx, count(*), CAST(sum(start1) AS BIGINT) FROM hits GROUP BY 2")
def _(v: Views) -> DataFrame:
    tables = {"genes": v.genes, "hits": v.hits.withColumn("proj_idx", F.col("proj1_idx"))}
    path = new_folder(v.spark, "tables")
    tx.write_tables(tables, path, "proj_idx")
    back = tx.read_tables(v.spark, path, list(tables))
    sums = [back[n].groupBy("proj_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(c).alias("starts")).select(F.lit(n).alias("name"), "proj_idx", "n", "starts") for n, c in (("genes", "g_start"), ("hits", "start1"))]
    return sums[0].union(sums[1])


@query("s9_split_by_sequence", " SELECT CASE WHEN seq_idx % 4 = 0 THEN 'Chr' || seq_idx % 12 ELSE 'scaffolds' END AS chr_or_scaf, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases FROM seqs GROUP BY 1")
def _(v: Views) -> DataFrame:
    # a quarter of the sequences are chromosomes, the others scaffolds
    name = F.when(F.col("seq_idx") % 4 == 0, F.concat(F.lit("Chr"), (F.col("seq_idx") % 12).cast("string"))).otherwise(F.concat(F.lit("Scaf"), F.col("seq_idx").cast("string")))
    path = new_folder(v.spark, "split")
    tx.split_by_sequence(v.seqs.select(name.alias("seqid"), "seq"), path)
    return v.spark.read.parquet(path).groupBy("chr_or_scaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bases"))


@query("s6_delimited", " SELECT concat_ws(',', CAST(block_idx AS VARCHAR), CAST(grp1_idx AS VARCHAR), CASE WHEN blocknum % 2 = 0 THEN '\"a,\"\"b\"' ELSE '' END) AS value FROM blocks")
def _(v: Views) -> DataFrame:
    return tx.delimited(v.blocks.select("block_idx", "grp1_idx", F.when(F.col("blocknum") % 2 == 0, 'a,"b').alias("note")), ",")


def _regions(v: Views) -> DataFrame:
    start = F.expr("bigint(1 + seq_idx % greatest(1, length(seq) div 3))")
    some = v.seqs.filter(F.length("seq") > 0).select(F.col("seq_idx").alias("region"), "name", start.alias("start"), F.length("seq").alias("n"))
    return some.select("region", "name", "start", F.least(F.col("start") + 1500, F.col("n")).alias("end"))


#: A stretch of 1,501 letters, or what there is, of every sequence.
_REGIONS = "(SELECT *, CAST(1 + seq_idx % greatest(1, length(seq) // 3) AS BIGINT) AS s FROM seqs WHERE length(seq) > 0) r"


@query("f3_fetch_sequence", f" SELECT seq_idx AS region, substr(seq, s, 1501) AS seq FROM {_REGIONS}")
def _(v: Views) -> DataFrame:
    return tx.fetch_sequence(_regions(v), _chunks(v), "name", 1000)


@query(
    "s7_fasta_text",
    " SELECT seq_idx AS n, format('>SEQ{:06d}  demo Chr {} Start {} End {} Pair#{}', seq_idx, name, s, least(length(seq), s + 1500), seq_idx % 5) || chr(10) || substr(seq, s, 1501) AS value FROM " + _REGIONS,
)
def _(v: Views) -> DataFrame:
    rows = tx.fetch_sequence(_regions(v), _chunks(v), "name", 1000).join(_regions(v), "region")
    return tx.fasta_text(rows.select(F.col("region").alias("n"), F.lit("demo").alias("species"), F.col("name").alias("chr"), "start", "end", (F.col("region") % 5).alias("pair"), "seq"))


@query("s8_gff_text", " SELECT concat_ws(chr(9), concat('g', grp_idx), 'genoloom', 'gene', CAST(g_start AS VARCHAR), CAST(g_end AS VARCHAR), '.', strand, '.', attrs) AS value FROM genes")
def _(v: Views) -> DataFrame:
    rows = v.genes.select(F.concat(F.lit("g"), F.col("grp_idx").cast("string")).alias("seqid"), F.lit("gene").alias("type"), "g_start", "g_end", "strand", F.col("attrs").alias("text"))
    return tx.gff_text(rows)


@query("a1_link_exons", " SELECT concat('gene-', gene_idx) AS gene_id, concat('rna-', gene_idx) AS mrna_id, gene_idx * 10 + 1 + exon AS line FROM exons")
def _(v: Views) -> DataFrame:
    # a file per sequence, as annotation comes
    return an.link_exons(_gff(v).withColumn("file", F.col("seqid"))).select("gene_id", "mrna_id", "line")


@query(
    "a8_mask_non_genic",
    """, keep AS (SELECT name, seq, 101 + seq_idx % 300 AS a, 1401 + seq_idx % 300 AS b FROM seqs), m AS (SELECT name, repeat('N', CAST(least(a - 1, length(seq)) AS BIGINT)) || substr(seq, CAST(a AS BIGINT), CAST(b - a + 1 AS BIGINT)) || repeat('N', CAST(greatest(0, length(seq) - b) AS BIGINT)) AS seq FROM keep)
SELECT name, CAST(k AS INT) AS chunk, substr(seq, k * 1000 + 1, 1000) AS seq FROM (SELECT name, seq, unnest(range(0, greatest(1, (length(seq) + 999) // 1000))) AS k FROM m) x""",
)
def _(v: Views) -> DataFrame:
    one = v.seqs.select("name", (101 + F.col("seq_idx") % 300).alias("g_start"), (1200 + F.col("seq_idx") % 300).alias("g_end"))
    two = v.seqs.select("name", (900 + F.col("seq_idx") % 300).alias("g_start"), (1401 + F.col("seq_idx") % 300).alias("g_end"))
    return tx.mask_non_genic(_chunks(v), one.union(two), "name", 1000)


@query(
    "c1_fasta_summary",
    """ SELECT 'prefix' AS kind, regexp_extract(name, '^(\\D*)', 1) AS item, count(*) AS n FROM seqs GROUP BY 2 UNION ALL
SELECT 'length', CASE WHEN length(seq) < 500 THEN '<500' WHEN length(seq) < 2000 THEN '<2000' WHEN length(seq) < 8000 THEN '<8000' ELSE '>=8000' END, count(*) FROM seqs GROUP BY 2 UNION ALL
SELECT 'total', 'bases', CAST(sum(length(seq)) AS BIGINT) FROM seqs UNION ALL
SELECT 'base', b, CAST(sum(length(seq) - length(replace(upper(seq), b, ''))) AS BIGINT) FROM seqs CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) t(b) GROUP BY b""",
)
def _(v: Views) -> DataFrame:
    return cv.fasta_summary(v.seqs, [500, 2000, 8000])


@query("c2_classify_ids_ncbi", """ SELECT 'f' AS file, CAST(p_partkey AS BIGINT) AS at_, CASE p_partkey % 3 WHEN 0 THEN 'NC_' WHEN 1 THEN 'NW_' ELSE 'NT_' END || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'chromosome' ELSE 'scaffold' END AS kind FROM part""")
def _(v: Views) -> DataFrame:
    pre = F.element_at(F.array(F.lit("NC_"), F.lit("NW_"), F.lit("NT_")), (F.col("p_partkey") % 3 + 1).cast("int"))
    heads = v.part.select(F.lit("f").alias("file"), F.col("p_partkey").alias("at"), F.concat(F.lit(">"), pre, F.col("p_partkey").cast("string"), F.lit(" genomic")).alias("header"))
    return cv.classify_ids(heads, "ncbi").select("file", F.col("at").alias("at_"), "id", "kind")


@query("c3_classify_ids_ensembl", """ SELECT CAST(p_partkey AS BIGINT) AS at_, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'KZ' || p_partkey END AS id, CASE WHEN p_partkey % 2 = 0 THEN 'chromosome' ELSE 'scaffold' END AS kind,
  CASE WHEN p_partkey % 2 = 0 THEN 'Chr' || CASE WHEN p_partkey < 10 THEN '0' ELSE '' END || p_partkey ELSE 's' || CASE WHEN (p_partkey + 1) // 2 < 10 THEN '0' ELSE '' END || (p_partkey + 1) // 2 END AS newname FROM part""")
def _(v: Views) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    word = F.when(even, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("KZ"), F.col("p_partkey").cast("string")))
    heads = v.part.select(F.lit("f").alias("file"), F.col("p_partkey").alias("at"), F.concat(F.lit(">"), word, F.when(even, " dna").otherwise(" dna:scaffold")).alias("header"))
    return cv.classify_ids(heads, "ensembl").select(F.col("at").alias("at_"), "id", "kind", "newname")


@query(
    "c4_find_gaps",
    """, ch AS (SELECT name, unnest(range(1, length(seq) + 1)) AS p, seq FROM seqs), n AS (SELECT name, p, p - row_number() OVER (PARTITION BY name ORDER BY p) AS run FROM ch WHERE substr(seq, p, 1) IN ('N', 'n'))
SELECT name, min(p) AS start, max(p) AS stop, count(*) AS length FROM n GROUP BY name, run HAVING count(*) > 12""",
)
def _(v: Views) -> DataFrame:
    return tx.find_gaps(_chunks(v), "name", 1000, 12).withColumnRenamed("end", "stop")


@query("c5_hard_mask", " SELECT seq_idx, CAST(length(seq) - length(regexp_replace(seq, '[acgtn]', '', 'g')) AS BIGINT) AS masked, regexp_replace(seq, '[acgtn]', 'N', 'g') AS seq FROM seqs")
def _(v: Views) -> DataFrame:
    return tx.hard_mask(v.seqs).select("seq_idx", "masked", "seq")


@query("c6_length_cutoffs", " SELECT CAST(r AS INT) AS rank, length FROM (SELECT row_number() OVER (ORDER BY length(seq) DESC) AS r, CAST(length(seq) AS BIGINT) AS length FROM seqs) WHERE r <= 100 AND r % 10 = 0")
def _(v: Views) -> DataFrame:
    return cv.length_cutoffs(v.seqs)


def _id_map(v: Views) -> DataFrame:
    seq = F.concat(F.lit("g"), F.col("grp_idx").cast("string"))
    return v.groups.filter("grp_idx <> 34").select(seq.alias("id"), "name", F.concat(F.lit("Chr"), F.lpad((F.col("grp_idx") % 10).cast("string"), 2, "0")).alias("newname"), F.lit("chromosome").alias("kind"))


@query(
    "c7_convert_gff_ncbi",
    """, k AS (SELECT *, 'Chr0' || (grp_idx % 10) AS sq FROM genes WHERE p_size % 7 <> 0 AND grp_idx <> 34)
SELECT sq AS seqid, 'gene' AS type, g_start, g_end, strand, 'ID=' || annot_idx || ';Name=' || p_name || ';desc=' || p_type || ', like' AS text FROM k UNION ALL
SELECT sq, 'mRNA', g_start, g_end, strand, 'ID=' || annot_idx || ';Parent=' || annot_idx || ' (1)' FROM k UNION ALL SELECT sq, 'exon', e_start, e_end, '+', 'Parent=' || annot_idx FROM k JOIN exons ON gene_idx = annot_idx""",
)
def _(v: Views) -> DataFrame:
    return cv.convert_gff(_gff(v), _id_map(v))


@query(
    "c8_convert_gff_ensembl",
    """, k AS (SELECT *, 'Chr0' || (grp_idx % 10) AS sq FROM genes WHERE p_size % 7 <> 0 AND grp_idx <> 34)
SELECT sq AS seqid, 'gene' AS type, g_start, g_end, 'ID=' || annot_idx || ';Name=' || p_name || ';desc=' || p_type || ', like' AS text FROM k UNION ALL
SELECT sq, 'mRNA', g_start, g_end, 'ID=' || annot_idx || ';Parent=' || annot_idx || ' (1)' FROM k UNION ALL SELECT sq, 'exon', e_start, e_end, 'Parent=' || annot_idx FROM k JOIN exons ON gene_idx = annot_idx""",
)
def _(v: Views) -> DataFrame:
    text = F.replace(F.replace(F.replace(F.replace("value", F.lit("gene_biotype"), F.lit("biotype")), F.lit("gene-"), F.lit("gene:")), F.lit("=rna-"), F.lit("=transcript:")), F.lit("%2C like"), F.lit("%2C like [Source:x]"))
    rows = tx.parse_gff(v.gff_lines.select(F.lit("f").alias("file"), "line", text.alias("value")))
    return cv.convert_gff(rows, _id_map(v), "ensembl").drop("strand")


@query(
    "c9_gff_summary",
    """ SELECT 'type' AS kind, 'gene' AS item, count(*) AS n FROM genes UNION ALL SELECT 'type', 'mRNA', count(*) FROM genes UNION ALL SELECT 'type', 'exon', count(*) FROM exons
UNION ALL SELECT 'biotype', CASE WHEN p_size % 7 = 0 THEN 'lncRNA' ELSE 'protein_coding' END, count(*) FROM genes GROUP BY 2 UNION ALL SELECT 'key', k, count(*) FROM genes CROSS JOIN (VALUES ('ID'), ('Name'), ('gene_biotype')) t(k) GROUP BY 2""",
)
def _(v: Views) -> DataFrame:
    return cv.gff_summary(_gff(v))


@query(
    "c10_genes_per_sequence",
    """ SELECT CASE WHEN grp_idx = 34 THEN '' ELSE concat('g', grp_idx) END AS seqid, CASE WHEN grp_idx = 34 THEN 'not on sequence' ELSE 'chromosome' END AS kind, count(*) AS n FROM genes WHERE p_size % 7 <> 0 GROUP BY 1, 2""",
)
def _(v: Views) -> DataFrame:
    return cv.genes_per_sequence(_gff(v), _id_map(v))
