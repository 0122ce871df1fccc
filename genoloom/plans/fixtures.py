"""Genome-shaped views over the given tables.

Each view is one SQL text that both Spark and DuckDB run: ``{div}`` is integer division, ``{name}`` a table or
an earlier view. Spark builds a view when a query first asks for it; the SQL side gets all as a WITH clause.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from genoloom.operators.lineage import written

#: The views, in order: each may use the tables and those above it.
VIEWS: dict[str, str] = {
    # genes (annotation intervals) of 3 projects x 4 chromosomes
    "genes": """
SELECT CAST(p_partkey + 1 AS BIGINT) AS annot_idx, CAST(p_partkey % 3 + 1 AS INT) AS proj_idx,
  CAST((p_partkey % 3 + 1) * 10 + (p_partkey {div} 3) % 4 + 1 AS INT) AS grp_idx,
  CAST((p_partkey {div} 12) * 1000 + (p_partkey * 7919) % 700 + 1 AS INT) AS g_start,
  CAST((p_partkey {div} 12) * 1000 + (p_partkey * 7919) % 700 + 200 + p_size * 30 AS INT) AS g_end,
  CASE WHEN (p_partkey {div} 2) % 2 = 0 THEN '+' ELSE '-' END AS strand,
  concat('ID=', CAST(p_partkey + 1 AS STRING), ';Name=', p_name, ';desc=', p_type) AS attrs, p_name, p_type, CAST(p_size AS INT) AS p_size
FROM {part}""",
    # exons: 1 to 4 equal slices of a gene, the first half of each
    "exons": """
SELECT annot_idx AS gene_idx, grp_idx, proj_idx, CAST(k.n AS INT) AS exon,
  CAST(g_start + (k.n - 1) * ((g_end - g_start + 1) {div} (p_size % 4 + 1)) AS INT) AS e_start,
  CAST(g_start + (k.n - 1) * ((g_end - g_start + 1) {div} (p_size % 4 + 1)) + ((g_end - g_start + 1) {div} (p_size % 4 + 1)) {div} 2 - 1 AS INT) AS e_end
FROM {genes} JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) k ON k.n <= p_size % 4 + 1""",
    "groups": """
SELECT grp_idx, proj_idx, concat('Chr', CAST(grp_idx % 10 AS STRING)) AS name, CAST(grp_idx % 10 AS INT) AS sort_order,
  CAST(max(g_end) + 1000 AS BIGINT) AS length FROM {genes} GROUP BY grp_idx, proj_idx""",
    # one hit for each order line, between two genes of different projects
    "hits": """
SELECT hit_idx, CASE WHEN a.proj_idx < b.proj_idx THEN a.proj_idx ELSE b.proj_idx END AS proj1_idx,
  CASE WHEN a.proj_idx < b.proj_idx THEN b.proj_idx ELSE a.proj_idx END AS proj2_idx,
  CASE WHEN a.proj_idx < b.proj_idx THEN a.grp_idx ELSE b.grp_idx END AS grp1_idx,
  CASE WHEN a.proj_idx < b.proj_idx THEN b.grp_idx ELSE a.grp_idx END AS grp2_idx,
  CASE WHEN a.proj_idx < b.proj_idx THEN a.g_start ELSE b.g_start END + q * 13 AS start1,
  CASE WHEN a.proj_idx < b.proj_idx THEN a.g_start ELSE b.g_start END + q * 13 + 100 + ln * 20 AS end1,
  CASE WHEN a.proj_idx < b.proj_idx THEN b.g_start ELSE a.g_start END + q * 13 AS start2,
  CASE WHEN a.proj_idx < b.proj_idx THEN b.g_start ELSE a.g_start END + q * 13 + 100 + ln * 20 AS end2,
  CASE WHEN hit_idx % 7 = 0 THEN NULL WHEN a.proj_idx < b.proj_idx THEN a.annot_idx ELSE b.annot_idx END AS annot1_idx,
  CASE WHEN hit_idx % 11 = 0 THEN NULL WHEN a.proj_idx < b.proj_idx THEN b.annot_idx ELSE a.annot_idx END AS annot2_idx,
  concat(CASE WHEN a.proj_idx < b.proj_idx THEN a.strand ELSE b.strand END, '/', CASE WHEN a.proj_idx < b.proj_idx THEN b.strand ELSE a.strand END) AS strand,
  50 + dc * 4 AS pctid, 40 + dc * 5 AS cvgpct, 1 + ln % 4 AS countpct, 100 + ln * 20 AS score,
  2 - CASE WHEN hit_idx % 7 = 0 THEN 1 ELSE 0 END - CASE WHEN hit_idx % 11 = 0 THEN 1 ELSE 0 END AS gene_overlap
FROM (SELECT *, pk + 1 AS own, CASE WHEN sk % 5 = 0 THEN (pk * 31 + sk) % n ELSE (pk + 1) % n END + 1 AS other FROM (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS hit_idx, CAST(l_linenumber AS INT) AS ln, min(l_partkey) AS pk, min(l_suppkey) AS sk,
    CAST(min(l_quantity) AS INT) AS q, CAST(min(round(l_discount * 100)) AS INT) AS dc, (SELECT count(*) FROM {part}) AS n
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) lines) l
JOIN {genes} a ON a.annot_idx = l.own
JOIN {genes} b ON b.annot_idx = l.other
WHERE a.proj_idx <> b.proj_idx""",
    # the lowest hit of each gene pair: closer to clustered hits
    "hits_one": """
SELECT h.* FROM {hits} h JOIN (SELECT min(hit_idx) AS m FROM {hits} WHERE annot1_idx IS NOT NULL AND annot2_idx IS NOT NULL
  GROUP BY annot1_idx, annot2_idx) k ON h.hit_idx = k.m""",
    # hit and gene pairs that overlap, on either side
    "hit_annot": """
SELECT hit_idx, annot_idx, side, CAST((100 * o) {div} (hi - lo + 1) AS INT) AS olap FROM (
  SELECT h.hit_idx, g.annot_idx, 1 AS side, h.start1 AS lo, h.end1 AS hi, least(h.end1, g.g_end) - greatest(h.start1, g.g_start) + 1 AS o
  FROM {hits} h JOIN {genes} g ON g.grp_idx = h.grp1_idx AND g.annot_idx = h.annot1_idx
  UNION ALL
  SELECT h.hit_idx, g.annot_idx, 2, h.start2, h.end2, least(h.end2, g.g_end) - greatest(h.start2, g.g_start) + 1
  FROM {hits} h JOIN {genes} g ON g.grp_idx = h.grp2_idx AND g.annot_idx = h.annot2_idx) x WHERE o > 0""",
    # stretches of 25,000 bases with 7 or more hits of one chromosome pair
    "block_hits": """
SELECT hit_idx, block_idx FROM (
  SELECT hit_idx, CAST(grp1_idx AS BIGINT) * 10000000 + grp2_idx * 100000 + start1 {div} 25000 AS block_idx,
    count(*) OVER (PARTITION BY grp1_idx, grp2_idx, start1 {div} 25000) AS n FROM {hits}) x WHERE n >= 7""",
    "blocks": """
SELECT b.block_idx, min(proj1_idx) AS proj1_idx, min(proj2_idx) AS proj2_idx, min(grp1_idx) AS grp1_idx, min(grp2_idx) AS grp2_idx,
  min(start1) AS start1, max(end1) AS end1, min(start2) AS start2, max(end2) AS end2, count(*) AS score,
  CAST(b.block_idx % 100000 + 1 AS INT) AS blocknum
FROM {block_hits} b JOIN {hits} h ON h.hit_idx = b.hit_idx GROUP BY b.block_idx""",
    # documents as draft sequences: every other letter than ACGTN, in either case, is N
    "seqs": """
SELECT concat('s', CAST(doc_id AS STRING)) AS name, CAST(doc_id AS BIGINT) AS seq_idx,
  regexp_replace(text, '[^acgtnACGTN]', 'N'{g}) AS seq FROM {documents}""",
    # alignment rows in text form: 15 columns, target first
    "mum_lines": """
SELECT hit_idx AS line, concat_ws(' ', CAST(start2 AS STRING), CAST(end2 AS STRING),
  CAST(CASE WHEN strand IN ('+/+', '-/-') THEN start1 ELSE end1 END AS STRING), CAST(CASE WHEN strand IN ('+/+', '-/-') THEN end1 ELSE start1 END AS STRING),
  CAST(end2 - start2 + 1 AS STRING), CAST(end1 - start1 + 1 AS STRING), concat(CAST(pctid AS STRING), '.40'), concat(CAST(cvgpct AS STRING), '.60'), '0.00',
  '1000000', '1000000', '1', '1', concat('g', CAST(grp2_idx AS STRING)), concat('g', CAST(grp1_idx AS STRING))) AS value FROM {hits}""",
    # annotation rows in text form: nine tab columns; genes, their one transcript and its exons
    "gff_lines": """
SELECT annot_idx * 10 AS line, concat_ws('{tab}', concat('g', CAST(grp_idx AS STRING)), 'src', 'gene', CAST(g_start AS STRING), CAST(g_end AS STRING), '.', strand, '.',
  concat('ID=gene-', CAST(annot_idx AS STRING), ';Name=', p_name, ';gene_biotype=', CASE WHEN p_size % 7 = 0 THEN 'lncRNA' ELSE 'protein_coding' END)) AS value FROM {genes}
UNION ALL
SELECT annot_idx * 10 + 1, concat_ws('{tab}', concat('g', CAST(grp_idx AS STRING)), 'src', 'mRNA', CAST(g_start AS STRING), CAST(g_end AS STRING), '.', strand, '.',
  concat('ID=rna-', CAST(annot_idx AS STRING), ';Parent=gene-', CAST(annot_idx AS STRING), ';product=', p_type, '%2C like')) FROM {genes}
UNION ALL
SELECT gene_idx * 10 + 1 + exon, concat_ws('{tab}', concat('g', CAST(grp_idx AS STRING)), 'src', 'exon', CAST(e_start AS STRING), CAST(e_end AS STRING), '.', '+', '.',
  concat('ID=exon-', CAST(gene_idx AS STRING), '-', CAST(exon AS STRING), ';Parent=rna-', CAST(gene_idx AS STRING))) FROM {exons}""",
}
TABLES = ("part", "lineitem", "documents")


class Views:
    """The views over one folder of tables, built on demand as Spark DataFrames: ``views.genes`` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._built:
            if name in TABLES:
                self._built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = VIEWS[name].replace("{div}", "div").replace("{g}", "").replace("{tab}", "\\t")
                used = {k: getattr(self, k) for k in (*TABLES, *VIEWS) if "{" + k + "}" in text}
                made = self.spark.sql(text, **used)
                # hits are a stored table, as in any use of them: later filters must not reach into their joins
                self._built[name] = written(made, name) if name == "hits" else made
        return self._built[name]

    @cached_property
    def annot_lengths(self) -> DataFrame:
        return self.groups.select("grp_idx", "length")


def with_clause() -> str:
    """All views as a WITH clause of DuckDB, without the final select."""
    parts = []
    for name, text in VIEWS.items():
        text = text.replace("{div}", "//").replace("{g}", ", 'g'").replace("'{tab}'", "chr(9)")
        for k in (*TABLES, *VIEWS):
            text = text.replace("{" + k + "}", k)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ",\n".join(parts)
