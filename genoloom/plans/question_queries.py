"""Queries over hits, genes and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators import annotation as an
from genoloom.operators import collinear as co
from genoloom.operators import hits as hi
from genoloom.operators import query as qu
from genoloom.operators.graph import connected_components
from genoloom.operators.ordering import global_rank
from genoloom.plans.annotation_queries import _NUMBERED, _RANKED, _TAGS, _ranked
from genoloom.plans.fixtures import Views
from genoloom.plans.registry import query


@query(
    "q1_hit_gene_block_view",
    """ SELECT h.hit_idx, a.annot_idx, a.side, a.olap, g.g_start, g.g_end, g.strand AS g_strand, b.block_idx, k.blocknum FROM hits h LEFT JOIN hit_annot a USING (hit_idx)
  LEFT JOIN genes g USING (annot_idx) LEFT JOIN block_hits b USING (hit_idx) LEFT JOIN blocks k USING (block_idx)""",
)
def _(v: Views) -> DataFrame:
    rows = qu.hit_gene_block_view(v.hits, v.hit_annot, v.genes, v.block_hits, v.blocks)
    return rows.select("hit_idx", "annot_idx", "side", "olap", "g_start", "g_end", "g_strand", "block_idx", "blocknum")


_ROWS = """, rows_ AS (SELECT h.*, a.g_start AS gstart1, a.g_end AS gend1, a.g_end - a.g_start + 1 AS glen1, a.strand AS gstrand1, a.attrs AS attrs1, x.olap AS olap1,
  b.g_start AS gstart2, b.g_end AS gend2, b.g_end - b.g_start + 1 AS glen2, b.strand AS gstrand2, b.attrs AS attrs2, y.olap AS olap2
FROM hits h LEFT JOIN genes a ON a.annot_idx = h.annot1_idx LEFT JOIN genes b ON b.annot_idx = h.annot2_idx
LEFT JOIN hit_annot x ON x.hit_idx = h.hit_idx AND x.side = 1 LEFT JOIN hit_annot y ON y.hit_idx = h.hit_idx AND y.side = 2)"""


def _rows(v: Views) -> DataFrame:
    return qu.hit_rows(v.hits, v.genes, v.hit_annot)


@query("q2_hit_rows", _ROWS + " SELECT hit_idx, gstart1, gend1, glen1, gstrand1, olap1, gstart2, gend2, glen2, gstrand2, olap2 FROM rows_")
def _(v: Views) -> DataFrame:
    return _rows(v).select("hit_idx", "gstart1", "gend1", "glen1", "gstrand1", "olap1", "gstart2", "gend2", "glen2", "gstrand2", "olap2")


_OVER = """, ov AS (SELECT hit_idx, annot_idx, 1 AS side FROM hits JOIN genes ON grp_idx = grp1_idx AND start1 <= g_end AND g_start <= end1
UNION ALL SELECT hit_idx, annot_idx, 2 FROM hits JOIN genes ON grp_idx = grp2_idx AND start2 <= g_end AND g_start <= end2)"""


@query(
    "q3_with_minor",
    _OVER + """ SELECT hit_idx, annot1_idx, annot2_idx, '' AS mark FROM hits UNION ALL
SELECT h.hit_idx, CASE WHEN side = 1 THEN annot_idx ELSE annot1_idx END, CASE WHEN side = 2 THEN annot_idx ELSE annot2_idx END, '*' FROM hits h JOIN ov ON ov.hit_idx = h.hit_idx
WHERE annot_idx IS DISTINCT FROM CASE WHEN side = 1 THEN annot1_idx ELSE annot2_idx END""",
)
def _(v: Views) -> DataFrame:
    over = [hi.hit_gene_overlaps(v.hits, v.genes, k, 2000).withColumn("side", F.lit(k)) for k in (1, 2)]
    return qu.with_minor(v.hits.select("hit_idx", "annot1_idx", "annot2_idx"), over[0].unionByName(over[1]))


@query("q4_filter_pairs_chr", " SELECT hit_idx FROM hits WHERE (proj1_idx, proj2_idx) IN ((1, 2), (1, 3)) AND grp1_idx IN (11, 12, 21, 22, 31) AND grp2_idx IN (11, 12, 21, 22, 31)")
def _(v: Views) -> DataFrame:
    return v.hits.filter(qu.in_pairs([(1, 2), (1, 3)]) & qu.on_chromosomes([11, 12, 21, 22, 31])).select("hit_idx")


@query("q5_filter_location", " SELECT hit_idx FROM hits WHERE (grp1_idx = 21 AND start1 >= 20000 AND end1 <= 90000) OR (grp2_idx = 21 AND start2 >= 20000 AND end2 <= 90000)")
def _(v: Views) -> DataFrame:
    return v.hits.filter(qu.in_location(21, 20_000, 90_000)).select("hit_idx")


@query("q6_filter_hit_scores", " SELECT hit_idx FROM hits WHERE pctid >= 60 AND cvgpct >= 55 AND score >= 140")
def _(v: Views) -> DataFrame:
    return v.hits.filter(qu.at_least(60, 55, 140)).select("hit_idx")


@query(
    "q7_filter_block",
    """ SELECT hit_idx, 'yes' AS mode FROM hits WHERE hit_idx IN (SELECT hit_idx FROM block_hits) UNION ALL SELECT hit_idx, 'no' FROM hits WHERE hit_idx NOT IN (SELECT hit_idx FROM block_hits)
UNION ALL SELECT hit_idx, 'number' FROM hits WHERE hit_idx IN (SELECT hit_idx FROM block_hits JOIN blocks USING (block_idx) WHERE blocknum = 3)""",
)
def _(v: Views) -> DataFrame:
    h = v.hits.select("hit_idx")
    modes = [qu.filter_block(h, v.block_hits, m, 3, v.blocks).withColumn("mode", F.lit(m)) for m in ("yes", "no", "number")]
    return modes[0].union(modes[1]).union(modes[2])


@query("q8_filter_gene_mode", " SELECT hit_idx, CASE gene_overlap WHEN 1 THEN 'one' WHEN 2 THEN 'both' ELSE 'none' END AS mode FROM hits")
def _(v: Views) -> DataFrame:
    modes = [v.hits.filter(qu.gene_mode(m)).select("hit_idx", F.lit(m).alias("mode")) for m in ("one", "both", "none")]
    return modes[0].union(modes[1]).union(modes[2])


_SIZED = _RANKED + ", sized AS (SELECT r.hit_idx, s.size AS runsize FROM rh r JOIN sets s USING (grp1_idx, grp2_idx, same, rank1, rank2))"


def _sized(v: Views) -> DataFrame:
    keys = ["grp1_idx", "grp2_idx", "same", "rank1", "rank2"]
    ranked = _ranked(v)
    return ranked.join(co.diagonal_sets(ranked).select(*keys, F.col("size").alias("runsize")), keys).select("hit_idx", "runsize")


@query("q9_filter_collinear", _SIZED + " SELECT hit_idx, '>=' AS op FROM sized WHERE runsize >= 4 UNION ALL SELECT hit_idx, '=' FROM sized WHERE runsize = 3 UNION ALL SELECT hit_idx, '<=' FROM sized WHERE runsize <= 3")
def _(v: Views) -> DataFrame:
    s = _sized(v)
    part = [s.filter(qu.collinear_size(op, n)).select("hit_idx", F.lit(op).alias("op")) for op, n in ((">=", 4), ("=", 3), ("<=", 3))]
    return part[0].union(part[1]).union(part[2])


@query(
    "q10_filter_gene_number",
    _TAGS + """, g AS (SELECT t.annot_idx FROM tags t JOIN genes USING (annot_idx) WHERE genenum = 12 AND suffix = 'a' AND grp_idx IN (11, 21, 31)) SELECT hit_idx FROM hits WHERE annot1_idx IN (SELECT * FROM g) OR annot2_idx IN (SELECT * FROM g)""",
)
def _(v: Views) -> DataFrame:
    tagged = an.gene_tags(an.number_genes(v.genes), v.exons)
    return qu.filter_gene_number(v.hits, tagged, "12.a", [11, 21, 31]).select("hit_idx")


@query("q11_filter_gene_overlap", _ROWS + " SELECT hit_idx, 'or' AS mode FROM rows_ WHERE olap1 >= 90 OR olap2 >= 90 UNION ALL SELECT hit_idx, 'and' FROM rows_ WHERE olap1 >= 90 AND olap2 >= 90")
def _(v: Views) -> DataFrame:
    r = _rows(v)
    return r.filter(qu.gene_overlap_at_least(90, False)).select("hit_idx", F.lit("or").alias("mode")).union(r.filter(qu.gene_overlap_at_least(90, True)).select("hit_idx", F.lit("and").alias("mode")))


@query("q12_filter_annotation", _ROWS + " SELECT hit_idx FROM rows_ WHERE (lower(attrs1) LIKE '%economy%' AND grp1_idx IN (11, 12, 21)) OR (lower(attrs2) LIKE '%economy%' AND grp2_idx IN (11, 12, 21))")
def _(v: Views) -> DataFrame:
    return _rows(v).filter(qu.describes("ECONOMY", [11, 12, 21])).select("hit_idx")


@query("q13_filter_self_half", " SELECT hit_idx FROM hits WHERE grp1_idx % 10 > grp2_idx % 10 OR (grp1_idx % 10 = grp2_idx % 10 AND start1 > start2)")
def _(v: Views) -> DataFrame:
    own = v.hits.withColumn("grp1_idx", F.col("grp1_idx") % 10).withColumn("grp2_idx", F.col("grp2_idx") % 10)
    return own.filter(qu.self_half()).select("hit_idx")


@query("q14_orphan_genes", " SELECT annot_idx, grp_idx FROM genes g WHERE NOT EXISTS (SELECT 1 FROM hit_annot a JOIN hits h USING (hit_idx) WHERE a.annot_idx = g.annot_idx AND proj1_idx = 1 AND proj2_idx = 2)")
def _(v: Views) -> DataFrame:
    return qu.orphan_genes(v.genes, v.hit_annot, v.hits, [(1, 2)]).select("annot_idx", "grp_idx")


@query(
    "q15_all_genes",
    """ SELECT g.annot_idx, g.grp_idx, count(DISTINCT a.hit_idx) AS numhits FROM genes g LEFT JOIN hit_annot a ON a.annot_idx = g.annot_idx WHERE lower(attrs) LIKE '%gear%' AND g_start >= 5000 GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    some = v.genes.filter(F.contains(F.lower("attrs"), F.lit("gear")) & (F.col("g_start") >= 5000))
    return hi.gene_hit_counts(some, v.hit_annot).join(some.select("annot_idx", "grp_idx"), "annot_idx")


@query("q16_annotation_columns", " SELECT annot_idx, p_name AS name, p_type AS desc, '---' AS product, attrs AS all_text FROM genes")
def _(v: Views) -> DataFrame:
    return qu.annotation_columns(v.genes, ["Name", "desc", "product"])


_LINKS = """, links AS (SELECT hit_idx, annot1_idx AS annot_idx, proj1_idx AS proj_idx, grp1_idx AS grp_idx, annot2_idx AS other, proj2_idx AS oproj, grp2_idx AS ogrp FROM hits WHERE gene_overlap = 2
UNION ALL SELECT hit_idx, annot2_idx, proj2_idx, grp2_idx, annot1_idx, proj1_idx, grp1_idx FROM hits WHERE gene_overlap = 2)"""


@query("q17_multi_hit_genes", _LINKS + " SELECT * FROM (SELECT hit_idx, annot_idx, oproj, count(*) OVER (PARTITION BY annot_idx, oproj) AS group_size FROM links) WHERE group_size >= 6")
def _(v: Views) -> DataFrame:
    return qu.multi_hit_genes(qu.gene_links(v.hits), 6).select("hit_idx", "annot_idx", "oproj", "group_size")


@query(
    "q18_tandem_multi_hits",
    _NUMBERED + _LINKS + """, m AS (SELECT *, count(*) OVER (PARTITION BY annot_idx, oproj) AS c FROM links), d AS (SELECT DISTINCT m.annot_idx, ogrp, genenum FROM m JOIN numbered n ON n.annot_idx = other WHERE c >= 3),
r AS (SELECT *, genenum - row_number() OVER (PARTITION BY annot_idx, ogrp ORDER BY genenum) AS run FROM d) SELECT annot_idx, ogrp, count(*) AS size, min(genenum) AS first FROM r GROUP BY annot_idx, ogrp, run HAVING count(*) >= 2""",
)
def _(v: Views) -> DataFrame:
    multi = qu.multi_hit_genes(qu.gene_links(v.hits), 3)
    return qu.tandem_multi_hits(multi, an.number_genes(v.genes), 2).select("annot_idx", "ogrp", "size", "first")


@query("q19_gene_number_groups", _NUMBERED + _LINKS + " SELECT l.proj_idx, l.grp_idx, genenum, oproj, ogrp, count(*) AS size FROM links l JOIN numbered n USING (annot_idx) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return qu.gene_number_groups(qu.gene_links(v.hits), an.number_genes(v.genes))


#: A thinner graph, of gene pairs with two hits or more, so that there are many clusters.
_CLUSTER = """, e0 AS (SELECT annot1_idx AS a, annot2_idx AS b FROM hits_one WHERE pctid >= 82), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
reach AS (SELECT DISTINCT a AS node, a AS top FROM e), walk AS (SELECT * FROM (WITH RECURSIVE w(node, top) AS (SELECT node, top FROM reach UNION SELECT e.b, w.top FROM w JOIN e ON e.a = w.node) SELECT node, min(top) AS cluster FROM w GROUP BY node))"""


def _thin(v: Views) -> DataFrame:
    return v.hits_one.filter("pctid >= 82")


@query("g1_connected_components", _CLUSTER + " SELECT node, cluster AS component FROM walk")
def _(v: Views) -> DataFrame:
    return connected_components(_thin(v), "annot1_idx", "annot2_idx")


@query("q20_gene_clusters", _CLUSTER + " SELECT node AS annot_idx, cluster FROM walk")
def _(v: Views) -> DataFrame:
    return qu.gene_clusters(_thin(v))


@query(
    "q21_filter_clusters",
    _CLUSTER + """, per AS (SELECT cluster, count(*) AS n_genes, count(*) FILTER (proj_idx = 1) AS p1, count(*) FILTER (proj_idx = 2) AS p2, count(*) FILTER (proj_idx = 3) AS p3 FROM walk JOIN genes ON annot_idx = node GROUP BY 1),
h AS (SELECT cluster, count(*) AS n_hits FROM e0 JOIN walk ON node = a GROUP BY 1)
SELECT cluster, n_genes, n_hits, CAST(row_number() OVER (ORDER BY n_hits DESC, cluster) AS INT) AS number FROM per JOIN h USING (cluster) WHERE n_genes >= 2 AND p1 >= 1 AND p2 >= 1 AND p3 = 0 AND n_hits <= 20000""",
)
def _(v: Views) -> DataFrame:
    h = _thin(v)
    return qu.filter_clusters(qu.gene_clusters(h), v.genes, h, 2, [1, 2], [3])


_FAMILY = """, fh AS (SELECT * FROM hits_one WHERE pctid >= 86), sd AS (SELECT hit_idx, grp1_idx AS g, start1 AS s, end1 AS e FROM fh UNION ALL SELECT hit_idx, grp2_idx, start2, end2 FROM fh),
fe AS (SELECT DISTINCT x.hit_idx AS a, y.hit_idx AS b FROM sd x JOIN sd y ON x.g = y.g AND x.s <= y.e AND y.s <= x.e),
fam AS (SELECT * FROM (WITH RECURSIVE w(node, top) AS (SELECT DISTINCT a, a FROM fe UNION SELECT fe.b, w.top FROM w JOIN fe ON fe.a = w.node) SELECT node AS hit_idx, min(top) AS family FROM w GROUP BY node)),
fams AS (SELECT hit_idx, family, count(*) OVER (PARTITION BY family) AS size FROM fam)"""


def _families(v: Views) -> tuple[DataFrame, DataFrame]:
    h = v.hits_one.filter("pctid >= 86")
    return h, qu.region_families(h, 5000)


@query("q22_region_families", _FAMILY + " SELECT hit_idx, family, size FROM fams")
def _(v: Views) -> DataFrame:
    return _families(v)[1]


@query(
    "q23_filter_families",
    _FAMILY + """ SELECT family, count(*) AS size FROM fams JOIN fh USING (hit_idx) GROUP BY family
HAVING bool_or(proj1_idx = 1 OR proj2_idx = 1) AND bool_or(proj1_idx = 2 OR proj2_idx = 2) AND NOT bool_or(proj1_idx = 3 OR proj2_idx = 3)""",
)
def _(v: Views) -> DataFrame:
    h, f = _families(v)
    return qu.filter_families(f, h, [1, 2], [3])


@query(
    "q24_family_regions",
    _FAMILY + """, r AS (SELECT family, proj1_idx AS proj_idx, grp1_idx AS g, start1 AS s, end1 AS e FROM fams JOIN fh USING (hit_idx) UNION ALL SELECT family, proj2_idx, grp2_idx, start2, end2 FROM fams JOIN fh USING (hit_idx)),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY family, proj_idx, g ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r)
SELECT family, proj_idx, CAST(sum(new) AS BIGINT) AS regions FROM n GROUP BY 1, 2""",
)
def _(v: Views) -> DataFrame:
    h, f = _families(v)
    return qu.family_regions(f, h)


@query(
    "q25_sort_rows",
    " SELECT block_idx, CAST(row_number() OVER (ORDER BY grp1_idx, grp2_idx, blocknum, block_idx) AS INT) AS place FROM blocks",
)
def _(v: Views) -> DataFrame:
    label = F.concat_ws(".", F.col("grp1_idx").cast("string"), F.col("grp2_idx").cast("string"), F.col("blocknum").cast("string"))
    return global_rank(v.blocks, [*qu.natural_key(label), F.col("block_idx")], "place").select("block_idx", "place")


@query(
    "q26_result_summary",
    """ SELECT count(*) AS hits, count(block_idx) AS block_hits, count(DISTINCT block_idx) AS blocks, count(*) FILTER (gene_overlap = 2) AS both, count(*) FILTER (gene_overlap = 1) AS one, count(*) FILTER (gene_overlap = 0) AS none
FROM hits LEFT JOIN block_hits USING (hit_idx)""",
)
def _(v: Views) -> DataFrame:
    return qu.result_summary(v.hits, v.block_hits)


@query(
    "q26_species_summary",
    """ SELECT proj_idx, count(*) AS hits, count(annot_idx) AS annotated, count(DISTINCT annot_idx) AS genes, count(DISTINCT grp_idx) AS chromosomes FROM
(SELECT proj1_idx AS proj_idx, grp1_idx AS grp_idx, annot1_idx AS annot_idx FROM hits UNION ALL SELECT proj2_idx, grp2_idx, annot2_idx FROM hits) x GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return qu.species_summary(v.hits)


@query(
    "q27_find_rows",
    """ SELECT annot_idx, 'exact' AS mode FROM genes WHERE p_type = 'ECONOMY' UNION ALL SELECT annot_idx, 'substring' FROM genes WHERE lower(p_name) LIKE '%gear%' UNION ALL
SELECT annot_idx, 'last' FROM genes WHERE regexp_extract(attrs, '(\\d+)\\D*$', 1) = '7'""",
)
def _(v: Views) -> DataFrame:
    asks = (("p_type", "ECONOMY", "exact"), ("p_name", "Gear", "substring"), ("attrs", "7", "last"))
    part = [qu.find_rows(v.genes, c, t, m).select("annot_idx", F.lit(m).alias("mode")) for c, t, m in asks]
    return part[0].union(part[1]).union(part[2])


@query(
    "q28_extent",
    """ SELECT block_idx, greatest(1, min(start1) - 50) AS start1, max(end1) + 50 AS end1, greatest(1, min(start2) - 50) AS start2, max(end2) + 50 AS end2, count(*) AS hits FROM block_hits JOIN hits USING (hit_idx) GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return qu.extent(v.hits.join(v.block_hits, "hit_idx"), ["block_idx"], 50)


@query(
    "q29_gene_hits",
    """ SELECT annot_idx, hit_idx, side, olap, CASE side WHEN 1 THEN grp2_idx ELSE grp1_idx END AS ogrp, CASE side WHEN 1 THEN start2 ELSE start1 END AS ostart, CASE side WHEN 1 THEN end2 ELSE end1 END AS oend, '' AS mark
FROM hit_annot JOIN hits USING (hit_idx) JOIN genes USING (annot_idx) WHERE grp_idx = 11""",
)
def _(v: Views) -> DataFrame:
    return qu.gene_hits(v.hits, v.hit_annot, v.genes.filter("grp_idx = 11"))
