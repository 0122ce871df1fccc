"""Queries of the two clustering algorithms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators import annotation as an
from genoloom.operators import cluster_bins as cb
from genoloom.operators import cluster_pairs as cp
from genoloom.operators.lineage import written
from genoloom.plans.fixtures import Views
from genoloom.plans.registry import query

#: Raw hits: some are moved off their genes.
_RAW = """, raw AS (SELECT hit_idx, grp1_idx, grp2_idx, start1 + CAST(hit_idx % 4 AS INT) * 450 AS start1, end1 + CAST(hit_idx % 4 AS INT) * 450 AS end1, start2 + CAST(hit_idx % 3 AS INT) * 400 AS start2,
  end2 + CAST(hit_idx % 3 AS INT) * 400 AS end2, annot1_idx, annot2_idx, strand, pctid, cvgpct, score FROM hits)"""


def _raw(v: Views) -> DataFrame:
    a, b = (F.col("hit_idx") % 4).cast("int") * 450, (F.col("hit_idx") % 3).cast("int") * 400
    cols = {"start1": F.col("start1") + a, "end1": F.col("end1") + a, "start2": F.col("start2") + b, "end2": F.col("end2") + b}
    return v.hits.select("hit_idx", "grp1_idx", "grp2_idx", *[e.alias(c) for c, e in cols.items()], "annot1_idx", "annot2_idx", "strand", "pctid", "cvgpct", "score")


_REGIONS = """, touch AS (SELECT DISTINCT hit_idx FROM raw JOIN genes ON grp_idx = grp1_idx AND start1 <= g_end AND g_start <= end1),
fr AS (SELECT grp1_idx AS grp_idx, start1 AS s, end1 AS e, 0 AS gene FROM raw WHERE hit_idx NOT IN (SELECT hit_idx FROM touch) UNION ALL SELECT grp_idx, g_start, g_end, 1 FROM genes),
wl AS (SELECT *, sum(gene) OVER (PARTITION BY grp_idx ORDER BY s, gene DESC, e DESC) AS wall FROM fr),
nw AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY grp_idx, wall ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1000 THEN 0 ELSE 1 END AS new FROM wl WHERE gene = 0),
pt AS (SELECT *, sum(new) OVER (PARTITION BY grp_idx, wall ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS part FROM nw), spn AS (SELECT grp_idx, wall, part, min(s) AS s, max(e) AS e FROM pt GROUP BY 1, 2, 3),
regions AS (SELECT grp_idx, CAST(k AS INT) AS start, CAST(least(k + 149, e) AS INT) AS stop FROM (SELECT grp_idx, e, unnest(range(s, e + 1, 150)) AS k FROM spn) x)"""


@query("k1_candidate_regions", _RAW + _REGIONS + " SELECT * FROM regions")
def _(v: Views) -> DataFrame:
    return cb.candidate_regions(_raw(v), v.genes, 1, 1000, 150).withColumnRenamed("end", "stop")


def _elements(v: Views) -> DataFrame:
    g = v.genes.select(F.col("annot_idx").alias("element"), "grp_idx", F.col("g_start").alias("el_start"), F.col("g_end").alias("el_end"), F.lit(True).alias("is_gene"))
    r = cb.candidate_regions(_raw(v), v.genes, 1, 1000, 150)
    return g.union(r.select((-(F.col("grp_idx").cast("long") * 10_000_000 + F.col("start"))).alias("element"), "grp_idx", "start", "end", F.lit(False)))


_ELEMENTS = """, el AS (SELECT annot_idx AS element, grp_idx, g_start AS a, g_end AS b, true AS is_gene FROM genes UNION ALL SELECT -(CAST(grp_idx AS BIGINT) * 10000000 + start), grp_idx, start, stop, false FROM regions)"""


@query(
    "k2_best_annotation",
    _RAW + _REGIONS + _ELEMENTS + """ SELECT hit_idx, element, is_gene, overlap FROM (SELECT hit_idx, element, is_gene, least(end1, b) - greatest(start1, a) + 1 AS overlap,
  row_number() OVER (PARTITION BY hit_idx ORDER BY is_gene DESC, least(end1, b) - greatest(start1, a) + 1 DESC, abs(start1 - a) + abs(end1 - b), element) AS r FROM raw JOIN el ON grp_idx = grp1_idx AND start1 <= b AND a <= end1) WHERE r = 1""",
)
def _(v: Views) -> DataFrame:
    return cb.best_annotation(_raw(v), _elements(v), 1)


_CLUSTERS = """, ce AS (SELECT hit_idx, grp1_idx, grp2_idx, start1, end1, start2, end2, pctid, cvgpct, strand IN ('+/+', '-/-') AS same, annot1_idx IS NOT NULL AS gene1, annot2_idx IS NOT NULL AS gene2,
  coalesce(annot1_idx, -(grp1_idx * 1000 + start1 // 5000)) AS element1, coalesce(annot2_idx, -(grp2_idx * 1000 + start2 // 5000)) AS element2, greatest(end1 - start1 + 1, end2 - start2 + 1) AS len FROM hits),
cn AS (SELECT *, end1 - start1 + 1 - greatest(0, coalesce(lag(end1) OVER (PARTITION BY element1, element2, same ORDER BY start1, end1, hit_idx) - start1 + 1, 0)) AS net1,
  end2 - start2 + 1 - greatest(0, coalesce(lag(end2) OVER (PARTITION BY element1, element2, same ORDER BY start2, end2, hit_idx) - start2 + 1, 0)) AS net2 FROM ce),
ca AS (SELECT element1, element2, same, min(grp1_idx) AS grp1_idx, min(grp2_idx) AS grp2_idx, min(start1) AS start1, max(end1) AS end1, min(start2) AS start2, max(end2) AS end2, count(*) AS subs,
  CAST(round(CAST(sum(pctid * len) AS DOUBLE) / sum(len)) AS INT) AS pctid, CAST(round(CAST(sum(cvgpct * len) AS DOUBLE) / sum(len)) AS INT) AS pctsim, greatest(sum(net1), sum(net2)) AS length, min(hit_idx) AS hit_idx, bool_and(gene1) AS gene1, bool_and(gene2) AS gene2 FROM cn GROUP BY 1, 2, 3),
clusters AS (SELECT *, CASE WHEN gene1 AND gene2 THEN 'GeneGene' WHEN gene1 OR gene2 THEN 'GeneNonGene' ELSE 'NonGene' END AS type FROM (SELECT *, max(subs) OVER (PARTITION BY element1, element2) AS best FROM ca) WHERE subs = best OR subs > 2)"""


def _clusters(v: Views) -> DataFrame:
    other = lambda k: F.expr(f"-(grp{k}_idx * 1000 + start{k} div 5000)")
    rows = v.hits
    for k in (1, 2):
        rows = rows.withColumn(f"element{k}", F.coalesce(F.col(f"annot{k}_idx"), other(k))).withColumn(f"gene{k}", F.col(f"annot{k}_idx").isNotNull())
    return cb.cluster_by_annotation(rows)


@query("k3_cluster_by_annotation", _CLUSTERS + " SELECT hit_idx, element1, element2, same, start1, end1, start2, end2, subs, pctid, pctsim, CAST(length AS BIGINT) AS length, type FROM clusters")
def _(v: Views) -> DataFrame:
    return _clusters(v).select("hit_idx", "element1", "element2", "same", "start1", "end1", "start2", "end2", "subs", "pctid", "pctsim", "length", "type")


@query(
    "k4_cluster_strand",
    _CLUSTERS + """, s AS (SELECT hit_idx, same, a.strand AS s1, b.strand AS s2 FROM clusters LEFT JOIN genes a ON a.annot_idx = element1 LEFT JOIN genes b ON b.annot_idx = element2)
SELECT hit_idx, CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN CASE WHEN (s1 = s2) = same THEN s1 || '/' || s2 END WHEN s1 IS NOT NULL THEN s1 || '/' || CASE WHEN same THEN translate(s1, '+-', '-+') ELSE s1 END
  WHEN s2 IS NOT NULL THEN CASE WHEN same THEN translate(s2, '+-', '-+') ELSE s2 END || '/' || s2 WHEN same THEN '+/+' ELSE '+/-' END AS strand FROM s""",
)
def _(v: Views) -> DataFrame:
    g = lambda k: v.genes.select(F.col("annot_idx").alias(f"element{k}"), F.col("strand").alias(f"s{k}"))
    rows = _clusters(v).join(g(1), "element1", "left").join(g(2), "element2", "left")
    return rows.select("hit_idx", cb.cluster_strand(F.col("same"), F.col("s1"), F.col("s2")).alias("strand"))


_BINS = """, bins AS (SELECT annot_idx AS bin, grp_idx, g_start AS a, g_end AS b FROM genes), b1 AS (SELECT hit_idx, bin FROM (SELECT hit_idx, bin, row_number() OVER (PARTITION BY hit_idx ORDER BY least(end1, b) - greatest(start1, a) DESC, a, b DESC, bin) AS r
  FROM clusters JOIN bins ON grp_idx = grp1_idx AND start1 <= b AND a <= end1) WHERE r = 1),
b2 AS (SELECT hit_idx, bin FROM (SELECT hit_idx, bin, row_number() OVER (PARTITION BY hit_idx ORDER BY least(end2, b) - greatest(start2, a) DESC, a, b DESC, bin) AS r FROM clusters JOIN bins ON grp_idx = grp2_idx AND start2 <= b AND a <= end2) WHERE r = 1)"""


def _bins(v: Views, clusters: DataFrame, side: int) -> DataFrame:
    bins = v.genes.select(F.col("annot_idx").alias("bin"), "grp_idx", F.col("g_start").alias("b_start"), F.col("g_end").alias("b_end"))
    return cb.assign_bin(clusters, bins, side)


@query("k5_assign_bin", _CLUSTERS + _BINS + " SELECT hit_idx, bin, 1 AS side FROM b1 UNION ALL SELECT hit_idx, bin, 2 FROM b2")
def _(v: Views) -> DataFrame:
    clusters = written(_clusters(v).select("hit_idx", "grp1_idx", "grp2_idx", "start1", "end1", "start2", "end2"), "clusters")
    return _bins(v, clusters, 1).withColumn("side", F.lit(1)).union(_bins(v, clusters, 2).withColumn("side", F.lit(2)))


_TOPN = """(SELECT hit_idx FROM (SELECT c.*, row_number() OVER w AS r, nth_value(length, 2) OVER (PARTITION BY {b}.bin ORDER BY length DESC, start1 DESC, c.hit_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nth
  FROM clusters c JOIN {b} ON {b}.hit_idx = c.hit_idx WINDOW w AS (PARTITION BY {b}.bin ORDER BY length DESC, start1 DESC, c.hit_idx))
WHERE CASE WHEN gene1 AND gene2 THEN length > 100 WHEN gene1 OR gene2 THEN subs >= 2 OR length >= 300 ELSE false END OR (NOT (subs = 1 AND length <= 100) AND (r <= 2 OR length >= floor(0.8 * nth))))"""


@query("k6_topn_filter", _CLUSTERS + _BINS + f" SELECT hit_idx FROM {_TOPN.format(b='b1')} JOIN {_TOPN.format(b='b2')} USING (hit_idx) WHERE hit_idx IN (SELECT hit_idx FROM b1) AND hit_idx IN (SELECT hit_idx FROM b2)")
def _(v: Views) -> DataFrame:
    # clusters and their bins are used on both sides
    clusters = written(_clusters(v), "clusters")
    rows = written(clusters.join(_bins(v, clusters, 1).withColumnRenamed("bin", "bin1"), "hit_idx", "left").join(_bins(v, clusters, 2).withColumnRenamed("bin", "bin2"), "hit_idx", "left"), "binned-clusters")
    kept = [cb.topn_filter(rows.filter(f"bin{k} is not null"), f"bin{k}").filter(f"bin{3 - k} is not null").select("hit_idx") for k in (1, 2)]
    return kept[0].join(kept[1], "hit_idx", "left_semi")


@query(
    "k7_hit_annot_algo1",
    """ SELECT hit_idx, annot_idx, 1 AS side, CAST(floor(100.0 * (least(end1, g_end) - greatest(start1, g_start) + 1) / (end1 - start1) + 0.5) AS INT) AS olap FROM hits JOIN genes ON grp_idx = grp1_idx AND start1 <= g_end AND g_start <= end1
UNION ALL SELECT hit_idx, annot_idx, 2, CAST(floor(100.0 * (least(end2, g_end) - greatest(start2, g_start) + 1) / (end2 - start2) + 0.5) AS INT) FROM hits JOIN genes ON grp_idx = grp2_idx AND start2 <= g_end AND g_start <= end2""",
)
def _(v: Views) -> DataFrame:
    return cb.hit_annot_algo1(v.hits, v.genes)


@query(
    "k8_merge_diagonal_hits",
    """, d AS (SELECT *, start2 - start1 AS diag FROM hits WHERE strand IN ('+/+', '-/-')), n AS (SELECT *, CASE WHEN start1 <= max(end1) OVER (PARTITION BY grp1_idx, grp2_idx, diag ORDER BY start1, end1 DESC, hit_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM d),
p AS (SELECT *, sum(new) OVER (PARTITION BY grp1_idx, grp2_idx, diag ORDER BY start1, end1 DESC, hit_idx ROWS UNBOUNDED PRECEDING) AS part FROM n)
SELECT grp1_idx, grp2_idx, diag, min(start1) AS start1, max(end1) AS end1, count(*) AS n FROM p GROUP BY grp1_idx, grp2_idx, diag, part""",
)
def _(v: Views) -> DataFrame:
    return cb.merge_diagonal_hits(v.hits)


# --- second algorithm ---


def _cover_sql(k: int) -> str:
    return f"""SELECT h.hit_idx, g.annot_idx, max(least(end{k}, g_end) - greatest(start{k}, g_start) + 1) AS overlap, CAST(coalesce(sum(greatest(0, least(end{k}, e_end) - greatest(start{k}, e_start) + 1)), 0) AS BIGINT) AS exon_bases
FROM hits h JOIN genes g ON g.grp_idx = grp{k}_idx AND start{k} <= g_end AND g_start <= end{k} LEFT JOIN exons x ON x.gene_idx = g.annot_idx GROUP BY 1, 2"""


_COVERS = f", c1 AS ({_cover_sql(1)}), c2 AS ({_cover_sql(2)})"


def _covers(v: Views) -> tuple[DataFrame, DataFrame]:
    return tuple(cp.hit_exon_cover(v.hits, v.genes, v.exons, k) for k in (1, 2))


@query("x1_hit_exon_cover", _COVERS + " SELECT *, 1 AS side FROM c1 UNION ALL SELECT *, 2 FROM c2")
def _(v: Views) -> DataFrame:
    a, b = _covers(v)
    return a.withColumn("side", F.lit(1)).union(b.withColumn("side", F.lit(2)))


_PAIRS = _COVERS + """, pairs AS (SELECT h.hit_idx, c1.annot_idx AS gene1, c2.annot_idx AS gene2, h.strand IN ('+/+', '-/-') AS same, c1.exon_bases AS exon1, c2.exon_bases AS exon2
FROM hits h JOIN c1 ON c1.hit_idx = h.hit_idx JOIN c2 ON c2.hit_idx = h.hit_idx JOIN genes a ON a.annot_idx = c1.annot_idx JOIN genes b ON b.annot_idx = c2.annot_idx WHERE (a.strand = b.strand) = (h.strand IN ('+/+', '-/-')))"""


def _pairs(v: Views) -> DataFrame:
    return cp.gene_pairs(v.hits, *_covers(v), v.genes)


@query("x2_gene_pairs", _PAIRS + " SELECT * FROM pairs")
def _(v: Views) -> DataFrame:
    return _pairs(v)


def _pct(a: str, b: str) -> str:
    return f"round(least(100.0, 100.0 * {a} / greatest({b}, 1)), 6)"


def _scores_sql(pairs: str, name: str) -> str:
    """Scores ``name`` of the groups (gene1, gene2, same, part) of ``pairs``."""
    keys = "gene1, gene2, same, part"
    low = lambda k: f"greatest(h.start{k}, coalesce(max(h.end{k}) OVER (PARTITION BY {keys} ORDER BY h.start{k}, h.end{k} DESC, h.hit_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1) AS low{k}"
    inside = lambda k, lo, hi: f"greatest(0, least(end{k}, {hi}) - greatest(low{k}, {lo}) + 1)"
    exon = lambda k: f"{name}_e{k} AS (SELECT {keys}, CAST(sum({inside(k, 'e_start', 'e_end')}) AS BIGINT) AS x{k}, sum(CAST({inside(k, 'e_start', 'e_end')} AS DOUBLE) / (e_end - e_start + 1)) AS f{k} FROM {name}_o JOIN exons ON gene_idx = gene{k} GROUP BY ALL)"
    side = lambda k, g: f"""CAST(sum(greatest(0, end{k} - low{k} + 1)) AS BIGINT) AS m{k}, sum({inside(k, f'{g}.g_start', f'{g}.g_end')}) AS in{k}, min(start{k}) AS lo{k}, max(end{k}) AS hi{k},
  CAST(sum(pctid * (end{k} - start{k} + 1)) AS DOUBLE) / sum(end{k} - start{k} + 1) AS id{k}, CAST(sum(cvgpct * (end{k} - start{k} + 1)) AS DOUBLE) / sum(end{k} - start{k} + 1) AS sim{k}"""  # noqa: E731
    shares = lambda k, g: f"""{g}.grp_idx AS grp{k}, coalesce(x{k}, 0) AS x{k}, {_pct(f'm{k}', f'hi{k} - lo{k} + 1')} AS cov{k}, {_pct(f'in{k}', f'{g}.glen')} AS gcov{k}, {_pct(f'greatest(0, least(hi{k}, {g}.g_end) - greatest(lo{k}, {g}.g_start) + 1)', f'{g}.glen')} AS golap{k},
  {_pct(f'coalesce(f{k}, 0) / greatest({g}.nex, 1)', '1')} AS frac{k}, {_pct(f'coalesce(x{k}, 0)', f'{g}.elen')} AS exon{k}"""  # noqa: E731
    return f""", {name}_o AS (SELECT p.*, h.start1, h.end1, h.start2, h.end2, h.pctid, h.cvgpct, {low(1)}, {low(2)} FROM {pairs} p JOIN hits h ON h.hit_idx = p.hit_idx),
{exon(1)}, {exon(2)},
{name}_m AS (SELECT {keys}, count(*) AS subs, min(hit_idx) AS first, {side(1, 'a')}, {side(2, 'b')} FROM {name}_o JOIN genes a ON a.annot_idx = gene1 JOIN genes b ON b.annot_idx = gene2 GROUP BY {keys}),
{name} AS (SELECT m.*, {shares(1, 'a')}, {shares(2, 'b')}, round(CAST(least(a.glen, b.glen) AS DOUBLE) / greatest(a.glen, b.glen), 6) AS ratio, greatest(m1, m2) AS longest,
  CAST(round(CASE WHEN m1 >= m2 THEN id1 ELSE id2 END) AS INT) AS pctid, CAST(round(CASE WHEN m1 >= m2 THEN sim1 ELSE sim2 END) AS INT) AS pctsim
  FROM {name}_m m JOIN sz a ON a.annot_idx = gene1 JOIN sz b ON b.annot_idx = gene2 LEFT JOIN {name}_e1 USING ({keys}) LEFT JOIN {name}_e2 USING ({keys}))"""


_SCORES = _PAIRS + """, sz AS (SELECT annot_idx, grp_idx, g_start, g_end, g_end - g_start + 1 AS glen, coalesce(e.elen, 0) AS elen, coalesce(e.nex, 0) AS nex
FROM genes LEFT JOIN (SELECT gene_idx, sum(e_end - e_start + 1) AS elen, count(*) AS nex FROM exons GROUP BY 1) e ON gene_idx = annot_idx)""" + _scores_sql("(SELECT *, 0 AS part FROM pairs)", "scores")
_SCORE_COLS = ["gene1", "gene2", "same", "subs", "m1", "m2", "cov1", "gcov1", "golap1", "frac1", "exon1", "cov2", "gcov2", "golap2", "frac2", "exon2", "ratio", "longest", "pctid", "pctsim", "first"]


def _scores(v: Views) -> DataFrame:
    return cp.pair_scores(_pairs(v), v.hits, v.genes, v.exons)


@query("x3_pair_scores", _SCORES + f" SELECT {', '.join(_SCORE_COLS)} FROM scores")
def _(v: Views) -> DataFrame:
    return _scores(v).select(*_SCORE_COLS)


@query("x4_hit_type", _COVERS + """ SELECT h.hit_idx, CASE WHEN annot1_idx IS NULL THEN 'n' WHEN coalesce(c1.exon_bases, 0) > 0.001 THEN 'E' ELSE 'I' END || CASE WHEN annot2_idx IS NULL THEN 'n' WHEN coalesce(c2.exon_bases, 0) > 0.001 THEN 'E' ELSE 'I' END AS type
FROM hits h LEFT JOIN c1 ON c1.hit_idx = h.hit_idx AND c1.annot_idx = annot1_idx LEFT JOIN c2 ON c2.hit_idx = h.hit_idx AND c2.annot_idx = annot2_idx""")
def _(v: Views) -> DataFrame:
    rows = v.hits
    for k, c in zip((1, 2), _covers(v), strict=True):
        rows = rows.join(c.select("hit_idx", F.col("annot_idx").alias(f"annot{k}_idx"), F.col("exon_bases").alias(f"x{k}")), ["hit_idx", f"annot{k}_idx"], "left")
    has = lambda k: F.col(f"annot{k}_idx").isNotNull()
    return rows.select("hit_idx", cp.hit_type(has(1), has(2), F.coalesce("x1", F.lit(0)), F.coalesce("x2", F.lit(0))).alias("type"))


@query("x5_trim_ends")
def _(v: Views) -> DataFrame:
    return cp.trim_ends(cp.placed_pairs(v.hits, v.genes, v.exons), v.hits, v.genes, gap=100, over=20)


_OKAY = """NOT (greatest(exon1, frac1, exon2, frac2) < 0.1 AND greatest(gcov1, golap1, gcov2, golap2) < 2) AND NOT (exon1 <= 0.001 AND exon2 <= 0.001 AND longest < 1000)"""
_NEAR = [f"(greatest(exon{k}, frac{k}) >= 60 AND greatest(gcov{k}, golap{k}) >= 60 AND cov{k} >= 40)" for k in (1, 2)]
_LOOSE = [f"(CAST(greatest(exon{k}, frac{k}) > 20 AS INT) + CAST(greatest(gcov{k}, golap{k}) > CASE WHEN exon1 > 0.001 AND exon2 > 0.001 THEN 25 ELSE 50 END AS INT) + CAST(subs > 1 AND cov{k} > 20 AS INT))" for k in (1, 2)]
_PASS = f"""(least(exon1, golap1, cov1) >= 80 OR least(exon2, golap2, cov2) >= 80 OR (longest > 1000 AND {_NEAR[0]} AND {_NEAR[1]}) OR (longest > 5000 AND ({_NEAR[0]} OR {_NEAR[1]})) OR (longest > 10000 AND ratio > 0.5 AND least(frac1, frac2) > 60)
  OR (longest >= 300 AND least({_LOOSE[0]}, {_LOOSE[1]}) >= 1 AND greatest({_LOOSE[0]}, {_LOOSE[1]}) >= 2))"""


def _filtered(v: Views, pairs: DataFrame) -> DataFrame:
    """The scores are used twice, the pairs up to three times: both are tables."""
    scores = written(cp.pair_scores(pairs, v.hits, v.genes, v.exons), "pair_scores")
    return cp.filter_gene_pairs(scores, pairs, v.hits, v.genes, v.exons)


def _passed(v: Views) -> DataFrame:
    return _filtered(v, written(_pairs(v), "gene_pairs"))


@query(
    "x6_filter_gene_pairs",
    _SCORES + f", bad AS (SELECT gene1, gene2, same FROM scores WHERE {_OKAY} AND NOT {_PASS} AND subs > 1)" + _scores_sql("(SELECT p.*, p.hit_idx AS part FROM pairs p SEMI JOIN bad USING (gene1, gene2, same))", "singles")
    + f" SELECT gene1, gene2, same, CAST(part AS BIGINT) AS part FROM scores WHERE {_OKAY} AND {_PASS} UNION ALL SELECT gene1, gene2, same, part FROM singles WHERE {_PASS}",
)
def _(v: Views) -> DataFrame:
    return _passed(v).select("gene1", "gene2", "same", "part")


def _by(*sides: int) -> str:
    return "(exon1 > 0.001 AND exon2 > 0.001) DESC, " + ", ".join(f"{c}{k} DESC" for k in sides for c in ("exon", "golap", "cov")) + ", ratio DESC, subs DESC, first, gene1, gene2"


_RANK2 = _SCORES + f""", ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY gene1, grp2, same ORDER BY {_by(1, 2)}) AS INT) AS rank1,
  CAST(row_number() OVER (PARTITION BY gene2, grp1, same ORDER BY {_by(2, 1)}) AS INT) AS rank2 FROM scores)"""


@query("x7_rank_pairs", _RANK2 + " SELECT gene1, gene2, same, rank1, rank2 FROM ranked")
def _(v: Views) -> DataFrame:
    return cp.rank_pairs(_scores(v)).select("gene1", "gene2", "same", "rank1", "rank2")


@query("x8_reciprocal_best", _RANK2 + " SELECT gene1, gene2, same, first FROM ranked WHERE rank1 = 1 AND rank2 = 1")
def _(v: Views) -> DataFrame:
    return cp.reciprocal_best(_scores(v)).select("gene1", "gene2", "same", "first")


@query("x9_major_minor")
def _(v: Views) -> DataFrame:
    pairs = written(cp.trim_ends(cp.placed_pairs(v.hits, v.genes, v.exons), v.hits, v.genes), "gene_pairs")
    passed = written(_filtered(v, pairs), "passed_pairs")
    return cp.good_enough_and_minor(passed, pairs, v.genes)


_CUTOFFS = """, it AS (SELECT proj_idx, e_end - e_start + 1 AS len, e_start - lag(e_end) OVER (PARTITION BY gene_idx ORDER BY e_start) - 1 AS intron FROM exons),
st AS (SELECT proj_idx, coalesce(avg(CASE WHEN intron > 0 THEN intron END), 0) AS i, 100.0 * sum(len) / (SELECT sum(g_end - g_start + 1) FROM genes g WHERE g.proj_idx = it.proj_idx) AS c FROM it GROUP BY 1)"""


@query(
    "x10_pair_cutoffs",
    _CUTOFFS + """ SELECT a.proj_idx AS proj1_idx, b.proj_idx AS proj2_idx, CAST(greatest(1000, least(9000, floor(a.i + b.i))) AS INT) AS intron2, CAST(greatest(1500, least(15000, floor(2 * (a.i + b.i)))) AS INT) AS intron4,
  CAST(greatest(1000, least(2500, floor(greatest(1000, least(9000, floor(a.i + b.i))) / 2))) AS INT) AS rm, CAST(2 * least(20, round((a.c + b.c) / 2)) AS INT) AS cover2 FROM st a JOIN st b ON a.proj_idx <= b.proj_idx""",
)
def _(v: Views) -> DataFrame:
    return cp.pair_cutoffs(an.gene_model_stats(v.genes, v.exons))


def _cutoffs(v: Views) -> DataFrame:
    return written(cp.pair_cutoffs(an.gene_model_stats(v.genes, v.exons)), "pair_cutoffs")


@query("x10_one_gene_clusters")
def _(v: Views) -> DataFrame:
    rows = [cp.one_gene_clusters(v.hits, v.genes, v.exons, _covers(v)[k - 1], _cutoffs(v), k).select(F.lit(k).alias("side"), "gene", "ogrp", "same", "chain", "subs", "m1", "m2") for k in (1, 2)]
    return rows[0].union(rows[1])


@query("x11_no_gene_clusters")
def _(v: Views) -> DataFrame:
    return cp.no_gene_clusters(v.hits, _cutoffs(v), least_bases=200).select("grp1_idx", "grp2_idx", "same", "chain", "subs", "m1", "m2")


def _piles(v: Views) -> DataFrame:
    return cp.find_piles(v.hits_one, 1)


@query(
    "x12_find_piles",
    """ SELECT hit_idx, pile FROM (WITH RECURSIVE c AS MATERIALIZED (
    SELECT hit_idx, grp1_idx, grp2_idx, start1 AS s, end1 AS e, row_number() OVER (PARTITION BY grp1_idx, grp2_idx ORDER BY start1, end1 DESC, hit_idx) AS k FROM hits_one),
  head AS MATERIALIZED (SELECT y.hit_idx, arg_min(x.hit_idx, x.k) AS up FROM c x JOIN c y ON x.grp1_idx = y.grp1_idx AND x.grp2_idx = y.grp2_idx AND x.k < y.k AND x.e >= y.s
    WHERE least(x.e, y.e) - y.s + 1 > 0.4 * (y.e - y.s + 1) OR least(x.e, y.e) - y.s + 1 > 0.4 * (x.e - x.s + 1) GROUP BY y.hit_idx),
  down AS (SELECT hit_idx, hit_idx AS pile FROM c WHERE hit_idx NOT IN (SELECT hit_idx FROM head)
    UNION ALL SELECT head.hit_idx, down.pile FROM down JOIN head ON head.up = down.hit_idx)
  SELECT hit_idx, pile FROM down) z""",
)
def _(v: Views) -> DataFrame:
    return _piles(v)


@query(
    "x13_filter_piles",
    """, p AS (SELECT hit_idx, grp1_idx * 1000 + start1 // 1000 AS pile, CASE hit_idx % 3 WHEN 0 THEN 'EE' WHEN 1 THEN 'II' ELSE 'In' END AS type, score AS length FROM hits_one)
SELECT hit_idx FROM p x WHERE type = 'EE' OR (length >= (SELECT floor(0.8 * max(length)) FROM p t WHERE t.pile = x.pile)
  AND (SELECT count(*) FROM p t WHERE t.pile = x.pile AND t.type <> 'EE' AND (t.length > x.length OR (t.length = x.length AND t.hit_idx < x.hit_idx))) < 2)""",
)
def _(v: Views) -> DataFrame:
    kind = F.element_at(F.array(F.lit("EE"), F.lit("II"), F.lit("In")), (F.col("hit_idx") % 3 + 1).cast("int"))
    rows = v.hits_one.select("hit_idx", F.expr("grp1_idx * 1000 + start1 div 1000").alias("pile"), kind.alias("type"), F.col("score").alias("length"))
    return cp.filter_piles(rows).select("hit_idx")


def _whole(c: str) -> str:
    return f"CAST(CASE WHEN {c} > 99 AND {c} < 100 THEN 99 WHEN {c} >= 100 THEN 100 WHEN {c} > 0 AND {c} < 1 THEN 1 ELSE round({c}) END AS INT)"


@query(
    "x14_hit_annot_algo2",
    _SCORES + f""", s AS (SELECT first AS hit_idx, gene1 AS annot_idx, 1 AS side, {_whole("gcov1")} AS olap, {_whole("exon1")} AS exlap, gene2 AS other FROM scores UNION ALL SELECT first, gene2, 2, {_whole("gcov2")}, {_whole("exon2")}, gene1 FROM scores)
SELECT hit_idx, annot_idx, side, olap, exlap, other FROM (SELECT *, row_number() OVER (PARTITION BY hit_idx, annot_idx ORDER BY exlap DESC, olap DESC, other) AS r FROM s) WHERE r = 1""",
)
def _(v: Views) -> DataFrame:
    return cp.hit_annot_algo2(_scores(v))


@query(
    "x15_wrong_strand_report",
    _COVERS + """ SELECT c1.annot_idx AS gene1, c2.annot_idx AS gene2, count(*) AS n FROM hits h JOIN c1 ON c1.hit_idx = h.hit_idx AND c1.exon_bases > 0 JOIN c2 ON c2.hit_idx = h.hit_idx AND c2.exon_bases > 0
JOIN genes a ON a.annot_idx = c1.annot_idx JOIN genes b ON b.annot_idx = c2.annot_idx WHERE (a.strand = b.strand) <> (h.hit_idx % 2 = 0) GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def _(v: Views) -> DataFrame:
    return cp.wrong_strand_report(v.hits.withColumn("strand", F.expr("if(hit_idx % 2 = 0, '+/+', '+/-')")), *_covers(v), v.genes)
