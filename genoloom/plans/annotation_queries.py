"""Queries over annotation, hits and collinear sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.functions import intervals as iv
from genoloom.functions import scalars as sc
from genoloom.operators import annotation as an
from genoloom.operators import collinear as co
from genoloom.operators import hits as hi
from genoloom.plans.fixtures import Views
from genoloom.plans.registry import query


@query(
    "f1_reverse_complement",
    """ SELECT seq_idx, reverse(translate(seq, 'acgtACGTn', 'tgcaTGCAN')) AS rc FROM seqs""",
)
def _(v: Views) -> DataFrame:
    return v.seqs.select("seq_idx", sc.reverse_complement(F.col("seq")).alias("rc"))


@query(
    "f2_translate_codons",
    f""", codons AS (SELECT seq_idx, upper(substr(seq, CAST(k * 3 + 1 AS BIGINT), 3)) AS c, k FROM (SELECT seq_idx, seq, unnest(range(0, length(seq) // 3)) AS k FROM seqs) x)
SELECT s.seq_idx, coalesce(string_agg(CASE WHEN regexp_matches(c, '^[ACGT]{{3}}$') THEN
  substr('{sc.AMINO_ACIDS}', CAST(instr('TCAG', substr(c, 1, 1)) * 16 + instr('TCAG', substr(c, 2, 1)) * 4 + instr('TCAG', substr(c, 3, 1)) - 20 AS BIGINT), 1) ELSE 'X' END, '' ORDER BY k), '') AS protein
FROM seqs s LEFT JOIN codons USING (seq_idx) WHERE s.seq_idx IS NOT NULL GROUP BY s.seq_idx""".replace("ELSE 'X' END, '' ORDER BY k), '')", "WHEN c IS NULL THEN '' ELSE 'X' END, '' ORDER BY k), '')"),
)
def _(v: Views) -> DataFrame:
    return v.seqs.select("seq_idx", sc.translate_codons(F.col("seq")).alias("protein"))


@query(
    "f4_overlap_formulas",
    """ SELECT hit_idx, annot_idx, greatest(start1, g_start) - least(end1, g_end) AS gap, -(least(end1, g_end) - greatest(start1, g_start) + 1) AS gap_olap,
  greatest(0, least(end1, g_end) - greatest(start1, g_start) + 1) AS olap, (start1 + end1) // 2 AS mid FROM hits JOIN genes ON annot_idx = annot1_idx""",
)
def _(v: Views) -> DataFrame:
    rows = v.hits.join(v.genes, F.col("annot_idx") == F.col("annot1_idx"))
    four = [F.col(c) for c in ("start1", "end1", "g_start", "g_end")]
    return rows.select("hit_idx", "annot_idx", iv.overlap_gap(*four).alias("gap"), iv.gap_or_overlap(*four).alias("gap_olap"), iv.overlap_only(*four).alias("olap"), iv.midpoint(four[0], four[1]).alias("mid"))


@query(
    "f5_labels",
    """, r AS (SELECT b.block_idx, g1.name AS n1, g2.name AS n2, blocknum FROM blocks b JOIN groups g1 ON g1.grp_idx = b.grp1_idx JOIN groups g2 ON g2.grp_idx = b.grp2_idx)
SELECT block_idx, CAST(blocknum AS INT) AS number, substr(n1, 4) || '.' || substr(n2, 4) || '.' || blocknum AS label, substr(n1, 4) || '.' || blocknum || '.b' AS gene FROM r""",
)
def _(v: Views) -> DataFrame:
    name = lambda k: v.groups.select(F.col("grp_idx").alias(f"grp{k}_idx"), F.concat(F.lit("0"), F.substring("name", 4, 9)).alias(f"n{k}"))
    rows = v.blocks.join(name(1), "grp1_idx").join(name(2), "grp2_idx")
    tag = F.concat(F.col("blocknum").cast("string"), F.lit(".b (3 1,200)"))
    bare = F.regexp_replace("n1", "^0", "")
    return rows.select("block_idx", sc.gene_number(tag).alias("number"), sc.block_label(F.col("n1"), F.col("n2"), F.col("blocknum")).alias("label"), sc.gene_label(bare, tag).alias("gene"))


@query(
    "f6_pearson",
    """, m AS (SELECT grp1_idx, grp2_idx, (start1 + end1) // 2 AS x, (start2 + end2) // 2 AS y FROM hits)
SELECT grp1_idx, grp2_idx, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) <= 2 OR min(x) = max(x) OR min(y) = max(y) THEN 0 ELSE corr(x, y) END, 6) AS r FROM m GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    x, y = iv.midpoint(F.col("start1"), F.col("end1")), iv.midpoint(F.col("start2"), F.col("end2"))
    return v.hits.select("grp1_idx", "grp2_idx", x.alias("x"), y.alias("y")).groupBy("grp1_idx", "grp2_idx").agg(F.count(F.lit(1)).alias("n"), F.round(sc.pearson(F.col("x"), F.col("y")), 6).alias("r"))


_SUBS = "concat(CAST(start1 AS STRING), ':', CAST(start1 + score // 2 AS STRING), ',', CAST(start1 + score // 2 + 1 + hit_idx % 3 AS STRING), ':', CAST(end1 AS STRING))"


def _subhits(v: Views) -> DataFrame:
    text = F.expr("if(hit_idx % 5 = 0, '', " + _SUBS.replace("//", "div") + ")")
    return v.hits.withColumn("subs", hi.parse_subhits(text, F.col("start1"), F.col("end1")))


@query(
    "h3_subhits",
    f""" SELECT hit_idx, CASE WHEN hit_idx % 5 = 0 THEN concat(start1, ':', end1) ELSE {_SUBS} END AS text, CAST(CASE WHEN hit_idx % 5 = 0 THEN 1 ELSE 2 END AS INT) AS n FROM hits""",
)
def _(v: Views) -> DataFrame:
    return _subhits(v).select("hit_idx", hi.format_subhits(F.col("subs")).alias("text"), F.size("subs").alias("n"))


@query(
    "h4_merge_subhits",
    f""" SELECT hit_idx, CASE WHEN hit_idx % 5 = 0 OR hit_idx % 3 = 0 THEN concat(start1, ':', end1) ELSE {_SUBS} END AS text FROM hits""",
)
def _(v: Views) -> DataFrame:
    return _subhits(v).select("hit_idx", hi.format_subhits(hi.merge_subhits(F.col("subs"))).alias("text"))


@query(
    "h1_canonical_self_hits",
    """, raw AS (SELECT hit_idx, grp1_idx % 10 AS g1, grp2_idx % 10 AS g2, start1, end1, start2, end2, strand FROM hits),
s AS (SELECT hit_idx, greatest(g1, g2) AS grp1_idx, least(g1, g2) AS grp2_idx, CASE WHEN g1 < g2 THEN start2 ELSE start1 END AS start1, CASE WHEN g1 < g2 THEN end2 ELSE end1 END AS end1,
  CASE WHEN g1 < g2 THEN start1 ELSE start2 END AS start2, CASE WHEN g1 < g2 THEN end1 ELSE end2 END AS end2, CASE WHEN g1 < g2 THEN reverse(strand) ELSE strand END AS strand FROM raw)
SELECT * FROM s WHERE grp1_idx > grp2_idx OR start1 > start2 OR (start1 = start2 AND end1 <> end2)""",
)
def _(v: Views) -> DataFrame:
    raw = v.hits.select("hit_idx", (F.col("grp1_idx") % 10).alias("grp1_idx"), (F.col("grp2_idx") % 10).alias("grp2_idx"), "start1", "end1", "start2", "end2", "strand")
    return hi.canonical_self_hits(raw)


@query(
    "h2_split_long_hits",
    """, p AS (SELECT hit_idx, start1, end1, start2, end2, strand IN ('+/+', '-/-') AS same, greatest(1, least((end1 - start1 + 1) // 60 + CASE WHEN (end1 - start1 + 1) % 60 >= 6 THEN 1 ELSE 0 END,
  (end2 - start2 + 1) // 60 + CASE WHEN (end2 - start2 + 1) % 60 >= 6 THEN 1 ELSE 0 END)) AS n FROM hits), e AS (SELECT *, unnest(range(0, n)) AS k FROM p)
SELECT hit_idx, CAST(k + 1 AS INT) AS part, start1 + k * 60 AS start1, CASE WHEN k = n - 1 THEN end1 ELSE start1 + k * 60 + 59 END AS end1,
  CASE WHEN same THEN start2 + k * 60 WHEN k = n - 1 THEN start2 ELSE end2 - k * 60 - 59 END AS start2, CASE WHEN NOT same THEN end2 - k * 60 WHEN k = n - 1 THEN end2 ELSE start2 + k * 60 + 59 END AS end2 FROM e""",
)
def _(v: Views) -> DataFrame:
    return hi.split_long_hits(v.hits.select("hit_idx", "start1", "end1", "start2", "end2", "strand"), 60).drop("strand")


@query(
    "h5_hit_gene_overlaps",
    """ SELECT hit_idx, annot_idx, 1 AS side, least(end1, g_end) - greatest(start1, g_start) + 1 AS overlap FROM hits JOIN genes ON grp_idx = grp1_idx AND start1 <= g_end AND g_start <= end1
UNION ALL SELECT hit_idx, annot_idx, 2, least(end2, g_end) - greatest(start2, g_start) + 1 FROM hits JOIN genes ON grp_idx = grp2_idx AND start2 <= g_end AND g_start <= end2""",
)
def _(v: Views) -> DataFrame:
    both = [hi.hit_gene_overlaps(v.hits, v.genes, k, 2000).withColumn("side", F.lit(k)) for k in (1, 2)]
    return both[0].unionByName(both[1]).select("hit_idx", "annot_idx", "side", "overlap")


@query(
    "h6_number_hits",
    """ SELECT hit_idx, CAST(row_number() OVER (PARTITION BY grp1_idx, grp2_idx ORDER BY start1, end1 - start1 DESC, hit_idx) AS INT) AS hitnum FROM hits""",
)
def _(v: Views) -> DataFrame:
    return hi.number_hits(v.hits).select("hit_idx", "hitnum")


@query(
    "h7_gene_hit_counts",
    """ SELECT annot_idx, (SELECT count(DISTINCT hit_idx) FROM hit_annot x WHERE x.annot_idx = g.annot_idx) AS numhits FROM genes g""",
)
def _(v: Views) -> DataFrame:
    return hi.gene_hit_counts(v.genes, v.hit_annot)


_NUMBERED = """, flag AS (SELECT *, CASE WHEN max(g_end) OVER w IS NULL OR (g_start >= max(g_end) OVER w AND g_end > max(g_end) OVER w) THEN 1 ELSE 0 END AS new
  FROM genes WINDOW w AS (PARTITION BY grp_idx ORDER BY g_start, g_end DESC, annot_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY grp_idx ORDER BY g_start, g_end DESC, annot_idx ROWS UNBOUNDED PRECEDING) AS INT) AS genenum FROM flag)"""


@query(
    "h8_number_pseudo_genes",
    _NUMBERED + """, top AS (SELECT grp_idx, max(genenum) AS top FROM numbered GROUP BY grp_idx),
sides AS (SELECT grp1_idx AS grp_idx, hit_idx, 1 AS side, start1 AS s, end1 AS e FROM hits WHERE annot1_idx IS NULL UNION ALL SELECT grp2_idx, hit_idx, 2, start2, end2 FROM hits WHERE annot2_idx IS NULL),
n AS (SELECT grp_idx, hit_idx, side, CAST(coalesce((top // 100 + 1) * 100, 0) + row_number() OVER (PARTITION BY grp_idx ORDER BY side, s, e, hit_idx) AS INT) AS genenum FROM sides LEFT JOIN top USING (grp_idx))
SELECT grp_idx, hit_idx, side, genenum, genenum || '.~' AS tag FROM n""",
)
def _(v: Views) -> DataFrame:
    return hi.number_pseudo_genes(v.hits, an.number_genes(v.genes)).select("grp_idx", "hit_idx", "side", "genenum", "tag")


@query(
    "h9_mirror_self",
    """ SELECT hit_idx, grp1_idx, grp2_idx, start1, end1, start2, end2, annot1_idx, annot2_idx, strand, CAST(0 AS BIGINT) AS refidx FROM hits
UNION ALL SELECT hit_idx, grp2_idx, grp1_idx, start2, end2, start1, end1, annot2_idx, annot1_idx, reverse(strand), hit_idx FROM hits""",
)
def _(v: Views) -> DataFrame:
    return hi.mirror_self(v.hits.select("hit_idx", "grp1_idx", "grp2_idx", "start1", "end1", "start2", "end2", "annot1_idx", "annot2_idx", "strand"))


@query(
    "a2_annot_keywords",
    """, k AS (SELECT proj_idx, split_part(unnest(string_split(attrs, ';')), '=', 1) AS keyname FROM genes), c AS (SELECT proj_idx, keyname, count(*) AS count FROM k GROUP BY ALL)
SELECT proj_idx, keyname, count, CAST(row_number() OVER (PARTITION BY proj_idx ORDER BY count DESC, keyname) AS INT) AS rank FROM c""",
)
def _(v: Views) -> DataFrame:
    return an.annot_keywords(v.genes)


@query("a2_describe", """ SELECT annot_idx, CASE WHEN p_size % 2 = 0 THEN '[no description]' ELSE 'desc=' || p_type END AS description FROM genes""")
def _(v: Views) -> DataFrame:
    some = v.genes.withColumn("attrs", F.expr("if(p_size % 2 = 0, 'ID=7', attrs)"))
    return an.describe(some, keywords=["desc"]).select("annot_idx", "description")


@query("a3_number_genes", _NUMBERED + " SELECT annot_idx, grp_idx, genenum FROM numbered")
def _(v: Views) -> DataFrame:
    return an.number_genes(v.genes).select("annot_idx", "grp_idx", "genenum")


_TAGS = (
    _NUMBERED
    + """, ex AS (SELECT gene_idx, count(*) AS n, sum(e_end - e_start + 1) AS len FROM exons GROUP BY gene_idx),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp_idx, genenum ORDER BY g_start, g_end DESC, annot_idx) AS r, count(*) OVER (PARTITION BY grp_idx, genenum) AS c FROM numbered),
tags AS (SELECT annot_idx, genenum, CASE WHEN c < 2 THEN '' ELSE chr(CAST(97 + (r - 1) % 26 AS INT)) || CASE WHEN r > 26 THEN CAST((r - 1) // 26 + 1 AS VARCHAR) ELSE '' END END AS suffix, n, len
  FROM ranked LEFT JOIN ex ON gene_idx = annot_idx)"""
)


@query("a4_gene_tags", _TAGS + " SELECT annot_idx, suffix, genenum || '.' || suffix || ' (' || coalesce(n, 0) || '  ' || format('{:,}', CAST(coalesce(len, 0) AS BIGINT)) || ')' AS tag FROM tags")
def _(v: Views) -> DataFrame:
    return an.gene_tags(an.number_genes(v.genes), v.exons).select("annot_idx", "suffix", "tag")


@query("a5_exon_numbers", " SELECT gene_idx, e_start, CAST(row_number() OVER (PARTITION BY gene_idx ORDER BY e_start) AS INT) AS exon_num FROM exons")
def _(v: Views) -> DataFrame:
    return an.exon_numbers(v.exons).select("gene_idx", "e_start", "exon_num")


@query("a6_sort_groups", " SELECT grp_idx, name, CAST(row_number() OVER (PARTITION BY proj_idx ORDER BY CAST(substr(name, 4) AS INT), grp_idx) AS INT) AS rank FROM groups")
def _(v: Views) -> DataFrame:
    return an.sort_groups(v.groups).select("grp_idx", "name", "rank")


@query(
    "a7_project_view",
    """, g AS (SELECT grp_idx, count(*) AS n_genes, avg(g_end - g_start + 1) AS avg_gene FROM genes GROUP BY 1), e AS (SELECT grp_idx, count(*) AS n_exons, avg(e_end - e_start + 1) AS avg_exon FROM exons GROUP BY 1),
r AS (SELECT proj_idx, grp_idx, length, coalesce(n_genes, 0) AS n_genes, avg_gene, coalesce(n_exons, 0) AS n_exons, avg_exon FROM groups LEFT JOIN g USING (grp_idx) LEFT JOIN e USING (grp_idx))
SELECT proj_idx, grp_idx, length, n_genes, round(avg_gene, 6) AS avg_gene, n_exons, round(avg_exon, 6) AS avg_exon FROM r
UNION ALL SELECT proj_idx, NULL, CAST(sum(length) AS BIGINT), CAST(sum(n_genes) AS BIGINT), round(avg(avg_gene), 6), CAST(sum(n_exons) AS BIGINT), round(avg(avg_exon), 6) FROM r GROUP BY proj_idx""",
)
def _(v: Views) -> DataFrame:
    return an.project_view(v.groups, v.genes, v.exons).withColumn("avg_gene", F.round("avg_gene", 6)).withColumn("avg_exon", F.round("avg_exon", 6))


@query(
    "a9_gene_model_stats",
    """, i AS (SELECT proj_idx, e_end - e_start + 1 AS len, e_start - lag(e_end) OVER (PARTITION BY gene_idx ORDER BY e_start) - 1 AS intron FROM exons),
e AS (SELECT proj_idx, avg(len) AS avg_exon, avg(CASE WHEN intron > 0 THEN intron END) AS avg_intron, sum(len) AS se FROM i GROUP BY 1),
g AS (SELECT proj_idx, avg(g_end - g_start + 1) AS avg_gene, min(g_end - g_start + 1) AS min_gene, max(g_end - g_start + 1) AS max_gene, sum(g_end - g_start + 1) AS sg FROM genes GROUP BY 1)
SELECT proj_idx, round(avg_gene, 6) AS avg_gene, round(avg_exon, 6) AS avg_exon, round(avg_intron, 6) AS avg_intron, min_gene, max_gene, round(100.0 * se / sg, 6) AS exon_cover FROM g JOIN e USING (proj_idx)""",
)
def _(v: Views) -> DataFrame:
    s = an.gene_model_stats(v.genes, v.exons)
    return s.select("proj_idx", *[F.round(c, 6).alias(c) for c in ("avg_gene", "avg_exon", "avg_intron")], "min_gene", "max_gene", F.round("exon_cover", 6).alias("exon_cover"))


_RANKS = """, ranks AS (SELECT annot_idx, grp_idx, CAST(row_number() OVER (PARTITION BY grp_idx ORDER BY g_start, g_end - g_start DESC, annot_idx) AS INT) AS rank FROM genes)"""
_RANKED = (
    _RANKS
    + """, nh AS (SELECT *, row_number() OVER (PARTITION BY grp1_idx, grp2_idx ORDER BY start1, end1 - start1 DESC, hit_idx) AS hitnum FROM hits),
rh AS (SELECT hit_idx, hitnum, grp1_idx, grp2_idx, strand IN ('+/+', '-/-') AS same, a.rank AS rank1, b.rank AS rank2 FROM nh JOIN ranks a ON a.annot_idx = annot1_idx JOIN ranks b ON b.annot_idx = annot2_idx),
pr AS (SELECT grp1_idx, grp2_idx, same, rank1, rank2, CASE WHEN same THEN rank2 - rank1 ELSE rank2 + rank1 END AS diag, min(hitnum) AS hitnum FROM rh GROUP BY ALL),
rn AS (SELECT *, rank1 - row_number() OVER (PARTITION BY grp1_idx, grp2_idx, same, diag ORDER BY rank1) AS run FROM pr),
sets AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY grp1_idx, grp2_idx, same, diag, run) AS size FROM rn) WHERE size >= 2)"""
)


@query("l1_gene_rank", _RANKS + " SELECT annot_idx, grp_idx, rank FROM ranks")
def _(v: Views) -> DataFrame:
    return co.gene_rank(v.genes)


def _ranked(v: Views) -> DataFrame:
    return co.ranked_hits(hi.number_hits(v.hits), co.gene_rank(v.genes))


@query("l2_collinear_diagonal", _RANKED + " SELECT grp1_idx, grp2_idx, same, rank1, rank2, size FROM sets")
def _(v: Views) -> DataFrame:
    return co.diagonal_sets(_ranked(v)).select("grp1_idx", "grp2_idx", "same", "rank1", "rank2", "size")


#: The walk over all hits of a chromosome pair and strand class, a step for each hit that ends a scan or takes it on. Of
#: the hits that may do so, the first 64 among the next 400 are listed; a walk that needs more stops with an error.
_SCAN = """, o AS MATERIALIZED (SELECT *, CASE WHEN same THEN 1 ELSE -1 END AS d, dense_rank() OVER (ORDER BY grp1_idx, grp2_idx, same) AS c,
  row_number() OVER (PARTITION BY grp1_idx, grp2_idx, same ORDER BY hitnum, hit_idx) AS p, count(*) OVER (PARTITION BY grp1_idx, grp2_idx, same) AS n FROM rh),
ev AS MATERIALIZED (SELECT i.c, i.p, any_value(i.n) AS n, list({'j': j.p, 'met': j.rank1 = i.rank1 + 1} ORDER BY j.p) FILTER (j.p IS NOT NULL)[:64] AS near FROM o i LEFT JOIN o j ON j.c = i.c AND j.p > i.p AND j.p <= i.p + 400
  AND j.rank1 > i.rank1 AND CASE WHEN j.rank1 = i.rank1 + 1 THEN j.rank2 = i.rank2 + i.d ELSE j.rank2 <> i.rank2 + i.d END GROUP BY i.c, i.p)
SELECT o.hit_idx, o.hitnum, o.grp1_idx, o.grp2_idx, o.same, o.rank1, o.rank2, f.run, f.size FROM (
  WITH RECURSIVE st(c, s, e, chain, used, fin) AS (
    SELECT c, p, p, [p], CAST([] AS BIGINT[]), CAST(NULL AS BIGINT[]) FROM o WHERE p = 1
    UNION ALL
    SELECT c, CASE WHEN met THEN s ELSE s2 END, CASE WHEN met THEN j WHEN j IS NULL OR s2 > n THEN NULL ELSE s2 END, CASE WHEN met THEN list_append(chain, j) ELSE [s2] END,
      CASE WHEN met THEN used ELSE list_filter(taken, lambda x: x > s2) END, CASE WHEN NOT met AND len(chain) > 1 THEN chain END
    FROM (SELECT *, coalesce(first.met, false) AS met, first.j AS j, list_filter(range(s + 1, s + len(taken) + 2), lambda x: NOT list_contains(taken, x))[1] AS s2 FROM (
      SELECT st.*, ev.n, CASE WHEN len(chain) > 1 THEN list_concat(used, chain) ELSE used END AS taken, list_filter(near, lambda k: NOT list_contains(used, k.j))[1] AS first
      FROM st JOIN ev ON ev.c = st.c AND ev.p = st.e) x
      WHERE CASE WHEN first IS NULL AND e + 400 < n THEN error('no hit in reach') ELSE true END) t)
  SELECT c, unnest(fin) AS p, row_number() OVER (PARTITION BY c ORDER BY fin[1]) AS run, CAST(len(fin) AS BIGINT) AS size FROM st WHERE fin IS NOT NULL) f
JOIN o USING (c, p)"""


@query("l2_collinear_scan", _RANKED + _SCAN)
def _(v: Views) -> DataFrame:
    return co.scanned_sets(_ranked(v))


_KEYS = ["same", "diag", "run"]


@query(
    "l3_renumber_sets",
    _RANKED + """, per AS (SELECT grp1_idx, grp2_idx, same, diag, run, max(size) AS runsize, min(hitnum) AS first FROM sets GROUP BY ALL),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp1_idx, grp2_idx ORDER BY runsize DESC, first, same, diag, run) AS INT) AS runnum FROM per)
SELECT grp1_idx, grp2_idx, rank1, rank2, runnum, runsize FROM sets JOIN num USING (grp1_idx, grp2_idx, same, diag, run)""",
)
def _(v: Views) -> DataFrame:
    return co.renumber_sets(co.diagonal_sets(_ranked(v)), _KEYS).select("grp1_idx", "grp2_idx", "rank1", "rank2", "runnum", "runsize")


@query("l4_mirror_sets", " SELECT hit_idx * 2 + k AS hit_idx, CASE WHEN k = 1 THEN hit_idx * 2 ELSE 0 END AS refidx, hit_idx % 9 AS runnum, hit_idx % 4 AS runsize FROM hits CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1)")
def _(v: Views) -> DataFrame:
    first = v.hits.select((F.col("hit_idx") * 2).alias("hit_idx"), F.lit(0).cast("long").alias("refidx"), (F.col("hit_idx") % 9).alias("runnum"), (F.col("hit_idx") % 4).alias("runsize"))
    again = first.select((F.col("hit_idx") + 1).alias("hit_idx"), F.col("hit_idx").alias("refidx"), F.lit(0).cast("long").alias("runnum"), F.lit(0).cast("long").alias("runsize"))
    return co.mirror_sets(first.union(again))


@query("l5_check_sets", _RANKED + " SELECT grp1_idx, grp2_idx, rank1, rank2 FROM sets WHERE false")
def _(v: Views) -> DataFrame:
    return co.check_sets(co.diagonal_sets(_ranked(v)), _KEYS).select("grp1_idx", "grp2_idx", "rank1", "rank2")


@query(
    "p6_collinear_histogram",
    _RANKED + """, per AS (SELECT grp1_idx, grp2_idx, same, diag, run, count(*) AS n FROM sets GROUP BY ALL)
SELECT CASE WHEN n < 10 THEN CAST(n AS VARCHAR) WHEN n < 15 THEN '10-14' WHEN n < 20 THEN '15-19' ELSE '>=20' END AS bucket, count(*) AS sets, CAST(sum(n) AS BIGINT) AS genes FROM per GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    per = co.diagonal_sets(_ranked(v)).groupBy("grp1_idx", "grp2_idx", *_KEYS).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col("n") < 10, F.col("n").cast("string")).when(F.col("n") < 15, "10-14").when(F.col("n") < 20, "15-19").otherwise(">=20")
    return per.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("genes"))
