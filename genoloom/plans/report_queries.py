"""Queries of reports, summaries, views and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.functions.intervals import coverage
from genoloom.operators import blocks as bl
from genoloom.operators import collinear as co
from genoloom.operators import query as qu
from genoloom.operators import reports as rp
from genoloom.operators import summary as su
from genoloom.operators.lineage import written
from genoloom.plans.annotation_queries import _KEYS, _RANKED, _ranked, _subhits
from genoloom.plans.fixtures import VIEWS, Views
from genoloom.plans.question_queries import _CLUSTER, _LINKS, _sized, _SIZED, _thin
from genoloom.plans.registry import query


def _side_list(p: int) -> str:
    return f"coalesce((SELECT string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) FROM d x WHERE x.annot_idx = k.annot_idx AND oproj = {p}), '')"


@query(
    "r1_gene_report",
    _LINKS + f""", d AS (SELECT DISTINCT annot_idx, oproj, other FROM links WHERE proj_idx = 1 AND oproj IN (2, 3)), k AS (SELECT annot_idx, CAST(count(DISTINCT oproj) AS INT) AS n_species FROM d GROUP BY 1)
SELECT annot_idx, {_side_list(2)} AS p2, {_side_list(3)} AS p3, n_species FROM k""",
)
def _(v: Views) -> DataFrame:
    return rp.gene_report(qu.gene_links(v.hits), 1, [2, 3])


@query(
    "r2_gene_report_links",
    _LINKS + """, d AS (SELECT DISTINCT annot_idx, oproj, other FROM links WHERE proj_idx = 1), p AS (SELECT DISTINCT annot_idx AS a, other AS b FROM links),
pairs AS (SELECT x.annot_idx, x.other AS a, y.other AS b FROM d x JOIN d y ON x.annot_idx = y.annot_idx AND x.oproj < y.oproj),
s AS (SELECT annot_idx, count(*) AS possible, count(p.a) AS n FROM pairs LEFT JOIN p ON p.a = pairs.a AND p.b = pairs.b GROUP BY 1)
SELECT d.annot_idx, count(*) AS partners, coalesce(max(n), 0) AS n_links, coalesce(max(possible), 0) > 0 AND coalesce(max(n), 0) = max(possible) AS complete FROM d LEFT JOIN s ON s.annot_idx = d.annot_idx GROUP BY d.annot_idx""",
)
def _(v: Views) -> DataFrame:
    return rp.gene_report_links(qu.gene_links(v.hits), 1)


@query(
    "r3_multi_report",
    _LINKS + """, m AS (SELECT proj_idx, annot_idx, oproj, count(*) AS n FROM links GROUP BY ALL HAVING count(*) >= 4)
SELECT annot_idx, string_agg(oproj || ':' || n, ' ' ORDER BY oproj) AS groups, CAST(sum(n) AS BIGINT) AS hits FROM m WHERE proj_idx = 1 GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return rp.multi_report(qu.multi_hit_genes(qu.gene_links(v.hits), 4), 1)


def _set_genes(v: Views) -> DataFrame:
    keys = ["grp1_idx", "grp2_idx", "same", "diag", "run"]
    sets = co.diagonal_sets(_ranked(v)).withColumn("set_id", F.expr("(cast(grp1_idx as long) * 100 + grp2_idx) * 100000000 + (if(same, 0, 1) * 10000 + diag + 3000) * 10000 + run + 5000"))
    rank = co.gene_rank(v.genes).join(v.genes.select("annot_idx", "proj_idx"), "annot_idx")
    side = lambda a, b: sets.select("set_id", F.col(f"grp{a}_idx").alias("grp_idx"), F.col(f"rank{a}").alias("rank"), F.floor(F.col(f"grp{b}_idx") / 10).cast("int").alias("oproj"))
    assert set(keys) <= set(sets.columns)
    return side(1, 2).union(side(2, 1)).join(rank, ["grp_idx", "rank"]).select("set_id", "annot_idx", "proj_idx", "oproj")


@query(
    "r4_collinear_report",
    _RANKED + """, sid AS (SELECT *, dense_rank() OVER (ORDER BY grp1_idx, grp2_idx, same, diag, run) AS set_id FROM sets),
own AS (SELECT DISTINCT set_id, annot_idx, CAST(floor(sid.grp2_idx / 10) AS INT) AS oproj FROM sid JOIN ranks r ON r.grp_idx = sid.grp1_idx AND r.rank = sid.rank1 WHERE sid.grp1_idx < 20
  UNION SELECT DISTINCT set_id, annot_idx, CAST(floor(sid.grp1_idx / 10) AS INT) FROM sid JOIN ranks r ON r.grp_idx = sid.grp2_idx AND r.rank = sid.rank2 WHERE sid.grp2_idx < 20),
e AS (SELECT DISTINCT x.annot_idx AS a, y.annot_idx AS b FROM own x JOIN own y ON x.set_id = y.set_id),
u AS (SELECT * FROM (WITH RECURSIVE w(node, top) AS (SELECT a, a FROM e UNION SELECT e.b, w.top FROM w JOIN e ON e.a = w.node) SELECT node, min(top) AS top FROM w GROUP BY node))
SELECT top AS union_gene, count(DISTINCT annot_idx) AS genes, count(DISTINCT set_id) AS sets, count(DISTINCT oproj) AS species FROM own JOIN u ON node = annot_idx GROUP BY top HAVING count(DISTINCT oproj) = 2""",
)
def _(v: Views) -> DataFrame:
    return rp.collinear_report(_set_genes(v), 1, [2, 3])


def _cluster_side(p: int) -> str:
    return f"coalesce(string_agg(node || '(' || n || ')', ',' ORDER BY node) FILTER (proj_idx = {p}), '') AS p{p}"


@query(
    "r5_cluster_report",
    _CLUSTER + f""", n AS (SELECT g, count(*) AS n FROM (SELECT a AS g FROM e0 UNION ALL SELECT b FROM e0) x GROUP BY 1)
SELECT cluster, {_cluster_side(1)}, {_cluster_side(2)}, {_cluster_side(3)} FROM walk JOIN n ON g = node JOIN genes ON annot_idx = node GROUP BY cluster""",
)
def _(v: Views) -> DataFrame:
    h = _thin(v)
    return rp.cluster_report(qu.gene_clusters(h), h, v.genes, [1, 2, 3])


@query("r6_cluster_link_rows")
def _(v: Views) -> DataFrame:
    h = _thin(v)
    return rp.cluster_link_rows(qu.gene_clusters(h), h, v.genes)


@query("r7_report_annotation", " SELECT annot_idx, substr(p_name, 1, 8) || '|' || substr(p_type, 1, 8) AS note FROM genes")
def _(v: Views) -> DataFrame:
    return rp.report_annotation(v.genes, ["Name", "missing", "desc"], 8)


@query("r8_block_summary", " SELECT grp1_idx, grp2_idx, count(*) AS blocks, CAST(sum(score) AS BIGINT) AS hits FROM blocks GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return rp.block_summary(v.blocks)


_FINISHED = """, bh AS (SELECT b.block_idx, h.*, (start1 + end1) // 2 AS x, (start2 + end2) // 2 AS y, abs(lead(start1) OVER (PARTITION BY b.block_idx ORDER BY start1, end1, h.hit_idx) - end1) AS g1,
  abs(lead(start2) OVER (PARTITION BY b.block_idx ORDER BY start2, end2, h.hit_idx) - end2) AS g2 FROM block_hits b JOIN hits h ON h.hit_idx = b.hit_idx),
fb AS (SELECT block_idx, min(proj1_idx) AS proj1_idx, min(proj2_idx) AS proj2_idx, min(grp1_idx) AS grp1_idx, min(grp2_idx) AS grp2_idx, min(start1) AS start1, max(end1) AS end1, min(start2) AS start2, max(end2) AS end2,
  count(*) AS score, CASE WHEN count(*) <= 2 OR min(x) = max(x) OR min(y) = max(y) THEN 0 ELSE corr(x, y) END AS corr, avg(g1) AS avg_gap1, avg(g2) AS avg_gap2, round(CAST(sum(pctid) AS DOUBLE) / count(*), 1) AS avg_pctid FROM bh GROUP BY block_idx),
fin AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp1_idx, grp2_idx ORDER BY start1, end1, block_idx) AS INT) AS blocknum FROM fb)"""


def _finished(v: Views) -> DataFrame:
    return bl.finish_blocks(v.hits, v.block_hits)


@query(
    "b10_finish_blocks",
    _FINISHED + """ SELECT block_idx, blocknum, start1, end1, start2, end2, score, round(corr, 6) AS corr, round(avg_gap1, 6) AS avg_gap1, round(avg_gap2, 6) AS avg_gap2, avg_pctid FROM fin""",
)
def _(v: Views) -> DataFrame:
    f = _finished(v)
    return f.select("block_idx", "blocknum", "start1", "end1", "start2", "end2", "score", *[F.round(c, 6).alias(c) for c in ("corr", "avg_gap1", "avg_gap2")], "avg_pctid")


@query(
    "r9_blocks_plus",
    _FINISHED + """ SELECT block_idx, a.name AS chr1, b.name AS chr2, blocknum, score, round(corr, 6) AS corr, round(avg_gap1, 6) AS gap1, round(avg_gap2, 6) AS gap2, end1 - start1 + 1 AS len1, end2 - start2 + 1 AS len2, start1, start2
FROM fin JOIN groups a ON a.grp_idx = grp1_idx JOIN groups b ON b.grp_idx = grp2_idx""",
)
def _(v: Views) -> DataFrame:
    r = rp.blocks_plus(_finished(v), v.groups)
    return r.withColumns({c: F.round(c, 6) for c in ("corr", "gap1", "gap2")})


_BLOCK_GENES = """, bg AS (SELECT block_idx, 1 AS side, annot_idx FROM blocks JOIN genes ON grp_idx = grp1_idx AND greatest(start1, g_start) < least(end1, g_end)
UNION ALL SELECT block_idx, 2, annot_idx FROM blocks JOIN genes ON grp_idx = grp2_idx AND greatest(start2, g_start) < least(end2, g_end)),
held AS (SELECT DISTINCT block_idx, side, annot_idx, 1 AS hit FROM block_hits JOIN hit_annot USING (hit_idx)),
sides AS (SELECT block_idx, side, count(*) AS n_genes, CAST(count(hit) AS DOUBLE) / count(*) AS share FROM bg LEFT JOIN held USING (block_idx, side, annot_idx) GROUP BY ALL)"""


def _block_genes(v: Views) -> tuple[DataFrame, DataFrame]:
    """Blocks, which are read several times, and their genes."""
    block_hits = written(v.block_hits, "block-hits")
    blocks = written(v.spark.sql(VIEWS["blocks"].replace("{div}", "div"), block_hits=block_hits, hits=v.hits), "blocks")
    return blocks, bl.block_genes(blocks, v.genes, block_hits, v.hit_annot)


@query("b11_block_genes", _BLOCK_GENES + " SELECT block_idx, side, n_genes, round(share, 6) AS share FROM sides")
def _(v: Views) -> DataFrame:
    return _block_genes(v)[1].withColumn("share", F.round("share", 6))


@query(
    "r10_blocks_genes",
    _BLOCK_GENES + """ SELECT k.block_idx, a.name AS chr1, b.name AS chr2, blocknum, start1, end1, start2, end2, coalesce(x.n_genes, 0) AS genes1, round(coalesce(x.share, 0), 6) AS share1, coalesce(y.n_genes, 0) AS genes2, round(coalesce(y.share, 0), 6) AS share2
FROM blocks k JOIN groups a ON a.grp_idx = grp1_idx JOIN groups b ON b.grp_idx = grp2_idx LEFT JOIN sides x ON x.block_idx = k.block_idx AND x.side = 1 LEFT JOIN sides y ON y.block_idx = k.block_idx AND y.side = 2""",
)
def _(v: Views) -> DataFrame:
    r = rp.blocks_genes(*_block_genes(v), v.groups)
    return r.withColumns({c: F.round(c, 6) for c in ("share1", "share2")})


# --- block search ---


def _cutoffs(v: Views) -> DataFrame:
    """A row per project pair; read several times."""
    return written(bl.synteny_cutoffs(v.hits_one, v.groups), "cutoffs")


def _with_sets(v: Views) -> DataFrame:
    keys = ["grp1_idx", "grp2_idx", "same", "rank1", "rank2"]
    ranked = _ranked(v)
    numbered = co.renumber_sets(co.diagonal_sets(ranked), _KEYS).select(*keys, "runnum")
    return v.hits_one.join(ranked.join(numbered, keys).select("hit_idx", "runnum"), "hit_idx", "left").fillna(0, ["runnum"])


_CUTS = """, gl AS (SELECT proj_idx, sum(length) AS length FROM groups GROUP BY 1), pn AS (SELECT proj1_idx, proj2_idx, count(*) AS n_hits FROM hits_one GROUP BY 1, 2),
cuts AS (SELECT p.*, CAST(floor(a.length / sqrt(n_hits)) AS BIGINT) AS gap1, CAST(floor(b.length / sqrt(n_hits)) AS BIGINT) AS gap2 FROM pn p JOIN gl a ON a.proj_idx = proj1_idx JOIN gl b ON b.proj_idx = proj2_idx)"""


@query(
    "b1_synteny_cutoffs",
    _CUTS + """, k AS (SELECT unnest(range(1, 41)) AS k), st AS (SELECT c.*, k, gap1 >> k AS g1, gap2 >> k AS g2 FROM cuts c, k),
kept AS (SELECT *, count(*) OVER (PARTITION BY proj1_idx, proj2_idx) AS n FROM (SELECT * FROM st s WHERE k = 1 OR EXISTS (SELECT 1 FROM st t WHERE t.proj1_idx = s.proj1_idx AND t.proj2_idx = s.proj2_idx AND t.k = s.k - 1 AND t.g1 >= 2000 AND t.g2 >= 2000)))
SELECT proj1_idx, proj2_idx, n_hits, gap1, gap2, string_agg(g1 || ':' || g2, ' ' ORDER BY k) AS gaps FROM kept WHERE k > 1 OR n <= 2 GROUP BY 1, 2, 3, 4, 5""",
)
def _(v: Views) -> DataFrame:
    return bl.synteny_cutoffs(v.hits_one, v.groups).withColumn("gaps", F.array_join(F.transform("gaps", lambda g: F.concat_ws(":", g["g1"].cast("string"), g["g2"].cast("string"))), " "))


#: Hits in order along side 2, with their pieces and the hits before them within reach; then scores, a hit at a time.
_CHAIN = _CUTS + """, b AS MATERIALIZED (SELECT hit_idx, grp1_idx, grp2_idx, CASE WHEN strand IN ('+/+', '-/-') THEN 1 ELSE 2 END AS part, (start1 + end1) // 2 AS x, (start2 + end2) // 2 AS y, gap1, gap2,
    CASE WHEN (gap1 >> 1) >= 2000 AND (gap2 >> 1) >= 2000 AND (gap1 >> 2) >= 2000 AND (gap2 >> 2) >= 2000 THEN 2 ELSE 1 END AS k FROM hits_one JOIN cuts USING (proj1_idx, proj2_idx)),
pt AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY grp1_idx, grp2_idx, part, piece) AS c, row_number() OVER (PARTITION BY grp1_idx, grp2_idx, part, piece ORDER BY y, x, hit_idx) AS i FROM (
  SELECT *, sum(new) OVER (PARTITION BY grp1_idx, grp2_idx, part ORDER BY y, x, hit_idx) AS piece FROM (
    SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY grp1_idx, grp2_idx, part ORDER BY y, x, hit_idx) <= gap2 THEN 0 ELSE 1 END AS new FROM b))),
pr AS MATERIALIZED (SELECT p.c, p.i, list({'j': q.i, 'lost': CAST(floor(abs(p.x - q.x) / CAST(p.gap1 >> p.k AS DOUBLE) + (p.y - q.y) / CAST(p.gap2 >> p.k AS DOUBLE)) AS BIGINT)}) AS near
  FROM pt p JOIN pt q ON q.c = p.c AND q.i < p.i AND p.y - q.y <= p.gap2 AND abs(p.x - q.x) <= p.gap1 GROUP BY p.c, p.i)
SELECT hit_idx, grp1_idx, grp2_idx, part, CAST(piece AS BIGINT) AS piece, CAST(1 AS BIGINT) AS chain FROM pt JOIN (
  WITH RECURSIVE st(c, i, score, size, back) AS (
    SELECT c, i, [CAST(1 AS BIGINT)], [CAST(1 AS BIGINT)], [CAST(0 AS BIGINT)] FROM pt WHERE i = 1
    UNION ALL SELECT c, i, list_append(score, CASE WHEN best.v > 0 THEN best.v ELSE 1 END), list_append(size, CASE WHEN best.v > 0 THEN size[best.j] + 1 ELSE 1 END), list_append(back, CASE WHEN best.v > 0 THEN best.j ELSE 0 END)
      FROM (SELECT st.c, pt.i, score, size, back, list_max(list_transform(near, lambda p: {'v': 1 + score[p.j] - p.lost, 'j': p.j})) AS best FROM st JOIN pt ON pt.c = st.c AND pt.i = st.i + 1 LEFT JOIN pr ON pr.c = pt.c AND pr.i = pt.i) z),
  whole AS MATERIALIZED (SELECT st.* FROM st JOIN (SELECT c, count(*) AS i FROM pt GROUP BY c) n USING (c, i)),
  top AS (SELECT c, arg_max(e, {'s': score[e], 'n': size[e], 'e': -e}) AS e FROM (SELECT *, unnest(range(1, i + 1)) AS e FROM whole) u WHERE back[e] > 0 GROUP BY c),
  way(c, e) AS (SELECT top.c, top.e FROM top JOIN whole USING (c) WHERE size[top.e] >= 3 UNION ALL SELECT way.c, back[way.e] FROM way JOIN whole ON whole.c = way.c WHERE back[way.e] > 0)
  SELECT c, e AS i FROM way) w USING (c, i)"""


@query("b2_chain_hits", _CHAIN)
def _(v: Views) -> DataFrame:
    return bl.chain_hits(bl.search_pieces(v.hits_one, _cutoffs(v)))


@query(
    "b3_accept_blocks",
    _CUTS + """, bx AS (SELECT block_idx, min(proj1_idx) AS proj1_idx, min(proj2_idx) AS proj2_idx, min(grp1_idx) AS g1, min(grp2_idx) AS g2, count(*) AS n, min((start1 + end1) // 2) AS lx, max((start1 + end1) // 2) AS hx, min((start2 + end2) // 2) AS ly, max((start2 + end2) // 2) AS hy,
  CASE WHEN count(*) <= 2 OR lx = hx OR ly = hy THEN 0 ELSE corr((start1 + end1) // 2, (start2 + end2) // 2) END AS r1 FROM block_hits JOIN hits USING (hit_idx) GROUP BY 1),
ib AS (SELECT block_idx, CASE WHEN count(*) <= 2 OR min((start1 + end1) // 2) = max((start1 + end1) // 2) OR min((start2 + end2) // 2) = max((start2 + end2) // 2) THEN 0 ELSE corr((start1 + end1) // 2, (start2 + end2) // 2) END AS r2
  FROM bx JOIN hits ON grp1_idx = g1 AND grp2_idx = g2 AND (start1 + end1) // 2 BETWEEN lx AND hx AND (start2 + end2) // 2 BETWEEN ly AND hy GROUP BY 1),
j AS (SELECT block_idx, n, r1, r2, abs(r1) AS a, abs(r2) AS b, (hx - lx) // n AS space1, (hy - ly) // n AS space2, gap1, gap2 FROM bx JOIN ib USING (block_idx) JOIN cuts USING (proj1_idx, proj2_idx))
SELECT block_idx, n, round(r1, 6) AS r1, round(r2, 6) AS r2, space1, space2, CASE WHEN n >= 7 AND a >= 0.8 AND b >= 0.7 AND space1 <= gap1 / 15 AND space2 <= gap2 / 15 THEN 'A' WHEN n >= 7 AND a >= 0.98 AND b >= 0.9 THEN 'B' WHEN n >= 10 AND a >= 0.96 AND b >= 0.8 THEN 'C' WHEN n >= 14 AND a >= 0.94 AND b >= 0.7 THEN 'D' ELSE '' END AS "case" FROM j""",
)
def _(v: Views) -> DataFrame:
    rows = bl.accept_blocks(v.hits, v.block_hits, _cutoffs(v), strict=False)
    return rows.withColumns({c: F.round(c, 6) for c in ("r1", "r2")})


@query("b4_gap_search")
def _(v: Views) -> DataFrame:
    return bl.gap_search(bl.search_pieces(v.hits_one, _cutoffs(v)))


@query("b5_synteny_blocks")
def _(v: Views) -> DataFrame:
    return bl.synteny_blocks(v.hits_one, _cutoffs(v))


@query("b6_collinear_blocks")
def _(v: Views) -> DataFrame:
    return bl.synteny_blocks(_with_sets(v), _cutoffs(v), prune=False)


@query("b6_small_blocks")
def _(v: Views) -> DataFrame:
    return bl.small_blocks(written(bl.chain_and_set_hits(_with_sets(v), _cutoffs(v)), "block-hits"))


@query("b8_merge_blocks")
def _(v: Views) -> DataFrame:
    return bl.synteny_blocks(_with_sets(v), _cutoffs(v), merge=2)


@query(
    "b7_drop_diagonal_blocks",
    """, sb AS (SELECT block_idx, grp1_idx % 10 AS g1, grp2_idx % 10 AS g2, start1, end1, start2, end2 FROM blocks), t AS (SELECT block_idx, count(*) FILTER (gene_overlap = 2) AS two, count(*) FILTER (gene_overlap <> 2) AS rest FROM block_hits JOIN hits USING (hit_idx) GROUP BY 1),
s AS (SELECT *, greatest(0, least(end1, end2) - greatest(start1, start2) + 1) / CAST(end2 - start2 + 1 AS DOUBLE) AS share FROM sb JOIN t USING (block_idx))
SELECT block_idx FROM s WHERE NOT (g1 = g2 AND (share >= 0.8 OR (share >= 0.4 AND NOT two > 2 * rest)))""",
)
def _(v: Views) -> DataFrame:
    own = v.blocks.withColumn("grp1_idx", F.col("grp1_idx") % 10).withColumn("grp2_idx", F.col("grp2_idx") % 10)
    return bl.drop_diagonal_blocks(own, v.hits, v.block_hits).select("block_idx")


@query("b9_strict_prune", " SELECT block_idx, score FROM blocks WHERE score >= 30")
def _(v: Views) -> DataFrame:
    return bl.strict_prune(v.blocks, 30).select("block_idx", "score")


@query(
    "b12_mirror_blocks",
    _FINISHED + """ SELECT block_idx, grp1_idx, grp2_idx, start1, end1, start2, end2, round(avg_gap1, 6) AS avg_gap1, false AS mirror FROM fin UNION ALL SELECT block_idx, grp2_idx, grp1_idx, start2, end2, start1, end1, 0, true FROM fin""",
)
def _(v: Views) -> DataFrame:
    return bl.mirror_blocks(_finished(v)).select("block_idx", "grp1_idx", "grp2_idx", "start1", "end1", "start2", "end2", F.round("avg_gap1", 6).alias("avg_gap1"), "mirror")


_ORDER = _FINISHED + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp1_idx ORDER BY score DESC, block_idx DESC) AS r FROM fin) WHERE r = 1),
ord AS (SELECT g.grp_idx, b.grp2_idx AS chr, b.start2 AS at, b.score, coalesce(corr < 0, false) AS flip FROM groups g LEFT JOIN best b ON b.grp1_idx = g.grp_idx),
placed AS (SELECT *, CAST(row_number() OVER (ORDER BY chr NULLS LAST, at NULLS FIRST, score DESC NULLS LAST, grp_idx) AS INT) AS place FROM ord)"""


@query("b13_order_contigs", _ORDER.replace(" AS at", " AS pos").replace(", at NULLS", ", pos NULLS") + " SELECT grp_idx, chr, pos, flip, place FROM placed")
def _(v: Views) -> DataFrame:
    return bl.order_contigs(_finished(v), v.groups).select("grp_idx", "chr", F.col("at").alias("pos"), "flip", "place")


@query(
    "b14_ordered_sequence",
    _ORDER.replace(" AS at", " AS pos").replace(", at NULLS", ", pos NULLS") + """, sq AS (SELECT grp_idx, arg_max(seq, (length(seq), -seq_idx)) AS seq FROM (SELECT CAST(10 * (seq_idx % 3 + 1) + (seq_idx // 3) % 4 + 1 AS INT) AS grp_idx, seq_idx, seq FROM seqs) GROUP BY 1)
SELECT chr, grp_idx, place, CAST(coalesce(sum(length(seq) + 100) OVER (PARTITION BY chr ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS offset_,
  CASE WHEN flip THEN reverse(translate(seq, 'acgtACGTn', 'tgcaTGCAN')) ELSE seq END AS piece FROM placed JOIN sq USING (grp_idx) WHERE chr IS NOT NULL""",
)
def _(v: Views) -> DataFrame:
    # the longest document of each contig
    rows = v.seqs.select(F.expr("int(10 * (seq_idx % 3 + 1) + (seq_idx div 3) % 4 + 1)").alias("grp_idx"), "seq_idx", "seq")
    seqs = rows.groupBy("grp_idx").agg(F.max_by("seq", F.struct(F.length("seq"), -F.col("seq_idx"))).alias("seq"))
    return bl.build_ordered_sequence(bl.order_contigs(_finished(v), v.groups), seqs).withColumnRenamed("offset", "offset_")


# --- summaries and views ---


@query(
    "p1_genome_summary",
    """, g AS (SELECT proj_idx, count(*) AS sequences, CAST(sum(length) AS BIGINT) AS bases FROM groups GROUP BY 1), a AS (SELECT proj_idx, count(*) AS genes, sum(g_end - g_start + 1) AS gb, avg(g_end - g_start + 1) AS ag, max(g_end - g_start + 1) AS mg FROM genes GROUP BY 1),
e AS (SELECT proj_idx, count(*) AS exons, sum(e_end - e_start + 1) AS eb, avg(e_end - e_start + 1) AS ae, max(e_end - e_start + 1) AS me FROM exons GROUP BY 1)
SELECT proj_idx, sequences, bases, genes, round(100.0 * gb / bases, 6) AS gene_cover, round(ag, 6) AS avg_gene, mg AS max_gene, exons, round(100.0 * eb / bases, 6) AS exon_cover, round(ae, 6) AS avg_exon, me AS max_exon FROM g JOIN a USING (proj_idx) JOIN e USING (proj_idx)""",
)
def _(v: Views) -> DataFrame:
    return su.genome_summary(v.groups, v.genes, v.exons).withColumns({c: F.round(c, 6) for c in ("gene_cover", "avg_gene", "exon_cover", "avg_exon")})


@query(
    "p2_cluster_summary",
    """ SELECT proj1_idx, proj2_idx, count(*) AS hits, count(*) FILTER (strand IN ('+/-', '-/+')) AS opposite, count(block_idx) AS in_blocks, count(*) FILTER (gene_overlap = 2) AS two, count(*) FILTER (gene_overlap = 1) AS one,
  count(*) FILTER (gene_overlap = 0) AS none, CAST(sum(countpct) AS BIGINT) AS subhits, round(avg(countpct), 6) AS avg_subhits FROM hits LEFT JOIN block_hits USING (hit_idx) GROUP BY 1, 2""",
)
def _(v: Views) -> DataFrame:
    return su.cluster_summary(v.hits, v.block_hits).withColumn("avg_subhits", F.round("avg_subhits", 6))


@query("p2_genes_with_hits", " SELECT proj_idx, count(*) AS genes, count(h.annot_idx) AS with_hits, round(100.0 * count(h.annot_idx) / count(*), 6) AS share FROM genes g LEFT JOIN (SELECT DISTINCT annot_idx FROM hit_annot) h ON h.annot_idx = g.annot_idx GROUP BY 1")
def _(v: Views) -> DataFrame:
    return su.genes_with_hits(v.genes, v.hit_annot).withColumn("share", F.round("share", 6))


def _cover(last: int, source: str) -> str:
    return f"""SELECT g, sum(CASE WHEN depth >= 1 THEN size ELSE 0 END) AS c1, sum(CASE WHEN depth >= 2 THEN size ELSE 0 END) AS c2 FROM (
  SELECT g, count(*) FILTER (step = 1) OVER w - count(*) FILTER (step = -1) OVER w AS depth, lead(at_, 1, at_) OVER (PARTITION BY g ORDER BY at_, step, id) - at_ AS size FROM (
    SELECT grp1_idx AS g, start1 AS at_, 1 AS step, {source}_idx AS id FROM {"hits" if source == "hit" else "blocks"} UNION ALL SELECT grp1_idx, end1 + {1 - last}, -1, {source}_idx FROM {"hits" if source == "hit" else "blocks"}
    UNION ALL SELECT grp2_idx, start2, 1, {source}_idx FROM {"hits" if source == "hit" else "blocks"} UNION ALL SELECT grp2_idx, end2 + {1 - last}, -1, {source}_idx FROM {"hits" if source == "hit" else "blocks"}) e
  WINDOW w AS (PARTITION BY g ORDER BY at_, step, id ROWS UNBOUNDED PRECEDING)) z GROUP BY g"""


@query(
    "p3_coverage",
    f""", hc AS ({_cover(0, "hit")}), bc AS ({_cover(1, "block")})
SELECT hc.g AS grp_idx, CAST(hc.c1 AS BIGINT) AS hit_cover, CAST(coalesce(bc.c1, 0) AS BIGINT) AS block_cover1, CAST(coalesce(bc.c2, 0) AS BIGINT) AS block_cover2 FROM hc LEFT JOIN bc ON bc.g = hc.g""",
)
def _(v: Views) -> DataFrame:
    return su.pair_coverage(v.hits, v.blocks)


@query("p4_subhit_lengths", """, s AS (SELECT CASE WHEN hit_idx % 5 = 0 THEN [end1 - start1 + 1] ELSE [score // 2 + 1, end1 - start1 - score // 2 - hit_idx % 3] END AS l FROM hits), u AS (SELECT unnest(l) AS l FROM s)
SELECT CASE WHEN l < 60 THEN '<60' WHEN l < 80 THEN '<80' WHEN l < 120 THEN '<120' ELSE '>=120' END AS bucket, count(*) AS n FROM u GROUP BY 1""")
def _(v: Views) -> DataFrame:
    rows = _subhits(v).select(F.explode_outer("subs").alias("s")).select((F.col("s.end") - F.col("s.start") + 1).alias("l"))
    return su.length_histogram(rows, "l", [60, 80, 120])


@query("p5_block_pair_summary", _FINISHED + " SELECT proj1_idx, proj2_idx, count(*) AS blocks, CAST(sum(CASE WHEN corr < 0 THEN 1 ELSE 0 END) AS BIGINT) AS inverted, CAST(sum(score) AS BIGINT) AS hits, CAST(sum(end1 - start1 + 1) AS BIGINT) AS bases1 FROM fin GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return su.block_pair_summary(_finished(v))


@query("p5_block_lengths", " SELECT CASE WHEN end1 - start1 + 1 < 20000 THEN '<20000' WHEN end1 - start1 + 1 < 24000 THEN '<24000' ELSE '>=24000' END AS bucket, count(*) AS n FROM blocks GROUP BY 1")
def _(v: Views) -> DataFrame:
    return su.length_histogram(v.blocks.select((F.col("end1") - F.col("start1") + 1).alias("l")), "l", [20_000, 24_000])


@query(
    "v1_dotplot_points",
    """ SELECT hit_idx, (start1 + end1) // 2 AS x, (start2 + end2) // 2 AS y, pctid, gene_overlap, block_idx IS NOT NULL AS in_block, CASE WHEN strand IN ('+/+', '-/-') THEN end1 - start1 + 1 ELSE start1 - end1 - 1 END AS size FROM hits LEFT JOIN block_hits USING (hit_idx)""",
)
def _(v: Views) -> DataFrame:
    return su.dotplot_points(v.hits, v.block_hits).drop("grp1_idx", "grp2_idx")


@query("v2_dotplot_stats", " SELECT block_idx IS NOT NULL AS in_block, gene_overlap, count(*) AS n FROM hits LEFT JOIN block_hits USING (hit_idx) WHERE pctid >= 60 GROUP BY CUBE (block_idx IS NOT NULL, gene_overlap)")
def _(v: Views) -> DataFrame:
    return su.dotplot_stats(su.dotplot_points(v.hits, v.block_hits), 60)


@query("v3_linked_groups", " SELECT DISTINCT grp1_idx, grp2_idx FROM blocks")
def _(v: Views) -> DataFrame:
    return su.linked_groups(v.blocks)


@query(
    "v4_filter_hit_map",
    _SIZED + """, m AS (SELECT h.hit_idx, pctid, gene_overlap, block_idx IS NOT NULL AS b, coalesce(runsize, 0) > 0 AS s FROM hits h LEFT JOIN block_hits k ON k.hit_idx = h.hit_idx LEFT JOIN sized z ON z.hit_idx = h.hit_idx)
SELECT hit_idx, 'or' AS mode FROM m WHERE pctid >= 60 AND (b OR s OR gene_overlap = 0) UNION ALL SELECT hit_idx, 'and' FROM m WHERE pctid >= 60 AND b AND s UNION ALL SELECT hit_idx, 'all' FROM m WHERE pctid >= 60""",
)
def _(v: Views) -> DataFrame:
    rows = v.hits.join(v.block_hits, "hit_idx", "left").join(_sized(v), "hit_idx", "left")
    asks = {"or": {"block": True, "sets": True, "genes": (0,)}, "and": {"block": True, "sets": True, "both_needed": True}, "all": {}}
    part = [su.filter_hit_map(rows, pctid=60, **a).select("hit_idx", F.lit(m).alias("mode")) for m, a in asks.items()]
    return part[0].union(part[1]).union(part[2])


def _three_way_sql(both: bool) -> str:
    ok = "fl AND fr" if both else "fl <> fr"
    done = lambda k: f"(({ok}) AND f{k} OR ({'NOT sl AND sr AND il' if k == 'l' else 'NOT sr AND sl AND ir'} IS NOT NULL))"
    part = lambda k, o: f"""SELECT '{'both' if both else 'one'}' AS mode, '{k.upper()}' AS side, hit_idx, annot_idx, CASE WHEN genes = 2 AND visible AND ({ok}) THEN 'shared' WHEN genes = 2 AND NOT visible AND NOT s{k} AND s{o} AND hit_idx = i{k} THEN 'completes'
  WHEN genes = 1 AND visible AND f{o} AND NOT {done(k)} THEN 'may_complete' END AS mark FROM tw JOIN ws USING (annot_idx) WHERE side = '{k.upper()}' AND (sl OR sr)"""  # noqa: E731
    return f"SELECT * FROM ({part('l', 'r')} UNION ALL {part('r', 'l')}) WHERE mark IS NOT NULL"


@query(
    "v5_conserved_three_way",
    """, tw AS (SELECT 'L' AS side, hit_idx, annot2_idx AS annot_idx, CASE WHEN annot1_idx IS NULL THEN 1 ELSE 2 END AS genes, pctid >= 75 AS visible FROM hits WHERE proj1_idx = 1 AND proj2_idx = 2 AND annot2_idx IS NOT NULL
UNION ALL SELECT 'R', hit_idx, annot1_idx, CASE WHEN annot2_idx IS NULL THEN 1 ELSE 2 END, pctid >= 75 FROM hits WHERE proj1_idx = 2 AND proj2_idx = 3 AND annot1_idx IS NOT NULL),
wa AS (SELECT annot_idx, coalesce(bool_or(side = 'L' AND visible) FILTER (genes = 2), false) AS sl, coalesce(bool_or(side = 'R' AND visible) FILTER (genes = 2), false) AS sr,
  min(hit_idx) FILTER (side = 'L' AND genes = 2 AND NOT visible) AS il, min(hit_idx) FILTER (side = 'R' AND genes = 2 AND NOT visible) AS ir FROM tw GROUP BY 1),
ws AS (SELECT *, sl OR (sr AND il IS NOT NULL) AS fl, sr OR (sl AND ir IS NOT NULL) AS fr FROM wa) """ + _three_way_sql(True) + " UNION ALL " + _three_way_sql(False),
)
def _(v: Views) -> DataFrame:
    seen = F.col("pctid") >= 75
    side = lambda p, q, ref, other: v.hits.filter((F.col("proj1_idx") == p) & (F.col("proj2_idx") == q) & F.col(ref).isNotNull()).select("hit_idx", F.col(ref).alias("annot_idx"), F.when(F.col(other).isNull(), 1).otherwise(2).alias("genes"), seen.alias("visible"))
    left, right = side(1, 2, "annot2_idx", "annot1_idx"), side(2, 3, "annot1_idx", "annot2_idx")
    rows = [su.conserved_three_way(left, right, both).select(F.lit("both" if both else "one").alias("mode"), "side", "hit_idx", "annot_idx", "mark") for both in (True, False)]
    return rows[0].union(rows[1])


@query("v6_circle_blocks", " SELECT block_idx, grp1_idx, grp2_idx, start1, end2 FROM blocks UNION ALL SELECT block_idx, grp2_idx, grp1_idx, start2, end1 FROM blocks")
def _(v: Views) -> DataFrame:
    return su.circle_blocks(v.blocks).select("block_idx", "grp1_idx", "grp2_idx", "start1", "end2")


_TABLE = """, st AS (SELECT hit_idx, 1 AS n, start1 AS s, CASE WHEN hit_idx % 5 = 0 THEN end1 ELSE start1 + score // 2 END AS e FROM hits
UNION ALL SELECT hit_idx, 2, start1 + score // 2 + 1 + hit_idx % 3, end1 FROM hits WHERE hit_idx % 5 <> 0),
sub AS (SELECT hit_idx, CAST(n AS INT) AS n, CAST(s AS INT) AS s, e, e - s + 1 AS length, CAST(s - lag(e) OVER (PARTITION BY hit_idx ORDER BY n) - 1 AS INT) AS gap FROM st)"""


@query("v7_subhit_table", _TABLE + " SELECT hit_idx, n, CAST(length AS INT) AS length, gap, false AS disorder FROM sub")
def _(v: Views) -> DataFrame:
    return su.subhit_table(_subhits(v)).select("hit_idx", "n", "length", "gap", "disorder")


@query("v8_drop_disordered_subhits", _TABLE + " SELECT hit_idx, n FROM sub WHERE n = 1")
def _(v: Views) -> DataFrame:
    return su.drop_disordered_subhits(su.subhit_table(_subhits(v)), opposite=True).select("hit_idx", "n")


@query("v9_exon_table", " SELECT gene_idx, e_start, e_end - e_start + 1 AS length, e_start - lag(e_end) OVER (PARTITION BY gene_idx ORDER BY e_start) - 1 AS intron FROM exons")
def _(v: Views) -> DataFrame:
    return su.exon_table(v.exons).select("gene_idx", "e_start", "length", "intron")


@query("p3_gene_coverage", """, s AS (SELECT grp_idx, g_start AS s, g_end AS e FROM genes), n AS (SELECT *, max(e) OVER (PARTITION BY grp_idx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT grp_idx, CAST(sum(greatest(0, e - greatest(s - 1, coalesce(m, 0)))) AS BIGINT) AS cover1 FROM n GROUP BY 1""")
def _(v: Views) -> DataFrame:
    return coverage(v.genes, ["grp_idx"], "g_start", "g_end").select("grp_idx", "cover1")
