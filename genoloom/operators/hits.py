"""Hits: canonical form, sub-hits, overlap with genes, numbers and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.functions.intervals import bin_join
from genoloom.operators.ordering import carried, deal

#: Columns that change places when a hit is seen from its other side.
SIDES = [("proj1_idx", "proj2_idx"), ("grp1_idx", "grp2_idx"), ("start1", "start2"), ("end1", "end2"), ("annot1_idx", "annot2_idx")]


def swap_sides(df: DataFrame, when: Column | None = None) -> DataFrame:
    """``df`` with the sides of the rows for which ``when`` holds (all, if None) exchanged, strand included."""
    on = F.lit(True) if when is None else when
    new = {c: F.col(c) for c in df.columns}
    for a, b in SIDES:
        if a in new and b in new:
            new[a], new[b] = F.when(on, F.col(b)).otherwise(F.col(a)), F.when(on, F.col(a)).otherwise(F.col(b))
    if "strand" in new:
        new["strand"] = F.when(on, F.concat_ws("/", F.split("strand", "/")[1], F.split("strand", "/")[0])).otherwise(F.col("strand"))
    return df.select(*[v.alias(c) for c, v in new.items()])


def canonical_self_hits(raw: DataFrame) -> DataFrame:
    """Hits of a genome with itself in the lower triangle: sides exchanged when grp1 < grp2, rows of one
    chromosome with start1 < start2 dropped, and so are exact diagonal hits."""
    swapped = swap_sides(raw, F.col("grp1_idx") < F.col("grp2_idx"))
    same = F.col("grp1_idx") == F.col("grp2_idx")
    diagonal = same & (F.col("start1") == F.col("start2")) & (F.col("end1") == F.col("end2"))
    return swapped.filter(~(same & (F.col("start1") < F.col("start2"))) & ~diagonal)


def mirror_self(hits: DataFrame, id_col: str = "hit_idx") -> DataFrame:
    """``hits`` and, for each, its mirror row with sides exchanged; ``refidx`` is 0 or the original's id."""
    first = hits.withColumn("refidx", F.lit(0).cast("long"))
    return first.unionByName(swap_sides(hits).withColumn("refidx", F.col(id_col).cast("long")))


def split_long_hits(raw: DataFrame, size: int = 50_000) -> DataFrame:
    """Hits longer than ``size`` cut into min(parts of side 1, parts of side 2) pieces; the last piece takes the
    rest, a rest under a tenth of ``size`` makes no piece, and on opposite strands side 2 runs backwards."""
    parts = lambda s, e: F.greatest(F.lit(1), F.floor((F.col(e) - F.col(s) + 1) / size) + F.when((F.col(e) - F.col(s) + 1) % size >= size / 10, 1).otherwise(0))
    rows = raw.withColumn("__n", F.least(parts("start1", "end1"), parts("start2", "end2")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    same = F.col("strand").isin("+/+", "-/-")
    k, last = F.col("part") - 1, F.col("part") == F.col("__n")
    return (
        rows.withColumn("s1", F.col("start1") + k * size)
        .withColumn("e1", F.when(last, F.col("end1")).otherwise(F.col("start1") + (k + 1) * size - 1))
        .withColumn("s2", F.when(same, F.col("start2") + k * size).otherwise(F.when(last, F.col("start2")).otherwise(F.col("end2") - (k + 1) * size + 1)))
        .withColumn("e2", F.when(same, F.when(last, F.col("end2")).otherwise(F.col("start2") + (k + 1) * size - 1)).otherwise(F.col("end2") - k * size))
        .select(*[c for c in raw.columns if c not in ("start1", "end1", "start2", "end2")], "part", F.col("s1").alias("start1"), F.col("e1").alias("end1"), F.col("s2").alias("start2"), F.col("e2").alias("end2"))
    )


def parse_subhits(text: Column, start: Column, end: Column) -> Column:
    """``s:e,s:e`` as an array of (start, end); an empty or null text is the hit's own interval."""
    own = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
    parts = F.transform(F.split(text, ","), lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("start"), F.split(p, ":")[1].cast("int").alias("end")))
    return F.when(text.isNull() | (F.trim(text) == ""), own).otherwise(parts)


def format_subhits(subs: Column) -> Column:
    return F.array_join(F.transform(subs, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def merge_subhits(subs: Column) -> Column:
    """Union of the intervals of an array, by start; intervals that touch or follow each other become one."""
    ordered = F.array_sort(subs, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (s["start"] <= F.get(done, F.size(done) - 1)["end"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.array_append(done, s))

    first = F.slice(ordered, 1, 1)
    return F.when(F.size(subs) <= 1, subs).otherwise(F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), first, add))


def hit_gene_overlaps(hits: DataFrame, genes: DataFrame, side: int, width: int = 10_000) -> DataFrame:
    """(hit_idx, annot_idx, overlap): every pair that shares bases on a side."""
    h = hits.select("hit_idx", F.col(f"grp{side}_idx").alias("grp_idx"), F.col(f"start{side}").alias("h_start"), F.col(f"end{side}").alias("h_end"))
    g = genes.select("annot_idx", "grp_idx", "g_start", "g_end")
    size = F.least("h_end", "g_end") - F.greatest("h_start", "g_start") + 1
    return bin_join(h, g, ["grp_idx"], "h_start", "h_end", "g_start", "g_end", width).select("hit_idx", "annot_idx", size.cast("int").alias("overlap"))


def number_hits(hits: DataFrame) -> DataFrame:
    """``hits`` with ``hitnum``: from 1 per chromosome pair by start1, longer first."""
    w = Window.partitionBy("grp1_idx", "grp2_idx").orderBy(F.asc("start1"), F.desc(F.col("end1") - F.col("start1")), F.asc("hit_idx"))
    return hits.withColumn("hitnum", F.row_number().over(w))


def gene_hit_counts(genes: DataFrame, hit_annot: DataFrame) -> DataFrame:
    """(annot_idx, numhits): hits of each gene, 0 if none."""
    n = hit_annot.groupBy("annot_idx").agg(F.countDistinct("hit_idx").alias("numhits"))
    return genes.select("annot_idx").join(n, "annot_idx", "left").fillna(0, ["numhits"])


def number_pseudo_genes(hits: DataFrame, numbered: DataFrame) -> DataFrame:
    """A pseudo gene for each side of a hit without a gene: (grp_idx, genenum, hit_idx, side, start, end, tag).

    Numbers go on from the next multiple of 100 above the chromosome's last gene number (from 1 if it has none),
    by start, side 1 before side 2.
    """
    sides = [
        hits.filter(F.col(f"annot{k}_idx").isNull()).select(F.col(f"grp{k}_idx").alias("grp_idx"), "hit_idx", F.lit(k).alias("side"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"))
        for k in (1, 2)
    ]
    top = numbered.groupBy("grp_idx").agg(F.max("genenum").alias("top"))
    base = F.when(F.col("top").isNull(), 0).otherwise((F.floor(F.col("top") / 100) + 1) * 100)
    key, order = ["grp_idx"], ["side", "start", "end", "hit_idx"]
    ranked = carried(deal(sides[0].union(sides[1]), key, order), key, order, rank=("sum", F.lit(1), "upto"))
    rows = ranked.join(top, "grp_idx", "left").withColumn("genenum", (base + F.col("rank")).cast("int"))
    return rows.select("grp_idx", "genenum", "hit_idx", "side", "start", "end", F.concat(F.col("genenum").cast("string"), F.lit(".~")).alias("tag"))
