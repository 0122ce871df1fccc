"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.llm.embed_dedup import clean_vectors
from genoloom.operators.lineage import written


class SmallWorld:
    """Hierarchical navigable small-world graph over one shard, nearness by inner product.

    ``links[k]`` is a flat int32 array, one row of neighbour numbers per vector of layer k, -1 where empty.
    Every vector is in layer 0; each higher layer holds about one in ``width`` of the layer below. Vectors are
    inserted in doubling batches, and both inserts and searches run for a batch of queries at once.
    """

    def __init__(self, points: np.ndarray, width: int = 16, effort: int = 96, seed: int = 7) -> None:
        self.points = np.ascontiguousarray(points, np.float32)
        n = len(points)
        draw = np.random.default_rng(seed)
        height = np.minimum((-np.log(1 - draw.random(n)) / math.log(width)).astype(int), 6)
        self.order = np.argsort(-height, kind="stable")  # the highest first, so layers nest in insertion order
        self.points = self.points[self.order]
        height = height[self.order]
        self.sizes = [int((height >= k).sum()) for k in range(height[0] + 1)] if n else [0]
        self.links = [np.full((s, width * (2 if k == 0 else 1)), -1, np.int32) for k, s in enumerate(self.sizes)]
        done = 0
        while done < n:
            step = min(n - done, max(1, min(done, 512)))
            self._insert(np.arange(done, done + step), done, effort)
            done += step

    def _insert(self, new: np.ndarray, done: int, effort: int) -> None:
        q = self.points[new]
        entry = np.zeros((len(new), 1), np.int64)
        for k in reversed(range(len(self.sizes))):
            inside = new < self.sizes[k]
            if done:
                near, sims = self._beam(q, entry, k, effort if inside.any() or k == 0 else 8, min(done, self.sizes[k]))
                entry = near[:, : max(1, 4)]
            else:
                near, sims = np.full((len(new), 1), -1, np.int64), np.full((len(new), 1), -np.inf, np.float32)
            if not inside.any():
                continue
            who = new[inside]
            own = self.points[who] @ self.points[who].T  # the batch's own members are candidates of each other
            np.fill_diagonal(own, -np.inf)
            top = min(len(who), 32)
            best = np.argsort(-own, axis=1)[:, :top]
            cand = np.concatenate([near[inside], who[best]], axis=1)
            sim = np.concatenate([sims[inside], np.take_along_axis(own, best, 1)], axis=1)
            self._connect(who, cand, sim, k)

    def _choose(self, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Per row up to ``most`` of the candidates, nearest first, preferring those that are nearer to the row
        than to any chosen one; places that are left go to the nearest of the others."""
        order = np.argsort(-sim, axis=1, kind="stable")[:, : most * 4]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        out = np.full((len(cand), most), -1, np.int32)
        for lo in range(0, len(cand), 256):
            c, s = cand[lo : lo + 256], sim[lo : lo + 256]
            valid = (c >= 0) & np.isfinite(s)
            v = self.points[np.maximum(c, 0)]
            among = v @ v.transpose(0, 2, 1)
            taken = np.zeros(c.shape, bool)
            closest = np.full(c.shape, -np.inf, np.float32)
            for j in range(c.shape[1]):
                pick = valid[:, j] & (closest[:, j] < s[:, j]) & (taken.sum(1) < most)
                taken[:, j] = pick
                closest = np.where(pick[:, None], np.maximum(closest, among[:, :, j]), closest)
            rank = np.where(taken, 0, np.where(valid, 1, 2)) * c.shape[1] + np.arange(c.shape[1])
            first = np.argsort(rank, axis=1)[:, :most]
            ok = np.take_along_axis(valid, first, 1)
            out[lo : lo + 256, : first.shape[1]] = np.where(ok, np.take_along_axis(c, first, 1), -1)
        return out

    def _connect(self, who: np.ndarray, cand: np.ndarray, sim: np.ndarray, k: int) -> None:
        links = self.links[k]
        width = links.shape[1]
        chosen = self._choose(cand, sim, max(1, width // 2))
        links[who, : chosen.shape[1]] = chosen
        src = np.repeat(who, chosen.shape[1])
        dst = chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        heads, first, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, count)
        incoming = np.full((len(heads), int(count.max())), -1, np.int64)
        incoming[np.repeat(np.arange(len(heads)), count), place] = src
        pool = np.concatenate([links[heads].astype(np.int64), incoming], axis=1)
        for lo in range(0, len(heads), 512):
            p, h = pool[lo : lo + 512], heads[lo : lo + 512]
            p = np.sort(p, axis=1)
            p[:, 1:][p[:, 1:] == p[:, :-1]] = -1
            s = np.einsum("qmd,qd->qm", self.points[np.maximum(p, 0)], self.points[h])
            links[h] = self._choose(p, np.where(p >= 0, s, -np.inf), width)

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search in layer k from ``entry``, the four best unexpanded nodes of each query at a time."""
        count = len(q)
        seen = np.zeros((count, n), bool)
        row = np.arange(count)[:, None]
        start = np.where((entry >= 0) & (entry < n), entry, 0)
        sims = np.einsum("qmd,qd->qm", self.points[start], q)
        start_sorted = np.sort(start, axis=1)
        again = np.zeros(start.shape, bool)
        again[:, 1:] = start_sorted[:, 1:] == start_sorted[:, :-1]
        start = start_sorted
        sims = np.einsum("qmd,qd->qm", self.points[start], q)
        sims = np.where(again, -np.inf, sims).astype(np.float32)
        ids = np.full((count, width), -1, np.int64)
        val = np.full((count, width), -np.inf, np.float32)
        m = min(width, start.shape[1])
        order = np.argsort(-sims, axis=1)[:, :m]
        ids[:, :m], val[:, :m] = np.take_along_axis(start, order, 1), np.take_along_axis(sims, order, 1)
        seen[row, start] = True
        open_ = np.isfinite(val)
        act = np.arange(count)
        while len(act):
            o = open_[act]
            rank = np.cumsum(o, axis=1)
            pick = o & (rank <= 4)
            open_[act] &= ~pick
            cur = np.full((len(act), 4), -1, np.int64)
            r, c = np.nonzero(pick)
            cur[r, rank[r, c] - 1] = ids[act[r], c]
            nb = np.where(cur[:, :, None] >= 0, self.links[k][np.maximum(cur, 0)], -1).reshape(len(act), -1)
            nb = np.where(nb < n, nb, -1)
            nb = np.sort(nb, axis=1)
            fresh = nb >= 0
            fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            fresh &= ~seen[act[:, None], np.maximum(nb, 0)]
            a, b = np.nonzero(fresh)
            seen[act[a], nb[a, b]] = True
            sims = np.full(nb.shape, -np.inf, np.float32)
            sims[a, b] = np.einsum("pd,pd->p", self.points[nb[a, b]], q[act[a]])
            all_val = np.concatenate([val[act], sims], axis=1)
            all_ids = np.concatenate([ids[act], nb], axis=1)
            all_open = np.concatenate([open_[act], fresh], axis=1)
            top = np.argsort(-all_val, axis=1, kind="stable")[:, :width]
            val[act], ids[act] = np.take_along_axis(all_val, top, 1), np.take_along_axis(all_ids, top, 1)
            open_[act] = np.take_along_axis(all_open, top, 1) & np.isfinite(val[act])
            act = act[open_[act].any(1)]
        return np.where(np.isfinite(val), ids, -1), val

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Numbers of up to ``width`` near vectors for each row of q, -1 where there are fewer."""
        q = np.ascontiguousarray(q, np.float32)
        entry = np.zeros((len(q), 1), np.int64)
        for k in reversed(range(1, len(self.sizes))):
            entry = self._beam(q, entry, k, 8, self.sizes[k])[0]
        found = self._beam(q, entry, 0, width, self.sizes[0])[0]
        return np.where(found >= 0, self.order[np.maximum(found, 0)], -1)


#: Bytes of one shard's vectors, as its graph holds them, and of one block of queries.
SHARD_BYTES, BLOCK_BYTES = 48_000_000, 16_000_000


def nearest(
    queries: DataFrame,
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    shards: int = 8,
    shard_rows: int = 25_000,
    beam: int = 240,
) -> DataFrame:
    """The ``k`` rows of ``rows`` of largest inner product found for each row of ``queries``, never itself:
    query_id, rank (from 1), vec_id, score (inner product of the vectors as given, in double precision), ties
    to the smaller id; fewer than ``k`` if there are fewer candidates.

    Vectors that are null, zero or hold null or non-finite components take no part, nor rows with a null id.
    Repeated ids count once, by their smallest vector; queries are only compared with vectors of their own
    length. An empty table gives an empty result; extra columns are ignored.

    Equal vectors are one node of the graph that carries its k + 1 smallest ids (no other copy can be among a
    query's k nearest). Distinct vectors are dealt to shards by hash, at least ``shards``, of at most about
    ``shard_rows`` rows and SHARD_BYTES each; inner products become distances of vectors lengthened by one
    component to one common norm. All queries visit all shards, in blocks of BLOCK_BYTES: a task holds one shard's
    graph, once for all blocks of queries that it gets, and one block at a time. The shards' best are merged.
    """
    spark = rows.sparkSession
    own = F.struct("vec")

    def distinct_ids(df: DataFrame) -> DataFrame:
        good = clean_vectors(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "id", "vec")
        return good.select("id", F.col("__vec").alias("vec")).groupBy("id").agg(F.min(own).alias("s")).select("id", F.col("s.vec").alias("vec"))

    good = written(distinct_ids(rows).withColumn("h", F.xxhash64("vec")), "vectors")
    first = Window.partitionBy("h", "vec").orderBy("id")
    held = good.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    nodes = held.groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = written(nodes.withColumn("dim", F.size("vec")), "nodes")
    norm2 = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    facts = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("top"))
    many = f"greatest({shards}, ceil(n / {shard_rows}), ceil(n * dim * 12 / {SHARD_BYTES}))"
    placed = nodes.join(facts, "dim").withColumn("shard", F.expr(f"pmod(h, {many})"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(pdf["vec"].tolist(), np.float64)
        extra = np.sqrt(np.maximum(0.0, pdf["top"].iloc[0] - (vectors**2).sum(1)))
        scale = 1 / math.sqrt(pdf["top"].iloc[0])
        graph = SmallWorld(np.concatenate([vectors, extra[:, None]], axis=1) * scale)
        made = {"graph": graph, "vectors": vectors, "ids": [np.asarray(x, np.int64) for x in pdf["ids"]]}
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "index": [pickle.dumps(made, 5)]})

    # a stated number of partitions: a shard is small in bytes but long in work, so shards are not put together
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dim", "shard")
    index = written(placed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, index binary"), "graphs")
    asked = distinct_ids(queries).withColumn("dim", F.size("vec"))
    blocks_of = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("q")).select("dim", F.expr(f"ceil(q * dim * 8 / {BLOCK_BYTES})").alias("parts"))
    dealt = asked.join(blocks_of, "dim").withColumn("part", F.expr("pmod(xxhash64(id), parts)"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"dim": pdf["dim"].iloc[:1], "part": pdf["part"].iloc[:1], "block": [pickle.dumps((pdf["id"].to_numpy(), np.array(pdf["vec"].tolist(), np.float64)), 5)]}
        )

    blocks = written(dealt.groupBy("dim", "part").applyInPandas(pack, "dim int, part long, block binary"), "query-blocks")
    # a shard meets its blocks in runs of four: its graph comes first in each run, then the blocks one by one
    runs = blocks.groupBy("dim").agg(F.max("part").alias("last")).withColumn("run", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / 4))))
    graphs = index.join(runs, "dim").select("dim", "shard", "run", F.lit(-1).cast("long").alias("part"), F.col("index").alias("data"))
    visits = index.select("dim", "shard").join(blocks, "dim").select("dim", "shard", F.floor(F.col("part") / 4).alias("run"), "part", F.col("block").alias("data"))
    met = graphs.union(visits).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dim", "shard", "run").sortWithinPartitions("dim", "shard", "run", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in batches:
            for part, data in zip(batch.column(3), batch.column(4), strict=True):
                if part.as_py() < 0:
                    made = pickle.loads(data.as_py())
                    continue
                ids, vectors = pickle.loads(data.as_py())
                for lo in range(0, len(ids), 256):
                    yield from answers(made, ids[lo : lo + 256], vectors[lo : lo + 256])

    def answers(made: dict, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = made["graph"].search(np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1), beam)
        who, near_ids, near_scores = [], [], []
        for qid, q, near in zip(ids, vectors, found, strict=True):
            near = near[near >= 0]
            scores = made["vectors"][near] @ q
            # the k + 1 best and all that equal the last of them: its ties are settled by id
            cut = np.flatnonzero(scores >= np.partition(scores, -min(k + 1, len(scores)))[-min(k + 1, len(scores))]) if len(scores) else []
            c = np.concatenate([np.zeros(0, np.int64), *(made["ids"][i] for i in near[cut])])
            s = np.repeat(scores[cut], [len(made["ids"][i]) for i in near[cut]])
            s, c = s[c != qid], c[c != qid]
            best = np.lexsort((c, -s))[:k]
            who.append(np.full(len(best), qid, np.int64))
            near_ids.append(c[best])
            near_scores.append(s[best])
        if who:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (who, near_ids, near_scores)], names=["query_id", "vec_id", "score"])

    near = met.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
