"""N-gram Jaccard join by chosen paths: documents split recursively on sampled shared shingles."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.embed_dedup import forest
from genoloom.operators.graph import connected_components
from genoloom.operators.lineage import written
from genoloom.operators.pieces import in_slices

WORD = re.compile(r"\w+")
#: Words that a task remembers at most.
CACHE = 200_000
#: Columns of one slab of the brute-force product.
SLAB = 4096
#: Elements from which on a set draws without putting back.
FEW = 64
#: Bytes of sets in one piece of a merged group, and of the text of a set by which recall is measured.
PIECE_BYTES, PROBE_BYTES = 16_000_000, 20_000


class Shingler:
    """Sets of 64-bit hashes of runs of ``width`` words (lower case, letters, digits and underscores)."""

    def __init__(self, width: int) -> None:
        class Known(dict):
            def __missing__(self, word: str) -> int:
                h = xxhash.xxh3_64_intdigest(word)
                if len(self) >= CACHE:
                    self.clear()
                self[word] = h
                return h

        self.known, self.width = Known(), width

    def __call__(self, text: str | None) -> np.ndarray:
        """Ascending; empty without words; a text of fewer words than ``width`` is one shingle."""
        words = WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        span = min(self.width, len(h))
        out = np.full(len(h) - span + 1, span, np.uint64)
        for k in range(span):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def sampled(shingles: np.ndarray, first: int, runs: int, depth: int, least: float) -> list[np.ndarray]:
    """Sampled elements of a set for runs ``first`` to ``first + runs``, ``depth`` each, as one or two tables of runs.

    A set of under ``FEW`` / ``least`` elements draws each from a hash function of its own (the element of least hash), so two
    sets share a drawn element with a chance of their similarity. One of ``FEW`` or more draws the elements of its
    ``depth`` least hashes under one function a run, which for so many elements comes to nearly the same chance. Sets
    of sizes between draw both ways, so two sets of similarity ``least`` or more always have one way in common.
    """
    out = []
    for kind, count in ((0, runs * depth), (1, runs)):
        if (len(shingles) > FEW / least) if kind == 0 else (len(shingles) < FEW):
            continue
        draw = np.random.default_rng([3 + kind, first]).integers(1, 2**63, (2, count, 1), dtype=np.uint64)
        best = np.full((count, depth if kind else 1), 2**64 - 1, np.uint64)
        for lo in range(0, len(shingles), 8192):
            x = (shingles[None, lo : lo + 8192] ^ draw[0]) * (draw[1] | np.uint64(1))
            x ^= x >> np.uint64(32)
            if kind:
                x = np.concatenate([best, x], axis=1)
                best = np.sort(np.partition(x, depth - 1, axis=1)[:, :depth], axis=1)
            else:
                best = np.minimum(best, x.min(1, keepdims=True))
        out.append(best.reshape(runs, depth))
    return out


def path_hashes(tables: list[np.ndarray], first: int, least: int) -> list[int]:
    """Of each run of :func:`sampled`, a hash for each of its paths of ``least`` elements to all, as signed numbers."""
    out = []
    for chosen in tables:
        runs, depth = chosen.shape
        # every run of either way has hash functions of its own, so that paths only meet their like
        acc = np.arange(first, first + runs, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        steps = np.empty((runs, depth - least + 1), np.uint64)
        for d in range(depth):
            acc = (acc ^ chosen[:, d]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
            if d + 1 >= least:
                steps[:, d + 1 - least] = acc
        out += steps.view(np.int64).ravel().tolist()
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers; (0, 0) for none."""
    key = xxhash.xxh3_128_intdigest(shingles.tobytes()) if len(shingles) else 2**127 + 2**63
    return (key >> 64) - 2**63, (key & (2**64 - 1)) - 2**63


def runs_for(target: float, least: float, depth: int) -> int:
    """Runs after which a pair of similarity ``least`` has shared a path of ``depth`` elements with this chance."""
    return math.ceil(math.log(1 - target) / math.log(1 - least**depth))


def brute_force(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> np.ndarray:
    """Matrix of pairs of sets whose Jaccard similarity is at least ``least``; of ``left`` with itself (without
    the diagonal) if ``right`` is None. Intersections are counted by products over the shared elements only."""
    both = left if right is None else left + right
    sizes = np.array([len(x) for x in both])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.where(seen > 1, np.cumsum(seen > 1) - 1, -1)[code]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n = len(left)
    rows, cols = (sizes, sizes) if right is None else (sizes[:n], sizes[n:])
    inter = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        a, b = np.searchsorted(column, (lo, lo + SLAB))
        part = np.zeros((len(both), min(SLAB, int(column[-1]) + 1 - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        inter += part[: len(rows)] @ (part if right is None else part[n:]).T
    inter = inter.astype(np.float64)
    found = inter / np.maximum(rows[:, None] + cols[None, :] - inter, 1) >= least
    if right is None:
        np.fill_diagonal(found, False)
    return found


def linked(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8,
    target: float = 0.998, depth: tuple[int, int] = (3, 6), small: int = 64, chunk: int = 2048, probes: int = 200, most_rounds: int = 4,
) -> DataFrame:
    """One row per row of ``df`` whose id is not null: id, mark (hash of its text), class_id, n_links and component
    (id, h1, h2), the smallest id and set reachable; see :func:`jaccard_join`. The last three are null for a text
    without words. A class is a set, named by its smallest id and its hash, as an id may stand for several sets.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark")).filter("id is not null")
    runs = runs_for(target, least, depth[1])

    # a fixed number of sets, whose neighbours are found by comparing them with every document, tell the recall
    own_shingles = Shingler(width)
    # (the least hash of each of as many parts of all rows, so tasks send no more than that many numbers on)
    numbered = rows.filter(F.octet_length("text") < PROBE_BYTES).withColumn("h", F.xxhash64("id", "text"))
    picked = numbered.groupBy(F.pmod("h", F.lit(probes)).alias("part")).agg(F.min("h").alias("h")).select("h")
    asked = numbered.join(F.broadcast(picked), "h").dropDuplicates(["h"]).select("text").collect()
    probed = [x for x in {set_key(y): y for y in (own_shingles(r["text"]) for r in asked)}.items() if len(x[1])]
    probe_sizes = np.array([len(x) for _, x in probed], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in probed)])
    order = np.argsort(flat, kind="stable")
    probe_hash, probe_of = flat[order], np.repeat(np.arange(len(probed)), probe_sizes)[order]

    def neighbours(own: np.ndarray) -> list[int]:
        """The probes of similarity ``least`` or more to a set."""
        lo, hi = np.searchsorted(probe_hash, own, "left"), np.searchsorted(probe_hash, own, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        shared = np.bincount(np.concatenate([probe_of[a:b] for a, b in zip(lo[hit], hi[hit], strict=True)]), minlength=len(probe_sizes))
        return np.flatnonzero(shared >= least * (len(own) + probe_sizes - shared)).tolist()

    def signs(first: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Sets and their paths of the round of runs that begins at run ``first``; of each run, one hash per depth."""

        def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shingles = Shingler(width)
            for pdf in in_slices(batches):
                keys, sizes, near, paths = [], [], [], []
                for text in pdf["text"]:
                    own = shingles(text)
                    keys.append(set_key(own))
                    sizes.append(len(own))
                    near.append(neighbours(own) if len(own) and not first else [])
                    paths.append(path_hashes(sampled(own, first, runs, depth[1], least), first, depth[0]) if len(own) else [])
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "mark": pdf["mark"].to_numpy(), "h1": [k[0] for k in keys], "h2": [k[1] for k in keys], "size": sizes, "near": near, "paths": paths})

        return sign

    def edges_of(classes: DataFrame) -> DataFrame:
        """(rep, to) of the buckets of one round. A path's bucket is split by the path's next element while it holds
        more than ``small`` sets and elements are left."""
        steps = depth[1] - depth[0] + 1
        open_ = classes.select("rep", F.explode(F.expr(f"transform(sequence(0, size(paths) div {steps} - 1), r -> slice(paths, int(r) * {steps} + 1, {steps}))")).alias("path"))
        found = None
        for d in range(steps):
            step = open_.select("rep", "path", F.element_at("path", d + 1).alias("bucket"))
            # both tables of buckets are written, so that their join meets plain tables and a large bucket may be split
            size = written(step.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("to")).filter("n > 1"), "bucket-sizes")
            inside = step.join(size, "bucket")
            if d + 1 < steps:
                inside = written(inside.select("rep", "to", "n", F.when(F.col("n") > small, F.col("path")).alias("path")), "buckets")
                open_ = inside.filter(F.col("n") > small).select("rep", "path")
                inside = inside.filter(F.col("n") <= small)
            edges = inside.filter("rep <> to").select("rep", "to")
            found = edges if found is None else found.union(edges)
        return written(found.distinct(), "edges")

    kinds = "id long, mark long, h1 long, h2 long, size long, near array<int>, paths array<long>"
    signed = written(rows.mapInPandas(signs(0), kinds), "signed")
    sets_of = lambda table: table.filter("size > 0").groupBy("h1", "h2")
    classes = written(
        sets_of(signed).agg(F.min(F.struct("id", "size", "paths")).alias("m"), F.count(F.lit(1)).alias("copies"))
        .select(F.struct("m.id", "h1", "h2").alias("rep"), "copies", "m.size", "m.paths"),
        "classes",
    )
    probe_rows = df.sparkSession.createDataFrame([(k, h1, h2) for k, ((h1, h2), _) in enumerate(probed)], "probe int, p1 long, p2 long")
    true_pairs = signed.select(F.explode("near").alias("probe"), "h1", "h2").distinct().join(F.broadcast(probe_rows), "probe").filter("h1 <> p1 or h2 <> p2").select("h1", "h2", "p1", "p2")
    edges = edges_of(classes)
    for number in range(1, most_rounds + 1):
        groups = written(connected_components(edges, "rep", "to"), "groups")
        place = groups.select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), "component")
        met = true_pairs.join(place, ["h1", "h2"], "left").join(place.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("component").alias("other")), ["p1", "p2"], "left")
        pairs, caught = met.agg(F.count(F.lit(1)), F.count(F.when(F.col("component") == F.col("other"), 1))).first()
        if caught >= target * pairs:
            break
        if number == most_rounds:
            raise RuntimeError(f"after {number} rounds {caught} of {pairs} true pairs are joined, under the target of {target}")
        again = rows.mapInPandas(signs(number * runs), kinds)
        more = sets_of(again).agg(F.min(F.struct("id", "paths")).alias("m")).select(F.struct("m.id", "h1", "h2").alias("rep"), "m.paths")
        edges = written(edges.union(edges_of(written(more, "classes"))).distinct(), "edges")

    # sets of similarity ``least`` differ in size by one class at most, so only neighbouring classes of a group meet
    ratio = math.log(1 / (least - 1e-6))
    placed = groups.join(classes.select(F.col("rep").alias("node"), "copies", "size"), "node").withColumn("class", F.floor(F.log("size") / ratio).cast("int"))
    sizes = placed.groupBy("component", "class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("size") * 8 / PIECE_BYTES)).cast("int").alias("pieces"))
    maps = sizes.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("class", "pieces"))).alias("pieces"))
    group = [F.col(f"component.{x}").alias(f"of_{x}") for x in ("id", "h1", "h2")]
    code = F.col("class").cast("long") * 2**32 + F.pmod(F.xxhash64("node"), F.element_at("pieces", F.col("class")))
    members = placed.join(maps, "component").select("node.id", "node.h1", "node.h2", *group, "pieces", "copies", "class", code.alias("piece"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(width)
        for pdf in in_slices(batches):
            sets = [shingles(t) for t in pdf["text"]]
            # a repeated id may have other texts: only the class's own set goes on
            own = np.array([set_key(s) == (a, b) for s, a, b in zip(sets, pdf["h1"], pdf["h2"], strict=True)], bool)
            out = pdf.drop(columns=["text"]).assign(set=[s.tobytes() for s in sets])[own]
            yield out.drop_duplicates(["id", "h1", "h2"])

    of = ["of_id", "of_h1", "of_h2"]
    held = members.join(rows, "id").select("id", "h1", "h2", *of, "pieces", "copies", "class", "piece", "text")
    sets = held.mapInPandas(gather, "id long, h1 long, h2 long, of_id long, of_h1 long, of_h2 long, pieces map<int,int>, copies long, class int, piece long, set binary")
    others = F.expr("flatten(transform(sequence(class - 1, class + 1), c -> if(map_contains_key(pieces, c), transform(sequence(0, pieces[c] - 1), p -> bigint(c) * 4294967296 + p), array())))")
    dealt = sets.withColumn("other", F.explode(others)).select(
        *of, F.least("piece", "other").alias("a"), F.greatest("piece", "other").alias("b"), "piece", "id", "h1", "h2", "copies", "set"
    )
    dealt = dealt.repartition(*of, "a", "b").sortWithinPartitions(*of, "a", "b", "piece", "id", "h1", "h2")
    names = ["id", "h1", "h2", "to_id", "to_h1", "to_h2", "n", "edge"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held_rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held_rows) < 2:
                return
            a, b = key[3], key[4]
            seen, unique = set(), []
            for r in held_rows:  # a class comes once, though rows may repeat its id
                if r[1] not in seen:
                    seen.add(r[1])
                    unique.append(r)
            left = [r for r in unique if r[0] == a]
            right = [r for r in unique if r[0] == b] if a != b else None
            if not left or right == []:
                return
            found = brute_force([r[3] for r in left], None if right is None else [r[3] for r in right], least)
            nodes = sorted(seen)  # named by their place in the order of ids from here on
            place = {x: k for k, x in enumerate(nodes)}
            ids = np.array([place[r[1]] for r in left], np.int64)
            copies = np.array([r[2] for r in left], np.int64)
            ids2, copies2 = (ids, copies) if right is None else (np.array([place[r[1]] for r in right], np.int64), np.array([r[2] for r in right], np.int64))
            who, count = [ids], [found @ copies2]
            if right is not None:
                who.append(ids2)
                count.append(found.T @ copies)
            who, count = np.concatenate(who), np.concatenate(count)
            keep = count > 0
            links = forest(ids, ids2, found)
            src = np.concatenate([who[keep], np.array([x for x, _ in links], np.int64)])
            to = np.concatenate([who[keep], np.array([y for _, y in links], np.int64)])
            n = np.concatenate([count[keep], np.zeros(len(links), np.int64)])
            edge = np.arange(len(src)) >= keep.sum()
            if len(src):
                at = np.array(nodes, np.int64)
                ends = [pa.array(at[x, k], pa.int64()) for x in (src, to) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array(n, pa.int64()), pa.array(edge)], names=names)

        for batch in batches:
            piece, copies, sets_ = (batch.column(k) for k in (5, 9, 10))
            ids = list(zip(*(batch.column(k).to_pylist() for k in (6, 7, 8)), strict=True))
            for k, r in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if r != key:
                    yield from flush()
                    key, held_rows = r, []
                held_rows.append((piece[k].as_py(), ids[k], copies[k].as_py(), np.frombuffer(sets_[k].as_py(), np.uint64)))
        yield from flush()

    met = written(dealt.mapInArrow(meet, "id long, h1 long, h2 long, to_id long, to_h1 long, to_h2 long, n long, edge boolean"), "links")
    met = met.select(F.struct("id", "h1", "h2").alias("rep"), F.struct(F.col("to_id").alias("id"), F.col("to_h1").alias("h1"), F.col("to_h2").alias("h2")).alias("to"), "n", "edge")
    far = met.filter("not edge").groupBy("rep").agg(F.sum("n").alias("far"))
    parts = connected_components(met.filter("edge"), "rep", "to").withColumnRenamed("node", "rep")
    state = (
        classes.select("rep", "copies")
        .join(far, "rep", "left")
        .join(parts, "rep", "left")
        .select("rep.h1", "rep.h2", F.col("rep.id").alias("class_id"), F.expr("copies - 1 + coalesce(far, 0)").alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    named = signed.select("id", "mark", F.expr("if(size = 0, null, h1)").alias("h1"), "h2").join(state, ["h1", "h2"], "left")
    return named.select("id", "mark", "class_id", "n_links", "component")


def jaccard_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8,
    target: float = 0.998, depth: tuple[int, int] = (3, 6), small: int = 64, chunk: int = 2048,
) -> DataFrame:
    """Links documents whose sets of ``width``-word shingles have a Jaccard similarity of at least ``least``.

    One row per id: ``id_col``, class_id (smallest id of the same set), n_links (other documents linked
    directly, copies counted), component_id (smallest id reachable), kept (id = component_id). A text of 1 to
    ``width`` - 1 words is one shingle; null and empty texts link with nothing. Rows with a null id are left
    out; rows that repeat an id count as copies or neighbours of each other but share its one row. Extra
    columns are ignored; an empty table gives an empty result.

    Documents of equal sets collapse to one. In each run a document follows a path of sampled elements, from
    ``depth[0]`` on; the bucket of documents that chose the same path is split by their next elements, again and again
    while it holds more than ``small``, to ``depth[1]`` elements at most. A pair of similarity s shares a path of d
    elements with a chance of s ** d, so a round has as many runs as the longest paths need for the recall
    ``target`` at ``least``. The recall is then measured: 200 sets (a fixed number, those of the least hashes, under
    PROBE_BYTES of text) have been compared with every document, and rounds of new runs follow, four in all at
    most, while fewer than ``target`` of their true pairs have met. Buckets that share a document are merged and
    brute-forced once, so no pair is counted twice and every pair found is exact; within a merged group only
    sets of like size meet, in pieces of ``chunk`` sets and PIECE_BYTES at most. Tasks emit counts and a
    spanning forest, never the pairs.
    """
    return (
        linked(df, id_col, text_col, width, least, target, depth, small, chunk)
        .groupBy("id")
        .agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.min("component.id").alias("component_id"))
        .select(
            F.col("id").alias(id_col),
            F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(id_col) == F.col("component_id"))
    )
