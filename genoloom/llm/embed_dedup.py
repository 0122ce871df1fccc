"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.graph import connected_components
from genoloom.operators.lineage import written

#: Added to every pruning bound, so that rounding never prunes a pair at the threshold.
SLACK = 1e-7
#: Bits of the locality code that decides which vectors share a tree: enough for a million million vectors a label.
CODE_BITS = 32
#: Bytes of the vectors of one tree; bits of the code by which trees share a tile, and by which the upper tree widens.
TREE_BYTES, TILE_BITS, STEP_BITS = 4_000_000, 2, 4


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows whose vector is not null, not zero and has only finite components, as array<double>;
    negative zeros become zeros, so equal vectors have equal arrays."""
    vec = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    good = F.forall(
        F.col("__vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    ) & F.exists(F.col("__vec"), lambda x: x != 0.0)
    return df.withColumn("__vec", vec).filter(F.col(id_col).isNotNull() & F.col("__vec").isNotNull()).filter(good)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def build_tree(points: np.ndarray, stop: float) -> list[dict]:
    """Levels of a cover tree over unit vectors: centres nest, radii halve from level to level, every point
    lies within the level's radius of its centre, and each centre keeps the true radius that it covers.

    Returns per level the centres' row numbers, their covering radii and their parents' positions in the
    level above. The last level has every point as its own centre.
    """
    n = len(points)
    owner = np.full(n, int(np.argmax(points @ points.mean(axis=0))))
    radius, levels, above = 2.0, [], None

    def close(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.norm(points[rows] - a, axis=1)

    while True:
        centres = np.unique(owner)
        order = np.argsort(owner, kind="stable")
        parts = np.split(order, np.searchsorted(owner[order], centres)[1:])
        reach = np.array([close(points[c], p).max() for c, p in zip(centres, parts, strict=True)])
        levels.append(
            {"at": centres, "reach": reach, "up": np.zeros(1, int) if above is None else np.searchsorted(levels[-1]["at"], above[centres])}
        )
        if len(centres) == n:
            return levels
        radius /= 2
        above = owner
        if radius < stop:
            owner = np.arange(n)
            continue
        owner = owner.copy()
        for c, rest in zip(centres, parts, strict=True):
            far = close(points[c], rest) > radius
            rest = rest[far]
            while len(rest):  # the centres of a finer level are found inside the coarser centre's own points
                near = close(points[rest[0]], rest) <= radius
                owner[rest[near]] = rest[0]
                rest = rest[~near]


def dual_pairs(a: dict, b: dict, least_cos: float) -> np.ndarray:
    """Matrix of pairs (row of a, row of b) with cosine >= least_cos, by descending both trees together and
    dropping node pairs further apart than both covering radii and the threshold distance allow."""
    limit = np.sqrt(max(0.0, 2 - 2 * least_cos))
    alive = np.ones((1, 1), bool)
    for k in range(max(len(a["levels"]), len(b["levels"]))):
        la, lb = (t["levels"][min(k, len(t["levels"]) - 1)] for t in (a, b))
        ua, ub = ((x["up"] if k < len(t["levels"]) else np.arange(len(x["at"]))) if k else np.zeros(1, int) for t, x in ((a, la), (b, lb)))
        alive = alive[np.ix_(ua, ub)]
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            break
        if 16 * np.count_nonzero(alive) < len(rows) * len(cols):  # few node pairs are left: each by itself
            i, j = np.nonzero(alive)
            cos = np.einsum("pd,pd->p", a["points"][la["at"][i]], b["points"][lb["at"][j]])
            alive[i, j] = np.sqrt(np.maximum(0.0, 2 - 2 * cos)) <= la["reach"][i] + lb["reach"][j] + limit + SLACK
            continue
        cos = a["points"][la["at"][rows]] @ b["points"][lb["at"][cols]].T
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
        bound = la["reach"][rows][:, None] + lb["reach"][cols][None, :] + limit + SLACK
        alive[np.ix_(rows, cols)] &= apart <= bound
    found = np.zeros((len(a["points"]), len(b["points"])), bool)
    la, lb = a["levels"][-1]["at"], b["levels"][-1]["at"]
    if alive.shape == (len(la), len(lb)):
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if len(rows):
            cos = a["points"][la[rows]] @ b["points"][lb[cols]].T
            found[np.ix_(la[rows], lb[cols])] = alive[np.ix_(rows, cols)] & (cos >= least_cos)
    return found


def forest(left: np.ndarray, right: np.ndarray, found: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the ids that ``found`` links: each id to its tree's smallest."""
    rows, cols = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
    if not len(rows):
        return []
    linked = found[np.ix_(rows, cols)]
    a, b = left[rows].copy(), right[cols].copy()
    far = np.iinfo(np.int64).max
    shared = np.intersect1d(left[rows], right[cols], return_indices=True)[1:]  # ids that stand on both sides
    while True:
        low = np.minimum(a, np.where(linked, b[None, :], far).min(1))
        low2 = np.minimum(b, np.where(linked, low[:, None], far).min(0))
        low[shared[0]] = low2[shared[1]] = np.minimum(low[shared[0]], low2[shared[1]])
        if (low == a).all() and (low2 == b).all():
            break
        a, b = low, low2
    ids, tops = np.concatenate([left[rows], right[cols]]), np.concatenate([a, b])
    return [(int(x), int(y)) for x, y in dict(zip(ids.tolist(), tops.tolist(), strict=True)).items() if x != y]


def upper_pairs(roots: DataFrame, limit: float) -> DataFrame:
    """Pairs (tile1 <= tile2) of tiles of equal label and length that may hold vectors within ``limit`` of each other.

    ``roots``: the trees' label, dim, block, cell, tile, root and reach. The upper tree's nodes are prefixes of the
    cells, STEP_BITS longer from level to level, and tiles at its foot; a node's centre is the root of its first
    tree, and its reach covers all trees below. From the top down, only pairs of children of a pair that was not
    too far apart are looked at.
    """
    apart = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, d: t + d))
    own = ["label", "dim"]

    def nodes(name: Column, parent: Column) -> DataFrame:
        rows = roots.select(*own, name.alias("node"), parent.alias("up"), "block", "root", "reach")
        centres = rows.groupBy(*own, "node").agg(F.min_by("root", "block").alias("centre"))
        return rows.join(centres, [*own, "node"]).groupBy(*own, "node").agg(F.first("up").alias("up"), F.first("centre").alias("centre"), F.max(apart("centre", "root") + F.col("reach")).alias("wide"))

    # cells differ in their number of bits from label to label: the longest decides where the top is
    longest = roots.agg(F.max(F.length(F.conv(F.col("cell").cast("string"), 10, 2)))).first()[0] or 1
    shifts = list(range(TILE_BITS, TILE_BITS + longest + STEP_BITS, STEP_BITS))
    prefix = lambda shift: F.expr(f"shiftright(cell, {min(shift, 63)})")
    levels = [nodes(prefix(x), prefix(x + STEP_BITS)) for x in reversed(shifts)] + [nodes(F.col("tile"), prefix(shifts[0]))]
    pairs = None
    for level in levels:
        side = lambda k, level=level: level.select(*own, F.col("node").alias(f"n{k}"), F.col("up").alias(f"up{k}"), F.col("centre").alias(f"c{k}"), F.col("wide").alias(f"w{k}"))
        if pairs is None:
            met = side(1).join(side(2), own)
        else:
            above = pairs.select(*own, F.col("n1").alias("up1"), F.col("n2").alias("up2"))
            met = above.join(side(1), [*own, "up1"]).join(side(2), [*own, "up2"])
        # a pair of unlike parents has its children in either order
        met = met.filter((F.col("up1") != F.col("up2")) | (F.col("n1") <= F.col("n2"))) if pairs is not None else met.filter("n1 <= n2")
        pairs = written(met.filter(apart("c1", "c2") <= F.col("w1") + F.col("w2") + limit).select(*own, "n1", "n2"), "upper")
    return pairs.select(F.least("n1", "n2").alias("tile1"), F.greatest("n1", "n2").alias("tile2"))


def near_dup_embeddings(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    least_cos: float = 0.93,
    block_rows: int = 1024,
) -> DataFrame:
    """Links vectors of equal, non-null label whose cosine (double precision) is at least ``least_cos``.

    One row per id: ``id_col``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id
    reachable, itself included), ``kept`` (id = component_id). Vectors that are null, zero, or hold null or
    non-finite components, and rows without a label, link with nothing and stay. A repeated id counts once,
    by its smallest (label, vector); rows with a null id are left out. Vectors of different length never
    link. Extra columns are ignored; an empty table gives an empty result.

    Equal vectors collapse to one first. The others are dealt by a locality code into blocks of about
    ``block_rows`` (fewer, if those hold over TREE_BYTES); each block becomes a cover tree. Blocks of neighbouring
    codes form tiles of at most 16 trees, and tiles hang below an upper tree along the code's prefixes. The upper
    tree is traversed against itself on Spark, from the top, and node pairs further apart than their covering radii
    and the threshold allow are dropped with all that hangs below them, before any vector moves. For the pairs of
    tiles that are left, each tile's trees go to the pair's task once, and pairs of trees are traversed together.
    Tasks emit link counts and a spanning forest, never the pairs, so a large group of near copies makes
    no more rows than it has vectors.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    ids = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.*")
    good = clean_vectors(ids.filter("label is not null"), "id", "vec").select("id", "label", "__vec")
    good = written(good.withColumn("h1", F.xxhash64("label", "__vec")), "vectors")
    classes = good.groupBy("label", "__vec", "h1").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dim, part in pdf.groupby(pdf["__vec"].map(len), sort=False):
                units = unit_rows(np.array(part["__vec"].tolist(), dtype=np.float64))
                planes = np.random.default_rng(dim).standard_normal((dim, CODE_BITS))
                code = ((units @ planes) > 0) @ (np.int64(1) << np.arange(CODE_BITS)[::-1])
                out.append(part[["label", "h1", "rep", "copies"]].assign(dim=dim, code=code.astype(np.int64), unit=[u.tobytes() for u in units]))
            if out:
                yield pd.concat(out)[["label", "h1", "rep", "copies", "dim", "code", "unit"]]

    label_type = good.schema["label"].dataType.simpleString()
    coded = written(
        classes.mapInPandas(encode, f"label {label_type}, h1 long, rep long, copies long, dim int, code long, unit binary"), "units"
    )
    size = f"least({block_rows}, greatest(64, {TREE_BYTES} div (8 * dim)))"
    bits = coded.groupBy("label", "dim").count().select("label", "dim", F.expr(f"int(greatest(0, least({CODE_BITS}, ceil(log2(count / {size})))))").alias("bits"))
    placed = coded.join(bits, ["label", "dim"]).withColumn("cell", F.expr(f"shiftright(code, {CODE_BITS} - bits)"))
    pieces = placed.groupBy("label", "dim", "cell").count().select("label", "dim", "cell", F.expr(f"ceil(count / {size})").alias("pieces"))
    placed = placed.join(pieces, ["label", "dim", "cell"]).withColumn("piece", F.expr("pmod(xxhash64(rep), pieces)"))

    stop = float(np.sqrt(max(0.0, 2 - 2 * least_cos))) / 4

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        levels = build_tree(points, stop)
        root = levels[0]
        tree = {"points": points, "levels": levels, "ids": pdf["rep"].to_numpy(), "copies": pdf["copies"].to_numpy()}
        return pd.DataFrame(
            {"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "block": [int(pdf["rep"].min())],
             "cell": pdf["cell"].iloc[:1], "piece": pdf["piece"].iloc[:1], "root": [points[root["at"][0]].tolist()], "reach": [float(root["reach"][0])], "tree": [pickle.dumps(tree, 5)]}
        )

    trees = written(
        placed.groupBy("label", "dim", "cell", "piece").applyInPandas(
            plant, f"label {label_type}, dim int, block long, cell long, piece long, root array<double>, reach double, tree binary"
        ),
        "trees",
    )
    limit = float(np.sqrt(2 - 2 * least_cos)) + SLACK
    tile = Window.partitionBy("label", "dim", F.shiftright("cell", TILE_BITS), F.shiftright("piece", TILE_BITS))
    roots = trees.select("label", "dim", "block", "cell", "piece", "root", "reach").withColumn("tile", F.min("block").over(tile))
    roots = written(roots, "roots")
    pairs = upper_pairs(roots, limit)
    of_tile = trees.select("block", "tree").join(roots.select("block", "tile"), "block")
    # a pair's tiles come one after the other, tree by tree; a tile that meets itself comes once
    first = pairs.join(of_tile, F.col("tile1") == F.col("tile")).select("tile1", "tile2", F.lit(1).alias("side"), "block", "tree")
    second = pairs.filter("tile1 <> tile2").join(of_tile, F.col("tile2") == F.col("tile")).select("tile1", "tile2", F.lit(2).alias("side"), "block", "tree")
    loaded = first.union(second).repartition("tile1", "tile2").sortWithinPartitions("tile1", "tile2", "side", "block")

    def links_of(a: dict, b: dict, same: bool) -> Iterator[pa.RecordBatch]:
        root_a, root_b = (t["points"][t["levels"][0]["at"][0]] for t in (a, b))
        if not same and np.linalg.norm(root_a - root_b) > a["levels"][0]["reach"][0] + b["levels"][0]["reach"][0] + limit:
            return
        found = dual_pairs(a, b, least_cos)
        if same:
            np.fill_diagonal(found, False)
        ids, counts = [a["ids"]], [found @ b["copies"]]
        if not same:
            ids.append(b["ids"])
            counts.append(found.T @ a["copies"])
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        keep = counts > 0
        if not keep.any():
            return
        links = forest(a["ids"], b["ids"], found)
        cols = (
            np.concatenate([ids[keep], np.array([x for x, _ in links], np.int64)]), np.concatenate([np.full(keep.sum(), -1), np.array([y for _, y in links], np.int64)]),
            np.concatenate([counts[keep], np.zeros(len(links), np.int64)]), np.concatenate([np.zeros(keep.sum(), bool), np.ones(len(links), bool)]),
        )
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["id", "to", "n", "edge"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left = None, []
        for batch in batches:
            for k, at in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if at[:2] != key:
                    key, left = at[:2], []
                tree = pickle.loads(batch.column(4)[k].as_py())
                if at[2] == 1:
                    left.append(tree)
                    if key[0] == key[1]:
                        yield from links_of(tree, tree, True)
                        for other in left[:-1]:
                            yield from links_of(other, tree, False)
                else:
                    for other in left:
                        yield from links_of(other, tree, False)

    met = written(loaded.mapInArrow(meet, "id long, to long, n long, edge boolean"), "links")
    links = met.filter("not edge").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("far"))
    parts = connected_components(met.filter("edge"), "id", "to")
    state = (
        coded.select("label", "h1", "rep", "copies")
        .join(links, "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "h1", "rep", F.expr("copies - 1 + coalesce(far, 0)").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    # members find their class by label, hash and the vector itself; the class has one row, so a hot class splits
    keyed = classes.select("label", "h1", "__vec", "rep").join(state.drop("label", "h1"), "rep")
    member = good.join(keyed, ["label", "h1", "__vec"]).select("id", "n_links", "component_id")
    return (
        ids.select("id")
        .join(member, "id", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(id_col) == F.col("component_id"))
    )
