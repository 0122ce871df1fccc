"""Ranked lexical search that scores each distinct bag of words once."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.lineage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term: letters and digits of ASCII, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on the bytes of UTF-8: those of a term, lower-cased, and blanks for all others.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Items are searched in blocks of at most so many items and, but for a single item, terms.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 50_000
#: Cells of a task's table of classes by terms, and bytes of a text that are split at once.
CELLS, PIECE = 1 << 22, 1 << 20
#: Sorts documents without an id behind all others.
NO_ID = 2**63 - 1


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, terms): the distinct terms of all rows of an id; a null id is one too."""
    words = F.explode(F.regexp_extract_all(F.translate(F.coalesce(text_col, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    rows = items.select(F.col(id_col).cast("long").alias("item"), words.alias("term")).distinct()
    return rows.groupBy("item").agg(F.collect_list("term").alias("terms"))


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items, block after block, in order of their ids; the driver holds one block."""
    held: list[tuple[int | None, list[str]]] = []
    terms = 0
    for r in items.orderBy("item").toLocalIterator():
        if held and (len(held) == BLOCK_ITEMS or terms + len(r["terms"]) > BLOCK_TERMS):
            yield held
            held, terms = [], 0
        held.append((r["item"], r["terms"]))
        terms += len(r["terms"])
    if held:
        yield held


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in pieces of some PIECE bytes that end between terms."""
    text = text.translate(_BYTES)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def bags(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """(id, n, bag) of (id, text): how many terms a text has, and of those in ``place`` the ascending numbers and their
    counts, as pairs of 32-bit integers (a text has fewer bytes than that)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for text in batch.column(1):
                seen: Counter[bytes] = Counter()
                terms = 0
                for words in _tokens(text.as_buffer().to_pybytes()):
                    terms += len(words)
                    part = Counter(words)
                    for w in part.keys() & place.keys():
                        seen[w] += part[w]
                n.append(terms)
                pairs = np.array(sorted((place[w], k) for w, k in seen.items()), "<u4")
                found.append(pairs.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["id", "n", "bag"])

    return docs.mapInArrow(scan, "id long, n long, bag binary")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, count) of all pairs in a column of bags."""
    raw = [b.as_buffer() for b in column]
    size = np.array([len(b) // 8 for b in raw])
    flat = np.frombuffer(b"".join(raw), "<u4").reshape(-1, 2)
    return np.repeat(np.arange(len(raw)), size), flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)


def _document_counts(classes: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; a task sends one row for each term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            row, number, _ = _pairs(batch.column(0))
            np.add.at(total, number, batch.column(1).to_numpy()[row])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    found = classes.select("bag", "members").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(terms, np.int64)
    for r in found.collect():
        out[r["term"]] = r["n"]
    return out


def _best_classes(classes: DataFrame, wanted: list[tuple[int | None, np.ndarray]], weight: np.ndarray, most: int) -> DataFrame:
    """(place, score, hash, m, bag, first): of each task, the ``most`` classes of every item (by its place in ``wanted``)
    that come first by descending score and ascending smallest id. Each class holds a document that comes
    before all documents of the classes after it, so the ``most`` best documents are in these."""
    columns = ["hash", "m", "bag", "first"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in wanted]
        rows = max(16, CELLS // max(1, len(weight)))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                row, number, tf = _pairs(batch.column(2))
                m, first = batch.column(1).to_numpy(), batch.column(3).to_numpy()
                table = np.zeros((len(weight), batch.num_rows), np.int64)
                table[number, row] = weight[number] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
                for k, (_item, terms) in enumerate(wanted):
                    total = table[terms].sum(0)
                    heap = best[k]
                    able = np.flatnonzero(total >= heap[0][0] if len(heap) == most else total > 0)
                    if len(able) > most:  # of this batch, those that may be among the best
                        able = able[np.lexsort((first[able], -total[able]))[:most]]
                    for j in able.tolist():
                        # the least is the worst: small score, then large id; hash and bag settle what is still equal
                        entry = (int(total[j]), -int(first[j]), batch.column(0)[j].as_py(), int(m[j]), batch.column(2)[j].as_py())
                        if len(heap) < most:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        for k, heap in enumerate(best):
            if heap:
                s, f, h, m, b = zip(*heap, strict=True)
                arrays = [pa.array([k] * len(heap), pa.int32()), *(pa.array(x, pa.int64()) for x in (s, h, m)), pa.array(b, pa.binary()), pa.array([-x for x in f], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["place", "score", *columns])

    return classes.select(*columns).mapInArrow(score, "place int, score long, hash long, m long, bag binary, first long")


def _search(docs: DataFrame, block: list[tuple[int | None, list[str]]], most: int) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, own in block for t in own})
    number = {t: k for k, t in enumerate(terms)}
    wanted = [(item, np.array(sorted(number[t] for t in own), np.int64)) for item, own in block]
    found = written(bags(docs, {t.encode(): k for t, k in number.items()}), "bags")
    size = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("total")).first()
    documents, total = size["documents"], size["total"] or 0
    # 50 * n * N passes 64 bits beyond some 10^16 of n * N; the decimal is as exact
    m = F.expr(f"cast(50 + (cast(50 as decimal(38,0)) * n * {documents}L) div {max(1, total)}L as long)")
    marked = found.filter(F.octet_length("bag") > 0).withColumn("m", m).withColumn("hash", F.xxhash64("bag", "m"))
    key = ["hash", "m", "bag"]
    first = F.coalesce("id", F.lit(NO_ID))
    classes = written(marked.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.min(first).alias("first")), "classes")
    df = _document_counts(classes, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    by_score = Window.partitionBy("place").orderBy(F.desc("score"), "first")
    top = _best_classes(classes, wanted, weight, most).withColumn("r", F.row_number().over(by_score)).filter(F.col("r") <= most)
    top = written(top.drop("r", "first"), "top")
    # at most items x most hashes of 8 bytes are sent to the tasks; equality of the bags themselves is checked after
    some = marked.join(F.broadcast(top.select("hash").distinct()), "hash", "left_semi")
    in_class = Window.partitionBy(*key).orderBy(first)
    members = some.withColumn("r", F.row_number().over(in_class)).filter(F.col("r") <= most).select(*key, "id")
    rows = top.join(members, key).withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), first)))
    ids = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(wanted)], "place int, item long")
    return rows.filter(F.col("rank") <= most).join(F.broadcast(ids), "place").select("item", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most: int = 50
) -> DataFrame:
    """The ``most`` highest-scoring documents of each item with a score above 0 (all, if fewer): ``item_col``, rank (int,
    from 1), ``id_col``, score (long). A document scores, for each distinct term of the item that it holds, the
    term's weight floor(1000 ln((2N + 2) / (2 df + 1))) times 10^9 tf div (1000 tf + 20 m), where m is 50 plus half its length
    against the mean in hundredths; equal scores go by ascending id.

    Items are searched in blocks. Texts are scanned whole for a block's vocabulary, which leaves each document its bag (term
    numbers and counts). Documents of one bag and m are one class: grouped by a 64-bit hash, with the bags themselves
    compared, partially in each task, so a hot class is one row. Each class is scored once against every item in
    integers; a task keeps the best ``most`` classes of each item, and only the classes that stay are expanded to their
    ``most`` first members, which a task again cuts before rows are exchanged. A task holds one block of items (1,024 items
    and 50,000 terms at most, but for a single longer item) and a table of 4 million cells.

    Null texts have no terms. A null document id stands after all others of its score; rows of one id are documents of
    their own. Rows of one item id (null is one) are one item; items without terms give no rows. Further columns are
    ignored; empty tables give an empty result. Ids are read as longs.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    found = None
    for block in blocks(item_terms(items, item_col, item_text_col)):
        part = _search(texts, block, most)
        found = part if found is None else written(found.union(part), "found")
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, rank int, id long, score long")
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


#: DuckDB SQL for the same rows over ``documents`` and ``benchmark``.
SEARCH_SQL = rf"""
WITH term AS (
  SELECT row_number() OVER () AS row, doc_id, t FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents) d
), size AS (
  SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t)) AS n_terms FROM term
), doc AS (
  SELECT row, doc_id, 50 + (50 * len(t) * n_docs) // greatest(1, n_terms) AS m FROM term, size
), want AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS w FROM benchmark
), held AS (
  SELECT row, w, count(*) AS tf FROM (SELECT row, unnest(t) AS w FROM term) x WHERE w IN (SELECT w FROM want) GROUP BY row, w
), weight AS (
  SELECT w, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS v FROM held, size GROUP BY w
), scored AS (
  SELECT item_id, row, sum(v * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS score
  FROM want JOIN held USING (w) JOIN weight USING (w) JOIN doc USING (row) GROUP BY item_id, row
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored JOIN doc USING (row) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50
"""
