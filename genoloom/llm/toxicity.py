"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms are hashed into this many buckets.
BUCKETS = 1 << 22
#: Words and chunks that a task remembers at most.
CACHE = 150_000
#: Chi-square above which a term (p < 0.001) or one of some 500,000 pairs of terms tells the classes apart.
SIGNIFICANT, PAIR_SIGNIFICANT = 10.8, 40.0
WORD = re.compile(r"\w+")


def hashed_terms(chunk: str) -> set[int]:
    """Buckets of a chunk's words, and of the beginnings and ends by which related words are alike."""
    out = set()
    for w in WORD.findall(chunk):
        out.add(zlib.crc32(w.encode()) % BUCKETS)
        for k in (4, 5, 6):
            if len(w) > k:
                out.add(zlib.crc32(f"^{w[:k]}".encode()) % BUCKETS)
                out.add(zlib.crc32(f"{w[-k:]}$".encode()) % BUCKETS)
    return out


@dataclass
class FactorMachine:
    """bias + sum of weights + sum over pairs of present terms of the product of their factors, as a logit."""

    place: dict[int, int] = field(default_factory=dict)
    bias: float = -20.0
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factor: np.ndarray = field(default_factory=lambda: np.zeros((0, 8)))

    def score(self, terms: list[int]) -> float:
        v = self.factor[terms]
        s = v.sum(0)
        z = self.bias + self.weight[terms].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: np.ndarray, labels: np.ndarray, place: dict[int, int], weights: np.ndarray | None = None, factors: int = 8, rounds: int = 150, rate: float = 0.05, shrink: float = 1e-3) -> FactorMachine:
    """Full-batch Adam on the weighted log loss; ``rows`` is documents by terms, 0 or 1."""
    x = rows.astype(np.float32)
    y = labels.astype(np.float32)
    share = (np.ones(len(y)) if weights is None else weights).astype(np.float32)
    share /= share.sum()
    draw = np.random.default_rng(11)
    prior = np.clip(share @ y, 1e-6, 1 - 1e-6)
    part = [np.array([np.log(prior / (1 - prior))], np.float32), np.zeros(x.shape[1], np.float32), (0.02 * draw.standard_normal((x.shape[1], factors))).astype(np.float32)]
    m, s = [np.zeros_like(p) for p in part], [np.zeros_like(p) for p in part]
    for t in range(1, rounds + 1):
        b, w, v = part
        xv = x @ v
        z = b[0] + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        by_term = g @ x
        grads = [np.array([g.sum()], np.float32), by_term + shrink * w / 10, x.T @ (g[:, None] * xv) - v * by_term[:, None] + shrink * v]
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.999 * s[k] + 0.001 * d * d
            part[k] = part[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return FactorMachine(place, float(part[0][0]), part[1].astype(np.float64), part[2].astype(np.float64))


def telling_pairs(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Columns of the ``most`` pairs whose joint presence tells the classes apart best by chi-square, of pairs that do
    so beyond chance among all pairs (``PAIR_SIGNIFICANT``) and half as well again as either column alone."""
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    b, a = x[y == 1].T @ x[y == 1], x[y == 0].T @ x[y == 0]
    b, a = b.astype(np.float64), a.astype(np.float64)
    n = n0 + n1
    chi = n * (b * n0 - a * n1) ** 2 / ((a + b) * (n - a - b) * n0 * n1 + 1e-9)
    own = np.diag(chi)
    chi = np.triu(np.where((chi > PAIR_SIGNIFICANT) & (chi > 1.5 * np.maximum(own[:, None], own[None, :])), chi, 0), 1)
    order = np.argsort(-chi, axis=None, kind="stable")[:most]
    order = order[chi.ravel()[order] > 0]
    return np.unique(np.concatenate(np.unravel_index(order, chi.shape)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, terms_alone: int = 1024, terms_paired: int = 1024, pairs: int = 256, least_docs: int = 3) -> FactorMachine:
    """A machine learned from at most ``per_class`` labelled documents of each class (those of the smallest id
    hashes), each counted for as many labels of its class as it stands for, so the share of the classes that is
    learned is that of all labels whatever their number.

    Its inputs are hashed terms of two kinds: the ``terms_alone`` whose presence tells the classes apart best
    (chi-square, significant at 0.001), and the members of the ``pairs`` whose joint presence does so far better than
    either member's, of all pairs of the ``terms_paired`` terms found in most documents of label 1: words that are
    harmless alone and not so in company. What a term means, alone and with others, the machine then learns.

    Only ``docs``' text is an input. Labels other than 0 and 1 and ids without a document are ignored; without
    examples of both classes every score is 0. An id of several rows stands for one of its texts, a label that is
    repeated counts once, so what reaches the driver is bounded by the parameters.
    """
    order = [F.xxhash64("id"), F.col("id")]
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
    picked = known.filter("y = 0").orderBy(*order).limit(per_class).union(known.filter("y = 1").orderBy(*order).limit(per_class))
    # at most 2 * per_class rows of two numbers: a proven bound for the broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    # of several rows of one id, one text: the choice depends on the texts alone, and is made in each task first
    sample = sample.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))

    def terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [sorted(set().union(*map(hashed_terms, {*(t or "").lower().split()}))) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "terms": got})

    count = lambda df: {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    examples = sample.mapInPandas(terms_of, "y int, terms array<int>").persist()
    try:
        totals, every = count(examples), count(known)
        n0, n1 = totals.get(0, 0), totals.get(1, 0)
        if not n0 or not n1:
            return FactorMachine()
        seen = examples.select("y", F.explode("terms").alias("term")).groupBy("term").agg(
            F.sum("y").cast("double").alias("b"), F.sum(1 - F.col("y")).cast("double").alias("a")
        ).filter(F.col("a") + F.col("b") >= min(least_docs, n1))
        n = n0 + n1
        chi = F.expr(f"{n} * power(b * {n0} - a * {n1}, 2) / ((a + b) * ({n}D - a - b) * {n0}D * {n1}D + 1e-9)")
        best = seen.withColumn("chi", chi).filter(F.col("chi") > SIGNIFICANT).orderBy(F.desc("chi"), "term").limit(terms_alone).select("term", F.lit(True).alias("alone"))
        used = seen.filter("b > 0").orderBy(F.desc("b"), "term").limit(terms_paired).select("term", F.lit(False))
        found = best.union(used).collect()
        alone, paired = ([r["term"] for r in found if r["alone"] == k] for k in (True, False))
        terms = sorted({*alone, *paired})
        at = {t: k for k, t in enumerate(terms)}

        def marks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.zeros((len(pdf), len(terms)), bool)
                for k, own in enumerate(pdf["terms"]):
                    x[k, [at[t] for t in own.tolist() if t in at]] = True
                yield pd.DataFrame({"y": pdf["y"], "marks": [r.tobytes() for r in np.packbits(x, axis=1)]})

        # a bit for each term: 2 * per_class rows of 256 bytes at most. Rows of one label and the same terms count
        # alike, so their order does not matter
        kept = sorted(map(tuple, examples.mapInPandas(marks_of, "y int, marks binary").collect()))
    finally:
        examples.unpersist()
    y = np.array([r[0] for r in kept])
    packed = np.frombuffer(b"".join(bytes(r[1]) for r in kept), np.uint8).reshape(len(kept), -1)
    x = np.unpackbits(packed, axis=1, count=len(terms))
    columns = np.array([at[t] for t in paired], np.int64)
    inputs = sorted({*(at[t] for t in alone), *columns[telling_pairs(x[:, columns].astype(np.float32), y, pairs)].tolist()})
    if not inputs:
        return FactorMachine(bias=float(np.log(every[1] / every[0])))
    return train(x[:, inputs], y, {terms[k]: i for i, k in enumerate(inputs)}, np.where(y == 1, every[1] / n1, every[0] / n0))


def score(docs: DataFrame, machine: FactorMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the machine's score (0 to 1) of each whole text as ``score_col``; null and empty texts are
    scored as texts without terms, and texts of any length whole. One pass without a shuffle; repeated rows, null
    ids and other columns stay, a column named ``score_col`` is replaced; equal texts have equal scores."""
    place = machine.place

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        empty = machine.score([])
        for texts in batches:
            out = []
            for text in texts:
                found: set[int] = set()
                for chunk in {*(text or "").lower().split()}:
                    terms = known.get(chunk)
                    if terms is None:
                        terms = tuple(place[t] for t in hashed_terms(chunk) if t in place)
                        if len(known) >= CACHE:
                            known.clear()
                        if len(chunk) <= 64:
                            known[chunk] = terms
                    if terms:
                        found.update(terms)
                out.append(machine.score(sorted(found)) if found else empty)
            yield pd.Series(out, dtype="float64")

    return docs.withColumn(score_col, F.pandas_udf(run, "double")(F.col(text_col)))


def learn_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5) -> DataFrame:
    """Scores all of ``docs`` with a machine that has not seen the fold whose crc32(id as text) mod ``fold`` is 0.

    Adds ``held_out`` (that remainder is 0; false for a null id), ``score`` and ``predicted`` (1 if the score
    is at least 0.5), in place of columns of these names in ``docs``, which are never inputs; other columns stay. See :func:`fit` and :func:`score` for nulls, ties, repeats and empty tables.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == 0, F.lit(False))
    machine = fit(docs, labels.filter(F.crc32(F.col(id_col).cast("string")) % fold != 0), id_col, text_col, label_col)
    return score(docs, machine, text_col).withColumn("held_out", held).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
