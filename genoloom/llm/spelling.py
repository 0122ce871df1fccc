"""Spelling variants: words one edit apart, found through numbered nodes of a forward and a reversed trie."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.lineage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run: ASCII and U+00C0 to U+00FF; in Latin-1 a byte each, all others are blanks.
RUN = "[A-Za-zÀ-ÿ]+"
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Distinct words that a task counts before it sends them on, and letters of a text that are split at once.
HELD, PIECE = 200_000, 1 << 20
#: Nodes that several range partitions share are numbered below zero, by partition boundary and depth.
DEPTH_BITS = 32


def count_words(docs: DataFrame, least: int, every: int) -> DataFrame:
    """(word, n) of (id, text), partial counts: runs with slips, of ``least`` code points and more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text.encode("latin-1", "replace").translate(_BYTES)
                known = zlib.crc32(f"{key}:".encode())
                at = 0
                while at < len(text):
                    end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
                    end = len(text) if end < 0 else end
                    for run, n in Counter([w for w in text[at:end].split() if len(w) >= least]).items():
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), known)
                        if h % every == 0:
                            cut = h % len(run)
                            run = run[:cut] + run[cut + 1 :]
                            if len(run) < least:
                                continue
                        total[run] += n
                    at = end
                    if len(total) > HELD:
                        yield flush()
        yield flush()

    return docs.mapInArrow(scan, "word string, n long")


def _shared(a: str, b: str) -> int:
    return len(commonprefix([a, b]))


def by_range(words: DataFrame) -> DataFrame:
    """``words`` as a table whose parts (column part) are ranges of the column text."""
    return written(words.repartitionByRange("text").withColumn("part", F.spark_partition_id()), "ranges")


def shared_nodes(dealt: DataFrame) -> DataFrame:
    """(id, nodes) of (part, id, text) by :func:`by_range`, texts distinct: the numbers of the trie's nodes on the text's
    way, from the root (an element of depth 0) down to the last that another text also passes.

    Texts of a part are sorted, so those that pass a node stand together: a task numbers nodes as they appear, with the
    part in the upper bits. Nodes over a part's boundary are prefixes of what the texts beside it share; they are named
    by the first boundary that has them. The driver gets two texts a part."""
    ends = sorted((r["part"], r["low"], r["high"]) for r in dealt.groupBy("part").agg(F.min("text").alias("low"), F.max("text").alias("high")).collect())
    place = {part: k for k, (part, _, _) in enumerate(ends)}
    borders = [(ends[k - 1][2], ends[k][1]) for k in range(1, len(ends))]
    borders = [(a, b, a[: _shared(a, b)]) for a, b in borders]

    # first[k][d]: the first boundary whose shared text has the same d letters as boundary k's
    first: list[list[int]] = []
    for k, (_, _, own) in enumerate(borders):
        same = _shared(own, borders[k - 1][2]) if k else -1
        first.append([first[k - 1][d] if d <= same else k for d in range(len(own) + 1)])

    def name(border: int, depth: int) -> int:
        return -1 - (first[border][depth] << DEPTH_BITS | depth)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, before, path = -1, 0, "", []
        held: tuple | None = None  # the text before, that waits for what it shares with the next
        ids, nodes = [], []

        def out(k: int, own: list[int], deepest: int) -> None:
            ids.append(k)
            nodes.append(own[: deepest + 1])

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], names=["id", "nodes"])
            ids.clear()
            nodes.clear()
            return made

        def close() -> None:
            if held is not None:
                right = len(borders[place[part]][2]) if place[part] < len(borders) else -1
                out(held[0], held[1], max(held[2], right))

        for batch in batches:
            for p, k, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if p != part:
                    close()
                    part, before, held = p, "", None
                    left = place[p] - 1
                    if left >= 0:
                        common = len(borders[left][2])
                        path = [name(left, d) for d in range(common + 1)]
                    else:
                        common, path = -1, []
                    count = 0
                else:
                    common = _shared(before, text)
                    out(held[0], held[1], max(held[2], common))
                right = place[p] if place[p] < len(borders) else None
                over = _shared(text, borders[right][2]) if right is not None else -1
                path = path[: common + 1]
                for d in range(len(path), len(text) + 1):
                    if d <= over:
                        path.append(name(right, d))
                    else:
                        path.append(place[p] << 40 | count)
                        count += 1
                held, before = (k, path, common), text
            yield batch_of()
        close()
        yield batch_of()

    rows = dealt.repartition("part").sortWithinPartitions("part", "text").select("part", "id", "text")
    return rows.mapInArrow(number, "id long, nodes array<long>")


def node_pairs(words: DataFrame, forward: DataFrame, back: DataFrame) -> DataFrame:
    """(p, s, kind, id, n): integer pairs of (id, text, n) by the nodes of its way and, in the trie of reversed texts, its
    way back. Kind 0: p and s are the nodes before and after a place between two letters, which names the word itself.
    Kinds 1 and 2: one letter between them is skipped; 1 where it begins a run of this letter."""
    rows = words.join(forward.withColumnRenamed("nodes", "f"), "id").join(back.withColumnRenamed("nodes", "b"), "id")
    rows = rows.select("id", "n", "f", "b", F.char_length("text").alias("w"), F.split("text", "").alias("letters"))

    def over(skip: int):
        low, high = F.greatest(F.lit(0), F.col("w") - skip - F.size("b") + 1), F.least(F.col("w") - skip, F.size("f") - 1)

        def pair(i):
            begins = (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))
            kind = F.when(begins, 1).otherwise(2) if skip else F.lit(0)
            return F.struct(F.get("f", i).alias("p"), F.get("b", F.col("w") - skip - i).alias("s"), kind.alias("kind"))

        none = F.array().cast("array<struct<p:bigint,s:bigint,kind:int>>")
        return F.when(low <= high, F.transform(F.sequence(low, high), pair)).otherwise(none)

    return rows.select("id", "n", F.explode(F.concat(over(0), over(1))).alias("x")).select("x.*", "id", "n")


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are one edit away, and the one of largest n (struct of -n and id).

    Words that skip a letter between the same two nodes differ by one replaced letter; a word that skips one is another
    with a letter inserted where the pair names that other word. A pair stands for no more words than there are
    letters (90), and each two near words meet at one pair: of letters that repeat, only the first of a run is
    taken out. So a word's counts are summed over its pairs, and no two words are written out."""
    place = F.struct((-F.col("n")).alias("neg"), F.col("id").alias("id"))
    rows = pairs.withColumns({"place": place, "skips": F.col("kind") > 0})
    group = Window.partitionBy("p", "s")
    listed = Window.partitionBy("p", "s", "skips").orderBy("n2", "id")
    rows = rows.withColumn("n2", -F.col("n"))
    skip, first, cut = F.when(F.col("skips"), 1), F.when(F.col("kind") == 1, F.col("place")), F.when(F.col("kind") == 0, F.col("place"))
    rows = rows.withColumns({
        "all": F.count(F.lit(1)).over(group), "others": F.count(skip).over(group) - 1, "firsts": F.count(first).over(group),
        "best_first": F.min(first).over(group), "cut": F.min(cut).over(group),
    }).filter("all > 1")
    whole = listed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"rank": F.row_number().over(listed), "top": F.nth_value("place", 1).over(whole), "second": F.nth_value("place", 2).over(whole)})
    longer = F.when(F.col("kind") == 1, F.col("cut"))
    other = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("top"))
    of_skip = F.least(other, longer)
    near = F.when(F.col("skips"), F.col("others") + F.when(longer.isNotNull(), 1).otherwise(0)).otherwise(F.col("firsts"))
    best = F.when(F.col("skips"), of_skip).otherwise(F.col("best_first"))
    return rows.select("id", near.alias("near"), best.alias("best")).filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """(id, root) of (id, form): where a chain of forms ends. Each form has ``times`` the occurrences of its word, so
    chains are short, and their length halves with each round."""
    reach = written(links.select("id", F.col("form").alias("root")), "roots")
    while True:
        step = reach.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if reach.join(step, "root", "left_semi").isEmpty():
            return reach
        reach = written(reach.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, twice: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """Words and their spelling variants: word, form, root (string), n, n_near, form_n (long), one row per word.

    Runs of letters (A to Z, a to z, U+00C0 to U+00FF) of whole texts, with A to Z lower-cased; of those whose CRC32 of
    ``<id>:<run>`` ``every`` divides, the code point at that number modulo the length is deleted (``every``: 31). Words
    have at least ``least`` code points and ``twice`` occurrences (n). Two are near if one inserted, deleted or replaced
    code point makes one of the other. A word's form is its near word of largest n (ties: smallest in code-point order)
    if that is ``times`` its own n or more, else null; root follows forms to the last (the word itself, if it has none).

    Occurrences are counted in each task before they are exchanged. Words are numbered in code-point order; a forward
    trie and one of reversed words give their nodes numbers, and near words are found where integer pairs of nodes,
    around a skipped letter or a place between letters, are equal (exact, see :func:`near_words`).

    Null texts hold no words; a null id is written as nothing (``:<run>``); rows of one id are texts of their own;
    repeated rows count. Long texts are split by pieces, long words cost as many pairs as their ways are shared. Further
    columns are ignored; an empty table gives an empty result.
    """
    texts = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    counted = count_words(texts, least, every).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= twice)
    counted = written(counted.withColumnRenamed("word", "text"), "counted")
    ordered = counted.repartitionByRange("text").sortWithinPartitions("text")
    # ids of ascending ranges, and within them of ascending words, follow the order of the words
    words = written(ordered.withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()}), "words")
    back = by_range(words.select("id", F.reverse("text").alias("text")))
    near = near_words(node_pairs(words.drop("part"), shared_nodes(words), shared_nodes(back)))
    rows = written(words.select("id", F.col("text").alias("word"), "n").join(near, "id", "left"), "near")
    form_n = -F.col("best.neg")
    links = rows.filter(form_n >= times * F.col("n")).select("id", F.col("best.id").alias("form"), form_n.alias("form_n"))
    links = written(links, "links")
    names = rows.select(F.col("id").alias("of"), F.col("word").alias("name"))
    form = links.join(names, F.col("form") == F.col("of")).select("id", F.col("name").alias("form"), "form_n")
    root = follow(links).join(names, F.col("root") == F.col("of")).select("id", F.col("name").alias("root"))
    found = form.join(root, "id")
    return rows.drop("best").join(found, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
    )


#: DuckDB SQL for the same rows over ``documents``; CRC32 by its table, which is built from its polynomial.
VARIANTS_SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS tab
), run AS (
  SELECT id, r, count(*) AS k FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{RUN}')) AS r FROM documents) x
  WHERE len(r) >= 7 GROUP BY id, r
), byte AS (
  SELECT r, k, hex(encode(id || ':' || r)) AS x FROM run
), hashed AS (
  SELECT r, k, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2),
    lambda i: 16 * (instr('123456789ABCDEF', x[2 * i + 1])) + instr('123456789ABCDEF', x[2 * i + 2]))),
    lambda c, b: xor(tab[xor(c & 255, b) + 1], c >> 8))) AS h FROM byte, crc
), word AS (
  SELECT w, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(r, h % len(r)) || substr(r, h % len(r) + 2) ELSE r END AS w, k FROM hashed) x
  WHERE len(w) >= 7 GROUP BY w HAVING sum(k) >= 2
), skip AS (
  SELECT w, left(w, i) || substr(w, i + 2) AS less, left(w, i) || '*' || substr(w, i + 2) AS hole
  FROM (SELECT w, unnest(range(len(w))) AS i FROM word) x
), near AS (
  SELECT a.w, b.w AS v FROM skip a JOIN skip b ON a.hole = b.hole AND a.w <> b.w
  UNION SELECT a.w, b.w FROM skip a JOIN word b ON a.less = b.w
  UNION SELECT b.w, a.w FROM skip a JOIN word b ON a.less = b.w
), best AS (
  SELECT w, v, m, c FROM (
    SELECT near.w, v, word.n AS m, count(*) OVER (PARTITION BY near.w) AS c,
      row_number() OVER (PARTITION BY near.w ORDER BY word.n DESC, v) AS k FROM near JOIN word ON word.w = v) x WHERE k = 1
), form AS (
  SELECT word.w, v, m FROM word JOIN best USING (w) WHERE m >= 10 * n
), chain(w, v) AS (
  SELECT w, v FROM form UNION ALL SELECT chain.w, form.v FROM chain JOIN form ON form.w = chain.v
)
SELECT word.w AS word, form.v AS form, coalesce(last.v, word.w) AS root, n, coalesce(c, 0) AS n_near, form.m AS form_n
FROM word LEFT JOIN best USING (w) LEFT JOIN form USING (w)
LEFT JOIN (SELECT w, v FROM chain WHERE v NOT IN (SELECT w FROM form)) last USING (w)
"""
