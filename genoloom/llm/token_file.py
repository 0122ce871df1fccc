"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

A segment holds the ids of whole documents: a header of four little-endian unsigned 64-bit integers (magic,
documents, ids, ranks), the rank table (ids by falling frequency in the segment, 4 bytes each), the documents'
id counts (8 bytes each), the control bytes and the data bytes. Each id is written as its rank in the fewest
whole bytes, 1 to 4; a control byte holds the byte counts, less one, of four ids, two bits each from the lowest.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoloom.operators.lineage import written

MAGIC = 0x31534449  # "IDS1"
#: Ids after which a segment is closed (a longer document has a segment of its own).
SEGMENT_IDS = 2_000_000
#: Bytes of input to a part, and parts at most (an estimate may be far too high).
PART_BYTES, MOST_PARTS = 64_000_000, 100_000
CACHE_WORDS, CACHE_CHARS = 700_000, 48

#: For each control byte: the byte counts of its four ids and their sum.
COUNTS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1
TOTALS = COUNTS.sum(1, dtype=np.int64)


def pack_segment(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """One segment of the ids of ``len(sizes)`` documents."""
    top = int(ids.max()) + 1 if len(ids) else 0
    seen = np.bincount(ids, minlength=top)
    by_rank = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
    rank_of = np.zeros(top, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = rank_of[ids]
    widths = 1 + (ranks > 0xFF) + (ranks > 0xFFFF).astype(np.int64) + (ranks > 0xFFFFFF)
    padded = np.ones(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = widths
    control = ((padded.reshape(-1, 4) - 1) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < widths[:, None]]
    head = np.array([MAGIC, len(sizes), len(ids), len(by_rank)], "<u8")
    return b"".join(x.tobytes() for x in (head, by_rank.astype("<u4"), sizes.astype("<u8"), control, data))


def unpack_segment(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids (unsigned 32-bit) and the documents' id counts of a segment, by table lookup on its control bytes."""
    magic, docs, total, ranked = (int(x) for x in np.frombuffer(blob, "<u8", 4))
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    by_rank = np.frombuffer(blob, "<u4", ranked, 32)
    at = 32 + 4 * ranked
    sizes = np.frombuffer(blob, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    control = np.frombuffer(blob, np.uint8, -(-total // 4), at)
    data = np.zeros(len(blob) - at - len(control) + 4, np.uint8)
    data[:-4] = np.frombuffer(blob, np.uint8, len(data) - 4, at + len(control))
    widths = COUNTS[control].ravel()[:total]
    ends = np.cumsum(widths, dtype=np.int64)
    ranks = data[ends - widths].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(widths > k)
        if not len(more):
            break
        ranks[more] |= data[ends[more] - widths[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return by_rank[ranks], sizes


#: The normalizer, and the step after the cut into words, by which a file's words can be encoded one by one.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


#: The character by which the byte-level step writes each byte: itself where it can be seen, else one from 256 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SEEN)}

CHAR_BYTES = {ord(c): b for b, c in BYTE_CHARS.items()}
#: Other characters than Latin letters and common signs, of which two libraries' tables may differ.
OTHER_SCRIPTS = re.compile("[^\0-\u024f\u2010-\u2027\u2030-\u205e]").search


class WordTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, whose model sees each distinct word once.

    The library's own normalizer and pre-tokenizer cut a text into words that its model then encodes one by
    one; so the words are cut here by the same pattern and the library's model encodes those not met before.
    ``exact`` tells whether the file has the shape that allows this; other files, and texts that hold one of the
    file's added tokens, go through the library whole.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        norm = (made.get("normalizer") or {}).get("normalizers", [])
        cutters = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        cut = cutters[0]
        self.exact = norm == NORMALIZER and cut.get("type") == "Split" and bool(cut.get("invert")) and cut.get("behavior") == "Removed" and "Regex" in cut.get("pattern", {}) and cutters[1:] == [BYTE_LEVEL]
        # the library takes these out of a text before it cuts words: texts that hold one go through it whole
        self.added = [x["content"] for x in made.get("added_tokens") or []]
        self.exact = self.exact and not any(x["normalized"] for x in made.get("added_tokens") or [])
        if self.exact:
            pattern = cut["pattern"]["Regex"]
            quick = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
            self.cut = lambda text: quick(text) if not OTHER_SCRIPTS(text) else self._cut_by_library(text)
            plain = pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r a-z0-9]")
            self.cut_ascii = re.compile(plain).findall if "\\p" not in plain else self.cut
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _cut_by_library(self, text: str) -> list[str]:
        """Words as the library's own pre-tokenizer cuts them: its tables say what a letter or number is."""
        return [w.translate(CHAR_BYTES).encode("latin-1").decode() for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def _learn(self, words: set[str]) -> None:
        """Lets the library's model encode words not met before, as its byte-level step hands them over."""
        if len(self.words) + len(words) > CACHE_WORDS:
            self.words.clear()
        of, known = self.lib.model.tokenize, self.words
        for word in words:
            ids = [t.id for t in of(word.encode().decode("latin-1").translate(BYTE_CHARS))]
            known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not self.exact or any(x in text for x in self.added):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.isascii():
            text, cut = text.lower(), self.cut_ascii
        else:
            text, cut = unicodedata.normalize("NFC", text), self.cut
            # the two letters whose lower case is not the same letter for letter in both libraries
            text = self.lib.normalizer.normalize_str(text) if "\u03a3" in text or "\u0130" in text else text.lower()
        # no word spans white space, so chunks between it are remembered too; Python also splits at four
        # control characters that are not white space in the library
        whole = any(c in text for c in "\x1c\x1d\x1e\x1f")
        chunks = [text] if whole else text.split()
        known = self.chunks
        new = {c: cut(c) for c in {*chunks}.difference(known)}
        if new:
            words = {w for ws in new.values() for w in ws}
            if missing := words.difference(self.words):
                self._learn(missing)
                if lost := words.difference(self.words):
                    self._learn(lost)
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new |= {c: cut(c) for c in {*chunks}.difference(new)}
                if lost := {w for ws in new.values() for w in ws}.difference(self.words):
                    self._learn(lost)
            at = self.words
            fresh = {c: b"".join([at[w] for w in ws]) for c, ws in new.items()}
            long = [c for c in fresh if len(c) > CACHE_CHARS]
            known.update(fresh)
            out = b"".join(map(known.__getitem__, chunks))
            for c in long:
                del known[c]
            return out
        return b"".join(map(known.__getitem__, chunks))


@functools.lru_cache(2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer per Python worker, kept from task to task."""
    return WordTokenizer(path)


def write_tokens(df: DataFrame, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes every text's ids, each followed by ``end_id``, as segments in ascending ``id_col`` order and
    returns the written table: part, segment, doc_ids (array), n_ids, blob.

    Null ids come first; a null or empty text has only its end id; rows of one id follow each other by the hash of
    their text. Rows are range-partitioned once, by id and that hash, so that rows of one id may lie in several
    parts; there are as many parts as the input's estimated bytes ask for (``PART_BYTES`` each), or as the session
    has shuffle partitions if those are more. Tasks close a segment after ``segment_ids`` ids, so memory is bounded
    whatever a partition holds. The files go through Spark's own committer into the shared folder, so
    a task that runs again replaces its file.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES)
    ordered = rows.repartitionByRange(min(n, MOST_PARTS), "id", "h").sortWithinPartitions("id", "h").drop("h")
    names = ["part", "segment", "doc_ids", "n_ids", "blob"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = tokenizer_of(tokenizer_file), TaskContext.get().partitionId()
        ids: list[int | None] = []
        packed: list[bytes] = []
        size = segment = 0

        def close() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(packed), "<u4")
            blob = pack_segment(flat, np.array([len(x) // 4 for x in packed]))
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, segment, ids, len(flat), blob), kinds, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = tokenizer.encode(text.as_py() or "") + end
                if packed and size + len(one) // 4 > segment_ids:
                    yield close()
                    ids, packed, size, segment = [], [], 0, segment + 1
                ids.append(doc)
                packed.append(one)
                size += len(one) // 4
        if packed:
            yield close()

    return written(ordered.mapInArrow(run, "part int, segment int, doc_ids array<long>, n_ids long, blob binary"), "token-segments")


def read_tokens(files: DataFrame, digest: bool = False) -> DataFrame:
    """The documents of a written table: id, start (ids of all documents before it), n_tokens, and ``ids``
    (array<long>) or, with ``digest``, their unsigned CRC-32 as little-endian 32-bit integers (``ids_crc32``)."""
    before = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    # one row per segment, millions of ids each: the only rows that meet in one task
    first = files.groupBy("part", "segment").agg(F.max("n_ids").alias("n_ids"))
    first = first.select("part", "segment", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    value = "ids_crc32 long" if digest else "ids array<long>"
    names = ["part", "segment", "id", "skip", "n_tokens", value.split()[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, docs, blob in zip(*(batch.column(k) for k in range(4)), strict=True):
                ids, sizes = unpack_segment(blob.as_py())
                ends = np.cumsum(sizes)
                skip = ends - sizes
                little = ids.astype("<u4")
                if digest:
                    raw = memoryview(little.tobytes())
                    out = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(skip.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.append(skip, len(ids)), pa.int32()), pa.array(ids.astype(np.int64)))
                count = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * count, pa.int32()), pa.array([segment.as_py()] * count, pa.int32()), pa.array(docs.as_py(), pa.int64()), pa.array(skip, pa.int64()), pa.array(sizes, pa.int64()), out],
                    names=names,
                )

    rows = files.select("part", "segment", "doc_ids", "blob").mapInArrow(run, f"part int, segment int, id long, skip long, n_tokens long, {value}")
    return rows.join(first, ["part", "segment"]).select("id", (F.col("base") + F.col("skip")).alias("start"), "n_tokens", value.split()[0])
