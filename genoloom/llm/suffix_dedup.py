"""Suffix-array dedup: every byte covered by a long string that also starts elsewhere is removed."""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.operators.lineage import written
from genoloom.operators.pieces import in_slices

#: Bits for a place inside one slab of text, and bytes of text that a task holds in one slab (it works in some 40 bytes for
#: each; results don't depend on it).
PLACE_BITS, SLAB = 26, 1_000_000
#: Bits for the number of further starts of one anchor.
START_BITS = 12
START_MASK = (1 << START_BITS) - 1
#: Symbols of one suffix array.
BATCH_SYMBOLS = 150_000
#: Contexts of one middle that a suffix array takes at most; the strings of larger groups are dealt out by hash.
HOT_GROUP = 1000
GRAM = 8
#: Whether a code point (up to the last blank one) is blank, as in str.split.
BLANK = np.array([chr(k).isspace() for k in range(0x3001)] + [False])


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of ``s`` by grouping, in two passes and without renaming.

    First pass: suffixes start in groups by first symbol. Groups are settled from the greatest down; a settled
    group's context is the longest Lyndon word its suffixes begin with. For each of its suffixes the nearest
    earlier suffix of a lower group (the previous smaller one) is found by following such pointers of suffixes
    settled before; those are followed by this group's context, so they leave their own group for a new one
    right above it, the higher the more often the context follows. Second pass: from the least suffix up, each
    suffix that is emitted lets the suffixes whose Lyndon word ends where it begins take the next places of
    their groups: the one before it, and on along the pointers until one has its place.

    A group is named by the place of its first suffix in the final order, so a new group needs no other's name.
    """
    n = len(s)
    if n < 2:
        return list(range(n))
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(s):
        by_symbol[c].append(i)
    group = [0] * (n + 1)
    size: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    first_of: dict[int, int] = {}  # last place of a group: its first place
    place = 0
    for c in sorted(by_symbol):
        own = by_symbol[c]
        for i in own:
            group[i] = place
        size[place], members[place] = len(own), own
        first_of[place + len(own) - 1] = place
        place += len(own)
    group[n] = -1  # stands before all: index -1 reads it
    before = [-1] * n
    last = n - 1
    while last >= 0:
        here = first_of[last]
        hung: dict[int, int] = {}
        for i in members.pop(here):
            if group[i] != here:
                continue
            j = i - 1
            while group[j] >= here:
                j = before[j]
            before[i] = j
            if j >= 0:
                hung[j] = hung.get(j, 0) + 1
        last = here - 1
        if not hung:
            continue
        if len(hung) == 1:
            layers = [(0, list(hung))]
        else:
            by_count: dict[int, list[int]] = defaultdict(list)
            for j, k in hung.items():
                by_count[k].append(j)
            layers = sorted(by_count.items(), reverse=True)
        for _, those in layers:
            if len(those) == 1:
                parts = [(group[those[0]], those)]
            else:
                split: dict[int, list[int]] = defaultdict(list)
                for j in those:
                    split[group[j]].append(j)
                parts = list(split.items())
            for home, moved in parts:
                k, whole = len(moved), size[home]
                if k == whole:
                    continue
                end = home + whole
                new = end - k
                moved.sort()
                for j in moved:
                    group[j] = new
                members[new], size[new], size[home] = moved, k, whole - k
                first_of[end - 1], first_of[new - 1] = new, home
    out = [0] * n
    nxt = group[:n]
    fill = dict.fromkeys(nxt, 0)
    done = bytearray(n + 1)
    # the end of the text is less than any suffix: it opens the second pass
    i = -1
    while True:
        j = (n if i < 0 else out[i]) - 1
        while j >= 0 and not done[j]:
            g = nxt[j]
            out[g + fill[g]] = j
            fill[g] += 1
            done[j] = 1
            j = before[j]
        i += 1
        if i >= n:
            return out


def units(buf: bytes, bounds: list[tuple[int, int]], length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups the starts of all ``length``-byte strings inside the ``bounds`` of ``buf`` by anchor.

    A string's anchor is the place of the least hash of 8 bytes among its first ``window`` places (the leftmost,
    if equal), so equal strings have equal anchors wherever they stand. Returns per unit the number of its
    bounds, the anchor, and the first and last start that share it.
    """
    none = (np.zeros(0, np.int64),) * 4
    count = len(buf) - GRAM + 1
    if len(buf) < length:
        return none
    valid = np.zeros(len(buf) + 1, np.int8)
    part = np.zeros(len(buf) + 1, np.int32)
    for k, (a, b) in enumerate(bounds):
        if b - a >= length:
            valid[a : b - length + 1] = 1
        part[a:b] = k
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none
    h = np.ndarray((count,), "<u8", buf, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    h &= ~mask
    h |= np.arange(count, dtype=np.uint64)
    step = 1
    while step < window:  # a power of two
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    at = (h[starts] & mask).astype(np.int64)
    own = part[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return own[first].astype(np.int64), at[first], starts[first], starts[last]


def word_windows(text: str, words: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (the latter excluded) of all runs of ``words`` blank-separated words that are under
    ``length`` bytes (UTF-8)."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    blank = np.concatenate([[True], BLANK[np.minimum(points, len(BLANK) - 1)], [True]])
    wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(wide)])
    start = offset[np.flatnonzero(blank[:-1] & ~blank[1:])]
    end = offset[np.flatnonzero(~blank[:-1] & blank[1:])]
    if len(start) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = start[: len(start) - words + 1], end[words - 1 :]
    low = end - start < length
    return start[low], end[low]


def slabs(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Texts laid end to end in slabs: (bytes, bounds in the slab, (text number, offset of the bounds in it)).
    A text longer than a slab is cut so that every ``length``-byte string is whole in one piece."""
    held, bounds, origin, size = [], [], [], 0
    for k, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - length + 1), SLAB):
            piece = text if len(text) <= SLAB else text[lo : lo + SLAB + length - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > SLAB and held:
                yield b"".join(held), bounds, origin
                held, bounds, origin, size = [], [], [], 0
            held.append(piece)
            bounds.append((size, size + len(piece)))
            origin.append((k, lo))
            size += len(piece)
            if len(text) <= SLAB:
                break
    if held:
        yield b"".join(held), bounds, origin


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans, sorted, with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    """The number of maximal runs that the spans cover, and the bytes beside them."""
    gone = merged(spans)
    kept, at = [], 0
    for a, b in gone:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return len(gone), b"".join(kept)


def text_key(text_col: str) -> Column:
    """128 bits that name a text, null as the empty one."""
    return F.unhex(F.md5(F.coalesce(text_col, F.lit(""))))


def _new_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_once`, within a task that reads the rows anyway (key first), so that it needs no second worker for that."""
    had: set[bytes] = set()
    for batch in batches:
        first = []
        for k in batch.column(0).to_pylist():
            first.append(k not in had)
            had.add(k)
        yield batch.filter(pa.array(first, pa.bool_()))


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` without rows of a key that their task has had before: however often a text stands in the table, no more
    rows of it than tasks are left, and no text is moved for that."""

    @F.pandas_udf("boolean")
    def new(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        had: set[bytes] = set()
        for batch in keys:
            first = []
            for k in batch:
                first.append(k not in had)
                had.add(k)
            yield pd.Series(first, dtype=bool)

    return docs.withColumn("__new", new.asNondeterministic()("key")).filter("__new").drop("__new")


def _twice(rows: DataFrame) -> DataFrame:
    """The hashes that stand in more than one row. They are counted by hash and half, so that a join by hash deals
    them out anew and adaptive execution may split a frequent hash there."""
    half = F.pmod("hash", F.lit(2)).alias("half")
    return rows.groupBy("hash", half).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")


def _signed(x: int) -> int:
    return x - (1 << 63)


def _spans(keys: Sequence[bytes], *longs: Sequence[int | None]) -> pa.RecordBatch:
    """Spans (from, to) with what a hot middle's strings are counted by (n, h1, h2), else null."""
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(x, pa.int64()) for x in longs)], names=["key", "from", "to", "n", "h1", "h2"])


def _near(groups: np.ndarray, lines: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row, the longest beginning that its line shares with another line of the same group."""
    keys = np.concatenate([groups.astype(">u8").view(np.uint8).reshape(-1, 8), lines], axis=1)
    words = np.ascontiguousarray(keys).view(">u8")  # rows are whole words: a group's number, then the line
    order = np.lexsort(words.T[::-1])
    x, g, n = lines[order], groups[order], sizes[order]
    differs = np.concatenate([x[1:] != x[:-1], np.ones((len(x) - 1, 1), bool)], axis=1) if len(x) > 1 else np.zeros((0, 1), bool)
    shared = np.minimum(np.minimum(differs.argmax(1), n[1:]), n[:-1]) if len(x) > 1 else np.zeros(0, np.int64)
    shared = np.where(g[1:] == g[:-1], shared, -1)
    best = np.full(len(x), -1)
    best[1:] = np.maximum(best[1:], shared)
    best[:-1] = np.maximum(best[:-1], shared)
    out = np.empty(len(x), np.int64)
    out[order] = best
    return out


def repeated_starts(groups: list[int], lefts: list[bytes], rights: list[bytes], window: int) -> list[np.ndarray]:
    """For each context, which of its starts (0 to the length of its left part) begin a repeated string.

    A context is left bytes, the middle that all contexts of its group share, and right bytes. The middle
    counts as one symbol, so a string is ``window`` symbols with the middle among them. It repeats if and only
    if a neighbour in the suffix array of all contexts begins with the same ``window`` symbols.
    """
    n = len(groups)
    out = [np.zeros(len(x) + 1, bool) for x in lefts]
    _, group = np.unique(np.array(groups, np.int64), return_inverse=True)
    wide = window
    right = np.zeros((n, wide), np.uint8)
    left = np.zeros((n, wide), np.uint8)
    for k in range(n):
        right[k, : len(rights[k])] = np.frombuffer(rights[k], np.uint8)
        left[k, : len(lefts[k])] = np.frombuffer(lefts[k], np.uint8)[::-1]
    ls, rs = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    # no string can repeat if the best shared left and right parts together are too short
    keep = (_near(group, right, rs) >= 0) & (_near(group, left, ls) + 1 + _near(group, right, rs) >= window)
    rows = np.flatnonzero(keep)
    if len(rows) < 2:
        return out
    symbols: list[int] = []
    start = []
    for k in rows:
        start.append(len(symbols))
        symbols += [x + 1 for x in lefts[k]]
        symbols.append(257 + int(group[k]))
        symbols += [x + 1 for x in rights[k]]
        symbols.append(0)
    order = np.array(suffix_array(symbols), np.int64)
    flat = np.array(symbols + [0] * window, np.int64)
    begins = np.zeros(len(symbols), bool)
    for k, at in zip(rows, start, strict=True):
        begins[at : at + max(0, min(ls[k], ls[k] + 1 + rs[k] - window) + 1)] = True
    windows = np.lib.stride_tricks.sliding_window_view(flat, window)
    a, b = order[:-1], order[1:]
    both = np.flatnonzero(begins[a] & begins[b])
    hit = np.zeros(len(symbols), bool)
    for lo in range(0, len(both), 65_536):
        x, y = a[both[lo : lo + 65_536]], b[both[lo : lo + 65_536]]
        same = (windows[x] == windows[y]).all(1)
        hit[x[same]] = hit[y[same]] = True
    for k, at in zip(rows, start, strict=True):
        out[k] = hit[at : at + ls[k] + 1]
    return out


def dealt_contexts(contexts: DataFrame) -> DataFrame:
    """Contexts of one hash in one task, but those of a ``hot`` hash anywhere."""
    salt = F.when(F.col("hot"), F.xxhash64("key", "lo"))
    return contexts.repartition("hash", salt).sortWithinPartitions("hash")


def context_strings(mark: int, left: bytes, right: bytes, window: int) -> list[tuple[int, int, int]]:
    """(start, h1, h2) of each string of a context, as in :func:`repeated_starts`: equal hashes for equal strings."""
    out = []
    for a in range(max(0, min(len(left), len(left) + 1 + len(right) - window) + 1)):
        before = len(left) - a
        h = xxhash.xxh3_128_intdigest(struct.pack("<qq", mark, before) + left[a:] + right[: window - 1 - before])
        out.append((a, _signed(h >> 64), _signed(h & (2**64 - 1))))
    return out


def repeated_words(docs: DataFrame, copied: DataFrame, words: int, length: int) -> DataFrame:
    """Spans (key, from, to) of all runs of ``words`` words under ``length`` bytes that also start elsewhere."""

    def short_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "key", "n", "spans"]
        longs = lambda x: pa.array(x, pa.int64())
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in _new_rows(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin, end = word_windows(text, words, length)
                if len(begin):
                    raw = text.encode()
                    # a run that a text repeats is one row, with all its places
                    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
                    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                        places[xxhash.xxh3_128_intdigest(raw[a:b])].append((a, b))
                    spans = [[{"from": a, "to": b} for a, b in merged(own)] for own in places.values()]
                    cols = (longs([_signed(x >> 64) for x in places]), longs([_signed(x & (2**64 - 1)) for x in places]), pa.array([key] * len(places), pa.binary()), longs([len(own) for own in places.values()]), pa.array(spans, kind))
                    yield pa.RecordBatch.from_arrays(list(cols), names=names)

    rows = docs.filter(F.octet_length("text") >= 2 * words - 1).select("key", "text")
    found = written(rows.mapInArrow(short_windows, "h1 long, h2 long, key binary, n long, spans array<struct<from:long,to:long>>"), "words")
    twice = found.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1").select("h1", "h2")
    some = found.join(twice, ["h1", "h2"], "left_semi").select("key", "spans").union(found.join(copied, "key", "left_semi").select("key", "spans"))
    return written(some.select("key", F.explode("spans").alias("s")).select("key", "s.from", "s.to"), "short")


def repeated_spans(df: DataFrame, id_col: str, text_col: str, length: int, coarse: int, fine: int, words: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, copied, texts, spans): a row per document with key, n_bytes and whole_sha256; the keys of several rows, whose
    texts are repeated as a whole; a row (key, text in bytes) per text that may hold another repeated string; spans
    (key, from, to) of such texts that are to be removed, overlapping."""
    if coarse & (coarse - 1) or fine & (fine - 1) or max(coarse, fine) + GRAM > length or max(coarse, fine) > START_MASK:
        raise ValueError(f"windows are powers of two, under the length by {GRAM} at least and under {START_MASK}")
    docs = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key("text"))
    rows = written(docs.select(id_col, "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256")), "rows")
    copied = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")

    def coarse_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "key", "starts"]
        for batch in _new_rows(batches):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for buf, bounds, origin in slabs(texts, length):
                own, at, lo, hi = units(buf, bounds, length, coarse)
                same = length - coarse + 1
                hashes = [_signed(xxhash.xxh3_64_intdigest(buf[p : p + same])) for p in at.tolist()]
                base = np.array([o - b[0] for (_k, o), b in zip(origin, bounds, strict=True)], np.int64)
                text_no = np.array([k for k, _o in origin], np.int64)
                # first start and how many more share the anchor: fewer than the window has places
                starts = (lo + base[own] << START_BITS) | (hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), keys.take(pa.array(text_no[own])), pa.array(starts)], names=names)

    long_enough = docs.filter(F.octet_length("text") >= length).select("key", F.col("text").cast("binary").alias("text"))
    marks = written(long_enough.mapInArrow(coarse_units, "hash long, key binary, starts long"), "coarse")
    # a text that several tasks had gives the same marks again
    ranges = marks.join(_twice(marks), "hash").groupBy("key").agg(F.collect_set("starts").alias("ranges"))
    short = repeated_words(docs, copied, words, length) if words else None
    if short is not None:
        ranges = ranges.join(short.select("key").distinct(), "key", "full")
    least = min(length, 2 * words - 1) if words else length
    texts = _once(docs.filter(F.octet_length("text") >= least).select("key", F.col("text").cast("binary").alias("text")))
    texts = written(texts.join(ranges, "key").dropDuplicates(["key"]), "texts")
    some = texts.filter("ranges is not null")
    same = length - fine + 1

    def fine_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "c1", "c2", "key", "at", "lo", "hi"]
        for batch in batches:
            keys = batch.column(0)
            texts, slices, home = batch.column(1).to_pylist(), [], []
            for k, found in enumerate(batch.column(2).to_pylist()):
                for a, b in merged([(r >> START_BITS, (r >> START_BITS) + (r & START_MASK) + 1) for r in found]):
                    slices.append(texts[k][a : b - 1 + length])
                    home.append((k, a))
            for buf, bounds, origin in slabs(slices, length):
                own, at, lo, hi = units(buf, bounds, length, fine)
                cols: list[list[int]] = [[], [], []]
                for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    cols[0].append(_signed(xxhash.xxh3_64_intdigest(buf[p : p + same])))
                    whole = xxhash.xxh3_128_intdigest(buf[a : b + length], p - a)
                    cols[1].append(_signed(whole >> 64))
                    cols[2].append(_signed(whole & (2**64 - 1)))
                base = np.array([o + home[s][1] - b[0] for (s, o), b in zip(origin, bounds, strict=True)], np.int64)[own]
                doc = keys.take(pa.array(np.array([home[s][0] for s, _ in origin], np.int64)[own]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), doc, *map(pa.array, (at + base, lo + base, hi + base))], names=names)

    kind = ["hash", "c1", "c2"]
    found = written(some.mapInArrow(fine_units, "hash long, c1 long, c2 long, key binary, at long, lo long, hi long"), "fine")
    classes = written(
        found.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at", "lo", "hi")).alias("m")).select(*kind, "n", "m.*"), "contexts"
    )
    whole = found.join(classes.filter("n > 1").select(*kind), kind, "left_semi").select("key", F.col("lo").alias("from"), (F.col("hi") + length).alias("to"))
    # by hash and half, as in _twice
    open_ = classes.groupBy("hash", F.pmod("hash", F.lit(2)).alias("half")).agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("least")).filter("g > 1 and least = 1").select("hash", (F.col("g") > HOT_GROUP).alias("hot"))
    asked = classes.join(open_, "hash").groupBy("key").agg(F.collect_list(F.struct("hash", "n", "at", "lo", "hi", "hot")).alias("asked"))

    def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "n", "key", "lo", "left", "right", "hot"]
        for batch in batches:
            for key, text, want in zip(*(batch.column(k) for k in range(3)), strict=True):
                key, text, want = key.as_py(), text.as_py(), want.as_py()
                rows = [(w["hash"], w["n"], key, w["lo"], text[w["lo"] : w["at"]], text[w["at"] + same : w["hi"] + length], w["hot"]) for w in want]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    contexts = some.select("key", "text").join(asked, "key").mapInArrow(cut_contexts, "hash long, n long, key binary, lo long, left binary, right binary, hot boolean")

    def sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            starts = repeated_starts([r[0] for r in held], [r[4] for r in held], [r[5] for r in held], fine)
            keys, begin, end = [], [], []
            for (_, n, key, lo, *_), hit in zip(held, starts, strict=True):
                if n > 1 or not hit.any():
                    continue
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    keys.append(key)
                    begin.append(lo + a)
                    end.append(lo + b - 1 + length)
            return _spans(keys, begin, end, *[[None] * len(keys)] * 3)

        for batch in batches:
            strings = []
            for r in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if r[6]:
                    strings += [(r[2], r[3] + a, r[3] + a + length, r[1], h1, h2) for a, h1, h2 in context_strings(r[0], r[4], r[5], fine)]
                    continue
                if size >= BATCH_SYMBOLS and r[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r[4]) + len(r[5]) + 2
            if strings:
                yield _spans(*zip(*strings, strict=True))
        if held:
            yield flush()

    met = written(dealt_contexts(contexts).mapInArrow(sort_contexts, "key binary, from long, to long, n long, h1 long, h2 long"), "spans")
    strings = met.filter("h1 is not null")
    twice = strings.groupBy("h1", "h2").agg(F.sum("n").alias("seen")).filter("seen > 1").select("h1", "h2")
    # contexts of n > 1 repeat as a whole already
    part = met.filter("h1 is null").union(strings.filter("n = 1").join(twice, ["h1", "h2"], "left_semi").select(*met.columns)).select("key", "from", "to")
    spans = whole.union(part)
    return rows, copied, texts, spans if short is None else spans.union(short)


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, coarse: int = 256, fine: int = 64, keep_text: bool = False, words: int = 0
) -> DataFrame:
    """Removes every byte of a text (UTF-8) that a ``length``-byte string covers which also starts anywhere
    else: in another document, or elsewhere in the same one; overlaps count, and strings are judged on the input.
    With ``words``, so does a run of that many blank-separated words, however few bytes it has.

    One row per row of ``df``: ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    (lower-case hex, of the remaining bytes) and, with ``keep_text``, ``key`` (:func:`text_key`) and ``kept``
    (the remaining text, without characters that a cut has split; null where nothing was removed). Null texts are empty;
    rows of equal texts are copies of each other, whatever their ids (null too); extra columns are ignored; an empty
    table gives an empty result.

    Rows of a text are counted first. A text of several rows and ``length`` bytes goes as a whole, and takes part in
    the search as one text, so no list and no join grows with the number of copies.

    Strings are grouped by anchors that depend on their own bytes only, coarsely over all texts and finely where
    a coarse anchor's following bytes occur twice. A fine context seen twice repeats as a whole. The others,
    about the ends of repeated passages, meet those that share their middle, and a suffix array of the contexts
    tells which of their strings repeat; where over HOT_GROUP contexts share a middle, their strings are counted
    by hash on Spark instead, so no task holds such a group. No task needs a whole document group: contexts that are equal are one.
    """
    rows, copied, texts, spans = repeated_spans(df, id_col, text_col, length, coarse, fine, words)
    listed = spans.groupBy("key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in in_slices(batches):
            rows = []
            for text, found in zip(pdf["text"], pdf["spans"], strict=True):
                n_spans, left = without(text, [(r["from"], r["to"]) for r in found])
                rows.append((len(text) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if keep_text else None))
            out = pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept"])
            out["key"] = pdf["key"].to_list()
            yield out[["key", "n_removed", "n_spans", "kept_sha256", "kept"] if keep_text else ["key", "n_removed", "n_spans", "kept_sha256"]]

    kinds = "key binary, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if keep_text else "")
    done = texts.select("key", "text").join(listed, "key").mapInPandas(cut, kinds).withColumnRenamed("kept_sha256", "sha")
    found = rows.join(done, "key", "left").join(copied.withColumn("copied", F.lit(True)), "key", "left")
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= length)
    return found.select(
        id_col, "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole_sha256")).alias("kept_sha256"),
        *(["key", F.when(gone, "").otherwise(F.col("kept")).alias("kept")] if keep_text else []),
    )


def left_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, coarse: int = 256, fine: int = 64) -> DataFrame:
    """The rows of :func:`remove_repeats` with the text that is left of each: ``id_col``, n_bytes, n_removed, n_spans,
    kept_sha256 and ``text`` (without characters that a cut has split, whose bytes the hash counts; null texts stay null).

    Texts are dealt out once, to their spans, and cut in their rows: those of several rows and ``length`` bytes go as a whole,
    so no text is cut twice. Only what is cut goes to Python."""
    rows, _, _, spans = repeated_spans(df, id_col, text_col, length, coarse, fine)
    # by key and half, as in _twice; beside the spans, what counts the rows of a text
    none = F.lit(None).cast("long")
    ends = spans.select("key", "from", "to", F.lit(0).alias("n")).union(rows.filter(F.col("n_bytes") >= length).select("key", none, none, F.lit(1)))
    span = F.when(F.col("from").isNotNull(), F.struct("from", "to"))
    listed = ends.groupBy("key", F.pmod(F.xxhash64("key"), F.lit(2)).alias("half")).agg(F.collect_set(span).alias("spans"), (F.sum("n") > 1).alias("whole"))
    listed = listed.filter("whole or size(spans) > 0").drop("half")

    @F.pandas_udf("n_removed long, n_spans long, sha string, kept string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pdf in in_slices(pd.DataFrame({"text": text, "spans": spans}) for text, spans in batches):
            found = []
            for text, own in zip(pdf["text"], pdf["spans"], strict=True):
                if text is None:
                    found.append((None,) * 4)
                    continue
                n_spans, left = without(text, [(r["from"], r["to"]) for r in own])
                found.append((len(text) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            yield pd.DataFrame(found, columns=["n_removed", "n_spans", "sha", "kept"]).astype({"n_removed": "Int64", "n_spans": "Int64"})

    docs = df.select(F.col(id_col), F.col(text_col).alias("text")).withColumn("key", text_key("text")).join(listed, "key", "left")
    some = ~F.col("whole")
    done = docs.withColumn("c", cut(F.when(some, F.col("text").cast("binary")), F.when(some, F.col("spans"))))
    text, gone = F.coalesce("text", F.lit("")), F.coalesce("whole", F.lit(False))
    n_bytes = F.octet_length(text).cast("long")
    return done.select(
        id_col, n_bytes.alias("n_bytes"),
        F.when(gone, n_bytes).otherwise(F.coalesce("c.n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("c.n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("c.sha", F.sha2(text, 256))).alias("kept_sha256"),
        F.when(gone, "").otherwise(F.coalesce("c.kept", "text")).alias("text"),
    )
