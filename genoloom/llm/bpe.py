"""Byte-level BPE encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces and results that a task remembers at most, and the longest piece worth remembering.
CACHE_PIECES, CACHE_CHARS = 700_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

#: White space before a space.
BEFORE_SPACE = re.compile(r"\s ")
#: Patterns (fixed values) whose pieces take the one space before them and no other.
SPACED = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}


class Encoder:
    """Exact BPE of one piece in time linear in its length.

    A run of tokens is what the merges would leave if, and only if, each adjacent pair is: undoing the two
    tokens' merges from the last backwards must never meet a merge across their border that would have come
    first. So the encoder takes the longest token at each place, falls back to its longest proper prefixes
    and, where none fits its left neighbour, takes that neighbour back; no place is entered twice.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.find = ahocorasick.Automaton()
        self.halves_of: dict[int, tuple[int, int] | None] = {}
        self.prefix_of: dict[int, int] = {}
        self.fits_memo: dict[int, bool] = {}
        for t, i in ranks.items():
            if self.halves(i) is not None:
                self.find.add_word(t.decode("latin-1"), (i, len(t) - 1))
        self.find.make_automaton()

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of this token joins; itself twice for a single byte; None if the
        merges never make it."""
        if token not in self.halves_of:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                joined = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)]
                rank, i = min(joined)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 1:
                self.halves_of[token] = (token, token)
            elif len(parts) == 2 and all(p in self.ranks for p in parts):
                self.halves_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
            else:
                self.halves_of[token] = None
        return self.halves_of[token]

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if token not in self.prefix_of:
            text, ranks = self.tokens[token], self.ranks
            cuts = (ranks.get(text[:k], -1) for k in range(len(text) - 1, 0, -1))
            self.prefix_of[token] = next((i for i in cuts if i >= 0 and self.halves(i) is not None), -1)
        return self.prefix_of[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges can leave these two tokens side by side."""
        key = left << 32 | right
        known = self.fits_memo.get(key)
        if known is None:
            if len(self.fits_memo) > 3_000_000:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        bound = 1 << 40  # merges from this rank on come too late to matter
        while True:
            if ranks.get(tokens[left] + tokens[right], 1 << 40) < bound:
                return False
            # undo the later merge of the two; on equal rank the left one was made first
            if left > right and self.size[left] > 1 or self.size[right] == 1:
                if self.size[left] == 1:
                    return True
                bound, left = left, self.halves(left)[1]
            else:
                bound, right = right + 1, self.halves(right)[0]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, size, memo = len(piece), self.size, self.fits_memo
        longest = [-1] * n
        for end, (token, back) in self.find.iter(piece.decode("latin-1")):
            longest[end - back] = token  # ends ascend, so the last one stays
        out: list[int] = []
        shut: set[int] = set()
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not shut or end not in shut:
                    if last < 0:
                        break
                    ok = memo.get(last << 32 | token)
                    if ok is None:
                        ok = self.fits(last, token)
                    if ok:
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at, last = end, token
                if end < n:
                    token = longest[end]
            else:  # nothing fits here after ``last``: take it back and try its prefixes
                shut.add(at)
                at -= size[last]
                token = self.shorter(out.pop())
                last = out[-1] if out else -1
        return out


def ascii_form(pattern: str) -> str | None:
    """The same pattern for pure ASCII text in the standard library's dialect; None if it has other classes."""
    stands = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": "\t-\r ", r"\S": None}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part in stands:
            if part == r"\S":
                if inside:
                    return None
                out.append("[^\t-\r ]")
            else:
                out.append(stands[part] if inside else f"[{stands[part]}]")
            continue
        if part[0] == "\\" and part[1:2].isalpha():
            return None
        inside = part == "[" or inside and part != "]"
        out.append(part)
    return "".join(out)


class TextCodec:
    """Whole texts to packed ids (little-endian unsigned 32-bit) and back; splits by ``pattern`` first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.encoder = Encoder(ranks)
        # white space as Unicode defines it: Python's \\s also holds four control characters
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.spaced = pattern in SPACED
        narrow = ascii_form(pattern)
        self.split_ascii = re.compile(narrow).findall if narrow else self.split
        self.table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.table[i] = t
        codec = self

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.array(codec.encoder.encode(piece.encode()), "<u4").tobytes()
                if len(piece) <= CACHE_CHARS:
                    if len(self) >= CACHE_PIECES:
                        self.clear()
                    self[piece] = ids
                return ids

        self.known = Known()

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = codec.pieces(" " + chunk)
                if len(chunk) <= CACHE_CHARS:
                    if len(self) >= CACHE_PIECES:
                        self.clear()
                    self[chunk] = ids
                return ids

        self.chunks = Chunks()

    def pieces(self, text: str) -> bytes:
        split = self.split_ascii if text.isascii() else self.split
        return b"".join(map(self.known.__getitem__, split(text)))

    def encode(self, text: str) -> bytes:
        # A space before a character that is not one opens a new piece, and a run of white space stays whole
        # if no space follows other white space; such texts are cut at their spaces first, which is faster.
        if not self.spaced or BEFORE_SPACE.search(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        return self.pieces(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec_of(rank_file: str, pattern: str) -> TextCodec:
    """One codec per Python worker, kept from task to task."""
    return TextCodec(read_ranks(rank_file), pattern)


def encode_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encodes each whole text by the merges of ``rank_file`` and decodes the ids again.

    Columns: ``id_col``, ``n_tokens``, and either ``ids`` (binary, little-endian unsigned 32-bit) with
    ``decoded`` (binary), or with ``digest`` their SHA-256 in lower-case hex (``ids_sha256``,
    ``decoded_sha256``). A null or empty text has no tokens. Rows stay as they are: repeated and null ids
    keep a row each, other columns are ignored, an empty table gives an empty result.

    One pass over the rows without a shuffle; the rank file is read once per Python worker, on every executor
    at ``rank_file``'s path, and each worker remembers the pieces it has met, up to a fixed number.
    """
    id_type = df.schema[id_col].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, n_tokens long, " + (
        "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    )
    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(rank_file, pattern)
        for batch in batches:
            sizes, ids, decoded = [], [], []
            for text in batch.column(1):
                packed = codec.encode(text.as_py() or "")
                back = codec.decode(packed)
                sizes.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest() if digest else packed)
                decoded.append(hashlib.sha256(back).hexdigest() if digest else back)
            kind = pa.string() if digest else pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, kind), pa.array(decoded, kind)], names=names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
