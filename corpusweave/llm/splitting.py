"""Splitting oversized texts at natural boundaries: range-maximum queries over boundary strengths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.tokens import VOCABULARY, Tokenizer

_SPACE = re.compile(rb"\s+")
_HEADING = re.compile(rb"\\(?:sub)*section\b|#{1,6} |\d+(?:\.\d+)*\.? [A-Z]")
#: Strength of a cut after what the pattern matches. Each pattern begins with a mark and so is linear in the text.
_MARKS = (
    (2, re.compile(rb"[,;:](?=\s)|\xef\xbc\x8c|\xef\xbc\x9b|\xef\xbc\x9a|\xe3\x80\x81")),
    (3, re.compile(rb"[.!?][\"')\]]*(?=\s|$)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")),
)


def boundary_strengths(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Strength of a cut before each token and after the last: 6 before a heading, 5 between paragraphs, 4 between
    lines, 3 after a sentence, 2 after a clause, 1 between words, 0 within one, -1 inside a character."""
    at = np.zeros(len(data) + 1, np.int8)
    for m in _SPACE.finditer(data):
        lines = data.count(b"\n", m.start(), m.end())
        strength = 1 if not lines else 6 if _HEADING.match(data, m.end()) else 5 if lines > 1 else 4
        at[m.start()] = at[m.end()] = strength
    for strength, pattern in _MARKS:
        for m in pattern.finditer(data):
            at[m.end()] = max(at[m.end()], strength)
    inside = (np.frombuffer(data, np.uint8) & 0xC0) == 0x80
    at[:-1][inside] = -1
    return at[ends]


class RightmostMax:
    """Sparse table: the rightmost place of the largest value in any range of at most `longest` places.

    The table is built for a stretch of a few ranges at a time, as queries move on, so it stays small however long the
    values are."""

    STRETCH = 4

    def __init__(self, values: np.ndarray, longest: int):
        self.values, self.longest, self.base = values, longest, 0
        self.levels: list[np.ndarray] = []

    def _build(self, base: int) -> None:
        self.base, part = base, self.values[base : base + (self.STRETCH + 1) * self.longest]
        self.part, self.levels, width = part, [np.arange(len(part), dtype=np.int32)], 1
        while 2 * width <= min(self.longest, len(part)):
            last = self.levels[-1]
            left, right = last[: len(last) - width], last[width:]
            self.levels.append(np.where(part[right] >= part[left], right, left))
            width *= 2

    def query(self, lo: int, hi: int) -> int:
        """Place in [lo, hi], both included."""
        if not self.levels or not self.base <= lo <= hi < self.base + len(self.part):
            self._build(lo)
        k = (hi - lo + 1).bit_length() - 1
        left, right = self.levels[k][lo - self.base], self.levels[k][hi - self.base - (1 << k) + 1]
        return self.base + int(right if self.part[right] >= self.part[left] else left)


def cut_points(strengths: np.ndarray, capacity: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) token ranges of at most `capacity`, each sharing `overlap` tokens with the next.

    A cut is allowed between half the capacity and the whole of it. A cut that would start the next piece inside a
    character counts as inside one itself; where a whole window is like that, the next piece starts earlier."""
    n = len(strengths) - 1
    if n <= capacity:
        return [(0, n)]
    if not 0 <= overlap < capacity // 2:
        raise ValueError("the overlap must be less than half the capacity")
    allowed = strengths.copy()
    if overlap:
        allowed[overlap:][strengths[:-overlap] < 0] = -1
    best = RightmostMax(allowed, capacity)
    out, start = [], 0
    while n - start > capacity:
        end = best.query(start + max(capacity // 2, overlap + 1), start + capacity)
        if allowed[end] < 0:
            end = start + capacity
            while strengths[end] < 0 and end > start + 1:
                end -= 1
        out.append((start, end))
        after = end - overlap
        while strengths[after] < 0 and after > start:
            after -= 1
        start = after if after > start else end
    out.append((start, n))
    return out


def split_text(text: str, tok: Tokenizer, capacity: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start_token, end_token, start_byte, end_byte) of each piece; one piece where the text fits.

    Each piece, encoded by itself, has at most `capacity` tokens: should cutting inside a word make one longer, the
    whole text is cut again to a limit shorter by the excess."""
    tokens = np.asarray(tok.encode(text), np.int64)
    ends = np.concatenate([[0], np.cumsum(tok.lengths[tokens])])
    if len(tokens) <= capacity:
        return [(0, len(tokens), 0, int(ends[-1]))]
    data = text.encode()
    strengths, limit = boundary_strengths(data, ends), capacity
    while True:
        pieces = [(a, b, int(ends[a]), int(ends[b])) for a, b in cut_points(strengths, limit, overlap)]
        excess = max(len(tok.encode(data[x:y].decode(errors="replace"))) for _, _, x, y in pieces) - capacity
        if excess <= 0 or limit <= max(8, 2 * overlap + 2):
            return pieces
        limit = max(limit - excess, 8, 2 * overlap + 2)


def split_oversized(
    docs: DataFrame, capacity: int, overlap: int, oversized_only: bool = False, with_text: bool = True, path: str = VOCABULARY
) -> DataFrame:
    """(doc_id, piece_no, n_pieces, start_token, n_tokens, start_byte, end_byte[, piece]) of docs (doc_id, text).

    Null and empty texts give one empty piece. Repeated rows are each split. Only the two columns are read. A text of
    no more bytes than `capacity` cannot have more tokens, since a token has at least one byte; with `oversized_only`
    such texts are set aside before Python sees them.
    """
    if oversized_only:
        docs = docs.where(F.octet_length("text") > capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer.load(path)
        names = ["doc_id", "piece_no", "n_pieces", "start_token", "n_tokens", "start_byte", "end_byte"]
        for batch in batches:
            rows, texts = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                pieces = split_text(text or "", tok, capacity, overlap)
                if oversized_only and len(pieces) == 1:
                    continue
                rows += [(doc, i, len(pieces), a, b - a, x, y) for i, (a, b, x, y) in enumerate(pieces)]
                if with_text:
                    data = (text or "").encode()
                    texts += [data[x:y].decode() for _, _, x, y in pieces]
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if with_text:
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], [*names, "piece"])
            else:
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece_no int, n_pieces int, start_token int, n_tokens int, start_byte long, end_byte long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema + (", piece string" if with_text else ""))


def size_limit(limits: DataFrame, name: str) -> tuple[int, int]:
    """(capacity_tokens, overlap_tokens) of a named row of the limits, a table of a fixed few rows."""
    row = limits.where(F.col("spec_name") == name).first()
    if row is None:
        raise ValueError(f"no size limit named {name}")
    return int(row.capacity_tokens), int(row.overlap_tokens)
