"""Token counts and boundaries with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Encodes text; `lengths[t]` is the number of bytes of token t."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, token in ranks.items():
            self.lengths[token] = len(piece)

    def encode(self, text: str) -> list[int]:
        return self._enc.encode_ordinary(text)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        """The worker process's tokenizer; kept on the library's module, which outlives the task."""
        import tiktoken

        kept = tiktoken.__dict__.setdefault("_kept_by_path", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """(id, *keep, n_tokens): tokens of each whole text; null and empty texts have none."""
    cols = [id_col, *keep]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer.load(path)
        for batch in batches:
            n = [len(tok.encode(t)) if t else 0 for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(n, pa.int32())], [*cols, "n_tokens"])

    return docs.select(*cols, F.col("text").alias("__text")).mapInArrow(run, f"{fields}, n_tokens int")
