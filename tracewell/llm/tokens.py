"""Token counts by a public tokenizer, and hashed vectors of the tokens."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DIMS = 3  # dimensions that hashed vectors are projected to
BUCKETS = 4096  # of the hashed vectors
PIECE = 200_000  # characters encoded at a time

# Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):
    """The tokenizer of a ``.tiktoken`` file, kept for later tasks of the same Python worker."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_tracewell", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces_of(text: str) -> Iterator[str]:
    """A text cut into pieces of about ``PIECE`` characters, which bounds what is encoded at a time.

    Cuts are made before a single blank between two other characters. The splitting pattern begins a
    new part there in any case, so the tokens are those of the whole text. Where no such blank
    follows, the rest is one piece.
    """
    at = 0
    while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def projection(seed: int = 7) -> np.ndarray:
    """Random directions of the hash buckets: BUCKETS x DIMS, the same in every run."""
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def with_tokens(docs: DataFrame, doc_id: str, text: str, *also: str, tokenizer: str = DEFAULT_TOKENIZER, vectors: bool = False) -> DataFrame:
    """``doc_id, also..., n_tokens`` and with ``vectors`` the projected vector ``x_0 .. x_2``.

    Null and empty texts have 0 tokens and a vector of zeros. The vector is the text's token counts
    hashed into buckets, damped (square root), brought to length 1 and projected. Texts are encoded
    whole, whatever their length; special tokens' names in a text are ordinary text.
    """
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (doc_id, *also)] + ["n_tokens bigint"] + [f"x_{i} float" for i in range(DIMS) if vectors])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        table = projection() if vectors else None
        for batch in batches:
            counts = np.zeros(len(batch), dtype=np.int64)
            points = np.zeros((len(batch), DIMS), dtype=np.float32)
            for i, t in enumerate(batch[text].tolist()):
                if not t:
                    continue
                for piece in pieces_of(t):
                    ids = enc.encode_ordinary(piece)
                    counts[i] += len(ids)
                    if vectors:
                        kinds, n = np.unique(np.asarray(ids, dtype=np.int64) * 2654435761 % 4294967296 % BUCKETS, return_counts=True)
                        points[i] += np.sqrt(n) @ table[kinds] / max(1.0, np.sqrt(n.sum()))
            out = batch[[doc_id, *also]].copy()
            out["n_tokens"] = counts
            if vectors:
                for d in range(DIMS):
                    out[f"x_{d}"] = points[:, d]
            yield out

    return docs.select(doc_id, *also, F.col(text).cast("string").alias(text)).mapInPandas(encode, schema)
