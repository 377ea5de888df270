"""Byte-level BPE: encode with a local rank file, decode raw bytes.

Texts are split before encoding only where the pattern splits in any case
(before white space that follows other text), so that a long text never goes
through the matcher at once; a run of white space too long for the matcher is
one match of the pattern and is encoded as such.

A null text counts as empty; an empty text has no ids and decodes to no
bytes.  Repeated rows give repeated results; an empty table gives no rows;
other columns of any name are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import by_bytes, id_text, map_batches

#: Code points that go through the matcher at once, and the longest run of
#: white space that does.
PART, RUN = 1 << 16, 4096

# the matcher's white space (Unicode White_Space); Python's \s has four more
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{_WS}])[{_WS}]")
_RUN = re.compile(f"[{_WS}]{{{RUN},}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoding(ranks_path: str | None = None, pattern: str | None = None):
    """The encoding of a rank file (one ``base64 rank`` a line); no network."""
    import tiktoken

    with open(ranks_path or default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(
        "local", pat_str=pattern or default_pattern(), mergeable_ranks=ranks, special_tokens={}
    )


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match): the parts joined are the text."""
    at = 0
    while at < len(text):
        run = _RUN.search(text, at)
        end = run.start() if run else len(text)
        while end - at > PART:
            cut = _CUT.search(text, at + PART, end)
            if cut is None:
                break
            yield text[at : cut.start()], False
            at = cut.start()
        if end > at:
            yield text[at:end], False
        at = end
        if run:
            # the last one of the run belongs to what follows, if anything does
            stop = run.end() if run.end() == len(text) else run.end() - 1
            yield text[at:stop], True
            at = stop


def encode(text: str | None, enc) -> list[int]:
    if not text:
        return []
    if len(text) <= RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, single in parts(text):
        ids += enc._core_bpe.encode_single_piece(part.encode()) if single else enc.encode_ordinary(part)
    return ids


def decode(ids: list[int], enc) -> bytes:
    return enc.decode_bytes(ids)


def encoded(
    docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids array<int>, decoded binary: the ids and what they decode to."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for part in by_bytes(batch, most=1 << 20):  # ids are several times the text
            ids = [np.array(encode(t.as_py(), enc), np.int32) for t in part.column("text")]
            raw = [decode(x.tolist(), enc) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(raw, pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    return map_batches(id_text(docs, id_col, text_col), fn, "doc_id long, ids array<int>, decoded binary")


def token_lengths(
    docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        n = [len(encode(t.as_py(), enc)) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(id_text(docs, id_col, text_col), fn, "doc_id long, n_tokens long")


@lru_cache(maxsize=1)
def _decimals(n: int) -> list[str]:
    return list(map(str, range(n)))


def bpe_digest(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, by
    :func:`encode` and :func:`decode`, hashed where the ids are made."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        names = _decimals(enc.n_vocab)
        n, a, b = [], [], []
        for t in batch.column("text"):
            ids = encode(t.as_py(), enc)
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
            b.append(hashlib.sha256(decode(ids, enc)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(
        id_text(docs), fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
