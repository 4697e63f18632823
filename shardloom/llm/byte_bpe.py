"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A null text is the empty text (no ids, empty bytes). Texts of any length are whole: a text longer than
SPLIT_OVER characters is cut at safe boundaries, so that no regular expression or merge sees all of it at once.
A boundary is safe before white space that follows a character other than white space: no alternative of the
pattern runs over such a place, so the ids of the parts, joined, are the ids of the whole. A long run without any
such place stays in one part. Repeated rows give repeated results; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from shardloom.llm.common import importable, map_rows, pieces

SPLIT_OVER = 65_536
PART = 32_768
#: White space and its absence as both Python and the pattern's engine see them.
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n\t])")
_CODECS: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """Ranks from a file of lines `base64(token) rank`; pattern splits text before the merges."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= SPLIT_OVER:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for part in safe_parts(text):
            ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def joined(self, ids: list[int]) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids))


def safe_parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of about `size` characters, cut at safe boundaries only."""
    begin = 0
    while len(text) - begin > size:
        cut = _SAFE.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def codec(rank_file: str, pattern: str) -> Codec:
    """One codec for each worker process and rank file."""
    if (rank_file, pattern) not in _CODECS:
        _CODECS[rank_file, pattern] = Codec(rank_file, pattern)
    return _CODECS[rank_file, pattern]


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>)."""
    importable(df.sparkSession)

    def run(batches):
        c = codec(rank_file, pattern)
        for b in batches:
            for x in pieces(b, text_col):
                yield {id_col: x[id_col], "ids": [c.encode(t) for t in x[text_col]]}

    return map_rows(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary): the raw bytes, which need not be whole characters when ids were cut. Null ids give empty bytes."""
    importable(df.sparkSession)

    def run(batches):
        c = codec(rank_file, pattern)
        for b in batches:
            yield {id_col: b[id_col], "bytes": [c.decode(x or []) for x in b[ids_col]]}

    return map_rows(df.select(id_col, ids_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, so ids need not leave the worker."""
    importable(df.sparkSession)

    def run(batches):
        c = codec(rank_file, pattern)
        for b in batches:
            for x in pieces(b, text_col):
                n, a, d = [], [], []
                for t in x[text_col]:
                    ids = c.encode(t)
                    n.append(len(ids))
                    a.append(hashlib.sha256(c.joined(ids).encode()).hexdigest())
                    d.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield {id_col: x[id_col], "n_tokens": n, "ids_sha256": a, "decoded_sha256": d}

    return map_rows(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
