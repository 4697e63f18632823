"""Quality rules as a short-circuit cascade.

Each rule rejects a text by itself and the text is kept if none does, so the order of the rules never changes a
result; it only decides how early a bad text leaves. cascade() estimates each rule's cost and selectivity on a
bounded sample (SAMPLE rows of SAMPLE_CHARS at most) and orders the rules by rejections per second.

Words are runs of characters other than U+0020 and U+0009-U+000D. A null or empty text has no words and fails
few_words. Lines end at U+000A; a line counts as repeated if it has a word and equals an earlier line.
Repeated rows give repeated results; other columns are left alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import importable, map_rows, pieces

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINE_PERCENT = 50
MAX_UPPER_PERCENT = 50
SAMPLE, SAMPLE_CHARS = 1_000, 50_000
_SPACE = " \t\n\r\x0b\f"
_NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
_NOT_LETTER = bytes(x for x in range(256) if not (65 <= x <= 90 or 97 <= x <= 122))


class Text:
    """The measures of one text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in _SPACE)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeat_words(self.words)

    @cached_property
    def n_upper(self) -> int:
        return len(self.data.translate(None, _NOT_UPPER))

    @cached_property
    def n_letters(self) -> int:
        return len(self.data.translate(None, _NOT_LETTER))


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside any window of `width` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    put = index.setdefault
    ids = np.fromiter((put(w, len(index)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        if k > 1:  # dense again, so that the next product stays far below 2^63
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(index) + ids[k : n + k]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    begins = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[begins] += 1
    edge[begins + width] -= 1
    return int(np.count_nonzero(np.cumsum(edge)[:-1] > 0))


Rule = tuple[str, Callable[[Text], bool]]
#: name and test; a text goes if a test is true.
RULES: list[Rule] = [
    ("few_words", lambda t: t.n_words < MIN_WORDS),
    ("repeated_words", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words),
    ("symbols", lambda t: 100 * t.n_symbols > MAX_SYMBOL_PERCENT * t.n_words),
    ("repeated_lines", lambda t: 100 * t.n_dup_lines > MAX_DUP_LINE_PERCENT * len(t.lines)),
    ("shouting", lambda t: 100 * t.n_upper > MAX_UPPER_PERCENT * t.n_letters),
]
BASE = ("few_words", "repeated_words")


def measured(texts: list[str | None], rules: list[Rule]) -> list[tuple[str, float, float]]:
    """(name, seconds a text, share rejected) of each rule by itself."""
    out = []
    for name, test in rules:
        began, hits = time.perf_counter(), 0
        for t in texts:
            hits += bool(test(Text(t)))
        n = max(1, len(texts))
        out.append((name, (time.perf_counter() - began) / n, hits / n))
    return out


def order(costs: list[tuple[str, float, float]]) -> list[str]:
    """Names by rejections per second, most first; ties by name."""
    return [name for name, s, share in sorted(costs, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0]))]


def cascade(df: DataFrame, rules: list[Rule] = RULES, text_col: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """The rules in the order to apply. The sample is bounded and only sets the order."""
    short = df.where(F.length(text_col) <= SAMPLE_CHARS)
    some = [r[0] for r in short.where(F.xxhash64(text_col) % 16 == 0).select(text_col).limit(sample).collect()]
    by = dict(rules)
    return [(name, by[name]) for name in order(measured(some, rules))] if some else list(rules)


def rejected_by(text: Text, rules: list[Rule]) -> str | None:
    """The first rule that rejects the text; later rules aren't computed."""
    return next((name for name, test in rules if test(text)), None)


def filter_docs(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    importable(df.sparkSession)
    ordered = cascade(df, rules or RULES, text_col)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([rejected_by(Text(t), ordered) is None for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def annotate(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, the base measures, base_failed, kept)."""
    importable(df.sparkSession)
    ordered = cascade(df, rules or RULES, text_col)
    base = [r for r in RULES if r[0] in BASE]

    def run(batches):
        for b in batches:
            for x in pieces(b, text_col):
                texts = [Text(t) for t in x[text_col]]
                failed = [rejected_by(t, base) is not None for t in texts]
                yield {
                    id_col: x[id_col],
                    "n_words": [t.n_words for t in texts],
                    "word_chars": [t.word_chars for t in texts],
                    "n_symbols": [t.n_symbols for t in texts],
                    "n_dup_lines": [t.n_dup_lines for t in texts],
                    "n_repeat_words": [t.n_repeat_words for t in texts],
                    "base_failed": failed,
                    "kept": [not f and rejected_by(t, ordered) is None for f, t in zip(failed, texts)],
                }

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean")


ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text,
        list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0B\\f]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\r\\x0B\\f]')) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS gram
      FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
      FROM w LEFT JOIN p ON w.rid = p.rid),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= {MAX_SYMBOL_PERCENT} * n_words
       AND 100 * n_dup_lines <= {MAX_DUP_LINE_PERCENT} * n_lines AND 100 * n_upper <= {MAX_UPPER_PERCENT} * n_letters AS kept
FROM b
"""
