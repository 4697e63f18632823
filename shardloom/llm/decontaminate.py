"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of WINDOW consecutive words (an item of fewer words, but not none, is one window).
A window is a set of word shingles with their places in it, ordered by how rarely each occurs in the documents.
Containment asks for all of them, so the necessary prefix is the one rarest shingle: a document without it can't
hold the window. Document shingles are joined to the prefixes alone; a hit at position p of a shingle that stands
at offset o fixes the only possible start, p - o; the positional bound (start >= 0) and the length bound
(start + length <= words of the document) are applied next, and the words over the whole window are then
compared exactly.

The windows are dealt into blocks of at most BLOCK_WINDOWS by hash, and only one block at a time is sent to the
executors, so what is broadcast is bounded whatever the benchmark's size; each block runs over all documents.

Defined cases: null and empty texts have no words, hence no hits; an item without words has no window; equal
items and equal windows all count; repeated document rows are each answered; a null item_id is left out of the
list of items but its windows hit. Documents and benchmark may have any other columns.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import importable, map_rows, pieces, stored

WINDOW = 10
SHINGLE = 5
BLOCK_WINDOWS = 100_000
#: A-Z to a-z; what is not a letter, digit or beyond ASCII to a space.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased text: runs of [0-9a-z] and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Block:
    """A bounded block of windows, indexed for the scan. words: ids from 1; 0 is any other word, -1 ends a document."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.words: dict[bytes, int] = {}
        self.items = [items for _, items in windows]
        self.ids = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in text.split(b" ")], np.int64) for text, _ in windows]
        #: by shingle length: sorted distinct codes
        self.codes: dict[int, np.ndarray] = {}
        found = defaultdict(list)
        for x in self.ids:
            k = min(SHINGLE, len(x))
            found[k].append(shingle_codes(x, k))
        self.codes = {k: np.unique(np.concatenate(v)) for k, v in found.items()}
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}

    def order_by(self, counts: dict[tuple[int, int], int]) -> None:
        """Keeps, for each window, the place of its rarest shingle (ties: the first)."""
        self.prefix = {k: defaultdict(list) for k in self.codes}
        for w, x in enumerate(self.ids):
            k = min(SHINGLE, len(x))
            codes = shingle_codes(x, k).tolist()
            at = min(range(len(codes)), key=lambda i: (counts.get((k, codes[i]), 0), i))
            self.prefix[k][codes[at]].append((w, at))
        self.codes = {k: np.array(sorted(v), np.uint64) for k, v in self.prefix.items()}

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts, each ended by -1, and where each text ends."""
        get, out, ends, n = self.words.get, [], [], 0
        for t in texts:
            words = words_of(t)
            out.append(np.array([get(w, 0) for w in words], np.int64))
            out.append(np.array([-1], np.int64))
            n += len(words) + 1
            ends.append(n)
        return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(ends, np.int64)

    def places(self, ids: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By shingle length: positions of shingles that the block has, and their codes."""
        out, known = {}, ids > 0
        for k, codes in self.codes.items():
            n = len(ids) - k + 1
            if n <= 0 or not len(codes):
                continue
            full = known[:n].copy()
            for j in range(1, k):
                full &= known[j : n + j]
            at = np.flatnonzero(full)
            if len(at):
                code = codes_at(ids, at, k)
                hit = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
                out[k] = at[hit], code[hit]
        return out


def codes_at(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    code = np.zeros(len(at), np.uint64)
    for j in range(k):
        code = code * _MIX + ids[at + j].astype(np.uint64)
    return code


def shingle_codes(ids: np.ndarray, k: int) -> np.ndarray:
    return codes_at(ids, np.arange(len(ids) - k + 1), k)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, most: int) -> list:
    """Lazy blocks: functions that fetch the windows of one block."""

    def run(batches):
        for b in batches:
            item, text = [], []
            for i, t in zip(b[item_col], b[text_col]):
                for w in dict.fromkeys(windows_of(words_of(t), width)):
                    item.append(i)
                    text.append(w)
            yield {"item": item, "window": text}

    source = benchmark.select(F.col(item_col).cast("string").alias(item_col), text_col)
    rows = map_rows(source, run, "item string, window binary").distinct()
    n = rows.count()
    parts = max(1, -(-n // most))

    def fetch(k: int) -> Block:
        by = defaultdict(list)
        for r in rows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == k).collect():
            by[bytes(r["window"])] += [r["item"]] if r["item"] is not None else []
        return Block(sorted((w, sorted(items)) for w, items in by.items()))

    return [lambda k=k: fetch(k) for k in range(parts)] if n else []


def rarity(docs: DataFrame, shared, text_col: str) -> dict[tuple[int, int], int]:
    """How often each shingle of the block occurs in all documents; at most the block's shingles come back."""

    def run(batches):
        block = shared.value
        total: dict[int, np.ndarray] = {k: np.zeros(len(c), np.int64) for k, c in block.codes.items()}
        for b in batches:
            for x in pieces(b, text_col):
                ids, _ = block.flat(x[text_col])
                for k, (_, code) in block.places(ids).items():
                    total[k] += np.bincount(np.searchsorted(block.codes[k], code), minlength=len(total[k]))
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield {"k": [k] * len(at), "at": at.tolist(), "n": v[at].tolist()}

    out = map_rows(docs.select(text_col), run, "k int, at int, n bigint").groupBy("k", "at").agg(F.sum("n").alias("n")).collect()
    codes = {k: c.tolist() for k, c in shared.value.codes.items()}
    return {(r["k"], codes[r["k"]][r["at"]]): r["n"] for r in out}


def hits_in(block: Block, ids: np.ndarray, ends: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """By document: spans (start, end in its words) of windows, and items."""
    begins = np.concatenate([[0], ends[:-1]])
    out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for k, (at, code) in block.places(ids).items():
        of = np.searchsorted(ends, at, side="right")
        for p, c, d in zip(at.tolist(), code.tolist(), of.tolist()):
            for w, offset in block.prefix[k][c]:
                start, x = p - offset, block.ids[w]
                if start < begins[d] or start + len(x) > ends[d] - 1:
                    continue
                if np.array_equal(ids[start : start + len(x)], x):
                    spans, items = out.setdefault(d, ([], set()))
                    spans.append((start - int(begins[d]), start - int(begins[d]) + len(x)))
                    items.update(block.items[w])
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(id_col, n_words, spans array<int>, items array<string>): spans are merged, as start, end, start, end, ..."""
    importable(docs.sparkSession)
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    source = docs.select(id_col, text_col)
    todo = blocks(benchmark, item_col, item_text_col, width, block_windows) or [lambda: Block([])]
    if len(todo) > 1:  # row numbers, written once, tell repeated documents apart between blocks
        source, _ = stored(source.withColumn("__row", F.monotonically_increasing_id()), "rows")

    def scan(fetch, only_hits: bool) -> DataFrame:
        block = ranked(spark, fetch(), source, text_col)
        shared = spark.sparkContext.broadcast(block)

        def run(batches):
            block = shared.value
            for b in batches:
                for x in pieces(b, text_col):
                    ids, ends = block.flat(x[text_col])
                    hits = hits_in(block, ids, ends)
                    at = sorted(hits) if only_hits else range(len(ends))
                    sizes = (np.diff(ends, prepend=0) - 1).tolist()
                    none = ([], set())
                    yield {
                        **({"__row": [x["__row"][i] for i in at]} if only_hits else {id_col: x[id_col], "n_words": sizes}),
                        "spans": [merged(hits.get(i, none)[0]) for i in at],
                        "items": [sorted(hits.get(i, none)[1]) for i in at],
                    }

        head = "__row bigint" if only_hits else f"`{id_col}` {kind}, n_words bigint"
        out = map_rows(source, run, f"{head}, spans array<int>, items array<string>")
        if only_hits:
            out, _ = stored(out, "hits")
            shared.destroy()
        return out

    if len(todo) == 1:
        return scan(todo[0], False)
    hits = None
    for fetch in todo:
        found = scan(fetch, True)
        hits = found if hits is None else hits.unionByName(found)
    joined = hits.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def again(batches):
        for b in batches:
            yield b | {"spans": [merged(list(zip(s[::2], s[1::2]))) for s in b["spans"]]}

    def count(batches):
        for b in batches:
            yield {"__row": b["__row"], id_col: b[id_col], "n_words": [len(words_of(t)) for t in b[text_col]]}

    joined = map_rows(joined, again, "__row bigint, spans array<int>, items array<string>")
    base = map_rows(source, count, f"__row bigint, `{id_col}` {kind}, n_words bigint")
    none = {c: F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", "array<int>"), ("items", "array<string>"))}
    return base.join(joined, "__row", "left").select(id_col, "n_words", *none.values())


def ranked(spark, block: Block, docs: DataFrame, text_col: str) -> Block:
    """The block with its prefixes chosen by how rare shingles are in docs."""
    if block.codes:
        once = spark.sparkContext.broadcast(block)
        block.order_by(rarity(docs, once, text_col))
        once.unpersist()
    return block


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of matches()."""
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("bigint"))
    n_hit = F.aggregate(signed, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no window of the benchmark."""
    importable(docs.sparkSession)
    spark, out = docs.sparkSession, docs
    todo = blocks(benchmark, "item_id", "text", width, block_windows)
    for fetch in todo:
        shared = spark.sparkContext.broadcast(ranked(spark, fetch(), docs, text_col))

        def run(batches, shared=shared):
            block = shared.value
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                keep: list[bool] = []
                for x in pieces({text_col: texts}, text_col):
                    hits = hits_in(block, *block.flat(x[text_col]))
                    keep += [i not in hits for i in range(len(x[text_col]))]
                yield b.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, out.schema)
        if len(todo) > 1:
            out, _ = stored(out, "clean")
            shared.destroy()
    return out


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - {WINDOW - 1}))) AS i FROM b WHERE len(ws) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT rid, ws, n.n AS n, unnest(generate_series(1, len(ws) - n.n + 1)) AS i FROM d, n WHERE len(ws) >= n.n)),
h AS (SELECT rid, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS pos FROM h) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN s USING (rid)
"""
