"""Personal data: fixed patterns, and a skip-chain conditional random field that makes labels consistent in a document.

base_spans() finds emails, IPv4 addresses, payment cards (Luhn) and phone numbers by the fixed patterns; these
spans always stay. The field then labels the document's active tokens (runs of characters other than white space
that hold a digit or '@') as other, email, ip, card or phone:

* unary potentials: coarse shape features, so that a mangled number still looks like its kind;
* chain potentials between neighbouring active tokens;
* skip potentials between tokens of a document that repeat or resemble each other (same digits, or the same name
  before or without '@'), linked occurrence to next occurrence, so a group of m tokens has m - 1 edges;
* the same potentials, after fitting, between the group's first recognised token of each kind and its unrecognised
  ones, so evidence reaches every occurrence in one step however long the group is.

Weights are fitted here by pseudo-likelihood on the first TRAIN_DOCS distinct texts, by hash, of those of TRAIN_CHARS at
most that hold a digit or '@', labelled by the fixed patterns; copies and the order of rows don't matter.
Loopy sum-product message passing runs over all documents of a batch at once, each until its messages change by less
than TOLERANCE (or for a number of rounds that grows with its edges); base labels are clamped. A token
outside every base span whose marginal for a kind reaches MARGIN adds a span (without surrounding punctuation; neighbours of one kind make one).

Null and empty texts have no spans; texts are read whole; positions are code points, ends exclusive. A document's
spans depend on that document and the weights only; repeated rows give repeated results. With no documents the
weights are zero and nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import importable, map_rows, pieces

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_CHARS = 2_000, 20_000
MARGIN = 0.9
TOLERANCE, LEAST_ROUNDS = 1e-4, 100
Span = tuple[int, int, int]  # start, kind, end

_ANY = re.compile(r"[0-9@]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit only and never given back, so a failing run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ACTIVE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGE = "()[]{}<>\"'.,;:!?|#*$%&"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each '@' so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind."""
    if not text or not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


N_LABELS = 5
N_FEATURES = 18


def features(token: str) -> list[float]:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    dots = token.count(".")
    return [
        1.0, digits == 0, 1 <= digits <= 3, 4 <= digits <= 6, 7 <= digits <= 9, 10 <= digits <= 11, digits >= 12,
        letters == 0, 0 < letters <= digits, letters > digits, "@" in token, dots == 0, dots == 3, 1 <= dots <= 2 or dots > 3,
        token.startswith("+"), "(" in token or ")" in token, "-" in token, len(token) > 24,
    ]


def likeness(token: str) -> list[str]:
    """Keys that tokens of one document share if they repeat or resemble each other."""
    core = token.strip(_EDGE).lower()
    digits = _NOT_DIGIT.sub("", core)
    out = [f"d{digits}"] if len(digits) >= 4 else []
    name = core.split("@", 1)[0].lstrip("_")
    if any(c.isalpha() for c in name) and len(name) >= 5:
        out.append(f"n{name}")
    return out


class Graph:
    """The active tokens of several documents as one graph."""

    def __init__(self, texts: Iterable[str | None]):
        self.base: list[list[Span]] = []
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.label: list[int] = []
        feats: list[list[float]] = []
        chain: list[tuple[int, int]] = []
        skip: list[tuple[int, int]] = []
        far: list[tuple[int, int]] = []
        for d, text in enumerate(texts):
            base = base_spans(text)
            self.base.append(base)
            if not text or not _ANY.search(text):
                continue
            groups: dict[str, list[int]] = {}
            b, previous = 0, -1
            for m in _ACTIVE.finditer(text):
                at, token = len(self.span), m[0]
                start, end = m.span()
                while b < len(base) and base[b][2] <= start:
                    b += 1
                kind = next((s[1] + 1 for s in base[b : b + 4] if s[0] < end and s[2] > start), 0)
                self.doc.append(d)
                self.span.append((start, end))
                self.label.append(kind)
                feats.append(features(token))
                if previous >= 0 and start - self.span[previous][1] == 1:
                    chain.append((previous, at))
                for key in likeness(token):
                    group = groups.setdefault(key, [])
                    if group:
                        skip.append((group[-1], at))
                    group.append(at)
                previous = at
            for group in groups.values():
                if len(group) > 2:
                    first = {self.label[x]: i for i, x in reversed(list(enumerate(group))) if self.label[x]}
                    far += [(group[i], x) for i in first.values() for j, x in enumerate(group) if not self.label[x] and abs(i - j) > 1]
        self.features = np.array(feats, np.float64).reshape(-1, N_FEATURES)
        self.labels = np.array(self.label, np.int64)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)
        self.far = np.array(far, np.int64).reshape(-1, 2)


class Field:
    """unary (features x labels), chain (left label x right label), skip (label): log potentials."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip


def fit(graph: Graph, steps: int = 200, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum pseudo-likelihood: each label given its features and its neighbours' labels."""
    unary, chain, skip = np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS)
    n = len(graph.labels)
    if not n:
        return Field(unary, chain, skip)
    y, one = graph.labels, np.eye(N_LABELS)
    (a, b), (s, t) = graph.chain.T, graph.skip.T
    moment = [np.zeros_like(x) for x in (unary, chain, skip)]
    for _ in range(steps):
        score = graph.features @ unary
        np.add.at(score, a, chain[:, y[b]].T)
        np.add.at(score, b, chain[y[a]])
        np.add.at(score, s, one[y[t]] * skip)
        np.add.at(score, t, one[y[s]] * skip)
        p = np.exp(score - score.max(1, keepdims=True))
        gap = one[y] - p / p.sum(1, keepdims=True)
        gradient = (graph.features.T @ gap, gap[a].T @ one[y[b]] + one[y[a]].T @ gap[b], (gap[s] * one[y[t]] + gap[t] * one[y[s]]).sum(0))
        for w, m, g in zip((unary, chain, skip), moment, gradient):
            m *= 0.9
            m += g / n - decay * w
            w += rate * m
    return Field(unary, chain, skip)


def marginals(graph: Graph, field: Field, tolerance: float = TOLERANCE) -> np.ndarray:
    """Loopy sum-product over all edges at once, each document until it has converged; labels of base spans are clamped. Rows sum to 1."""
    local = graph.features @ field.unary
    fixed = graph.labels > 0
    local[fixed] = -50.0
    local[fixed, graph.labels[fixed]] = 50.0
    edges = np.concatenate([graph.chain, graph.skip, graph.far])
    tables = np.concatenate([np.repeat(field.chain[None], len(graph.chain), 0), np.repeat(np.diag(field.skip)[None], len(edges) - len(graph.chain), 0)])
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    weight = np.exp(np.concatenate([tables, tables.transpose(0, 2, 1)]))
    m, half = np.zeros((len(source), N_LABELS)), len(edges)
    doc = np.array(graph.doc, np.int64)[edges[:, 0]]
    limit = LEAST_ROUNDS + 2 * np.bincount(doc, minlength=1)  # a damped message takes about two rounds an edge
    live, done = np.arange(half), 0
    while len(live):
        both = np.concatenate([live, live + half])
        nodes, place = np.unique(np.concatenate([source[both], target[both]]), return_inverse=True)
        start, end = place[: len(both)], place[len(both) :]
        unary, table, now, of = local[nodes], weight[both], m[both], doc[live]
        stop = np.zeros(len(limit), bool)
        while not stop[of].any():  # no document's rounds depend on those of others in the batch
            belief = unary.copy()
            np.add.at(belief, end, now)
            out = belief[start] - np.concatenate([now[len(live) :], now[: len(live)]])
            out = np.einsum("el,elk->ek", np.exp(out - out.max(1, keepdims=True)), table)
            new = np.log(np.maximum(out / out.sum(1, keepdims=True), 1e-30))
            moved = np.abs(new - now).max(1)
            now, done = 0.5 * now + 0.5 * new, done + 1
            most = np.zeros(len(limit))
            np.maximum.at(most, of, np.maximum(moved[: len(live)], moved[len(live) :]))
            stop = (most < tolerance) | (done >= limit)
        m[both] = now
        live = live[~stop[of]]
    belief = local
    np.add.at(belief, target, m)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def spans(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text."""
    graph = Graph(texts)
    every = [list(b) for b in graph.base]
    if len(graph.labels):
        p = marginals(graph, field)
        kind, added = p[:, 1:].argmax(1), -1
        for i in np.flatnonzero((graph.labels == 0) & (p[:, 1:].max(1) >= MARGIN)).tolist():
            d, (start, end) = graph.doc[i], graph.span[i]
            token = texts[d][start:end]
            start += len(token) - len(token.lstrip(_EDGE))
            end -= len(token) - len(token.rstrip(_EDGE))
            if start >= end:
                continue
            joins = every[d] and i and graph.doc[i - 1] == d and every[d][-1][1:] == (int(kind[i]), added) and start - added <= 3
            every[d][-1 if joins else len(every[d]) :] = [(every[d][-1][0] if joins else start, int(kind[i]), end)]
            added = end
    return [(b, sorted(e)) for b, e in zip(graph.base, every)]


def train(df: DataFrame, text_col: str = "text", most: int = TRAIN_DOCS) -> Field:
    """Weights from at most `most` distinct texts that hold a digit or '@', the first by their hash, then by themselves."""
    short = df.where(F.length(text_col) <= TRAIN_CHARS)
    some = short.where(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # Hashes alone are made distinct over all rows; texts only up to the last hash that is needed.
    last = some.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    first = some.where(F.col("h") <= F.lit(last)).distinct().orderBy("h", "text").limit(most)
    return fit(Graph(r["text"] for r in first.collect()))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans); counts and digest are of base spans."""
    importable(df.sparkSession)
    field = field or train(df, text_col)

    def run(batches):
        for b in batches:
            for x in pieces(b, text_col):
                found = spans(x[text_col], field)
                yield {
                    id_col: x[id_col],
                    **{f"n_{name}": [sum(s[1] == k for s in base) for base, _ in found] for k, name in enumerate(KINDS)},
                    "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found],
                    "spans": [written(every) for _, every in found],
                }

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str | None, found: list[Span]) -> str | None:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    if not text or not found:
        return text
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, field: Field | None = None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """df with the spans of text_col masked; size_col, if there, is the new text's length. Other columns stay."""
    importable(df.sparkSession)
    field = field or train(df, text_col)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            out: list[str | None] = []
            for x in pieces({text_col: texts}, text_col):
                out += [masked(t, every) for t, (_, every) in zip(x[text_col], spans(x[text_col], field))]
            b = b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))
            n = b.schema.get_field_index(size_col)
            if n >= 0 and pa.types.is_integer(b.schema.field(n).type):
                old = b.column(n).to_pylist()
                b = b.set_column(n, b.schema.field(n), pa.array([len(o) if o is not None and o != t else k for o, t, k in zip(out, texts, old)], b.schema.field(n).type))
            yield b

    return df.mapInArrow(run, df.schema)
