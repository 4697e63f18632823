"""Quality classification by positive-unlabelled learning.

A logistic model over text measures is fitted to the non-negative unbiased PU risk
    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])
with trusted positives P (labelled 1 in the training folds), unlabelled documents U (without any label) and the
class prior estimated as the share of 1 among all labelled training rows. Measures are cut into bins at the
sample's quantiles and at even steps between its extremes, so the model is additive in the bins, plus the square root of hashed byte-pair shares.

The fit uses at most SAMPLE positives and SAMPLE unlabelled documents, the first by hash of their id, with one text
each (of several texts of an id, the least by hash); the prior and the scores cover all rows. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts have zero measures and get a score like any text; a document with labels of
both kinds isn't a trusted positive; null labels or ids teach nothing; without positives every score is the prior
(0.5 without labels); without unlabelled documents all labelled training documents serve, positives too, as the risk takes U for a mixture; repeated rows are each
scored; ties of hashes go to the smaller id or text; texts are read whole, however long. Other columns are not looked
at, whatever their names; a table without documents has no rows in the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import id_bucket, importable, map_rows, pieces
from shardloom.llm.quality_rules import Text

SAMPLE = 10_000
PAIRS = 64
BINS = 24
STEPS, RATE, DECAY = 300, 1.0, 1e-5
N_STATS = 14


def measures(text: str | None) -> np.ndarray:
    t = Text(text)
    data, words = np.frombuffer(t.data, np.uint8), t.words
    n, size = max(1, len(words)), max(1, len(data))
    same = sum(a == b for a, b in zip(words, words[1:]))
    class_of = _CLASS[data]
    kinds = np.bincount(class_of, minlength=6) / size
    stats = [
        np.log1p(len(words)), t.word_chars / n, t.n_symbols / n, t.n_repeat_words / n, same / n, len(set(words)) / n,
        t.n_dup_lines / max(1, len(t.lines)), t.n_upper / max(1, t.n_letters), *kinds,
    ]
    pairs = np.zeros(PAIRS)
    if len(data) > 1:
        h = (data[:-1].astype(np.uint32) * 257 + data[1:]) * np.uint32(2654435761)
        pairs = np.sqrt(np.bincount(h >> np.uint32(26), minlength=PAIRS) / size)
    return np.concatenate([stats, pairs]).astype(np.float32)


#: 0 other, 1 white space, 2 digit, 3 lower, 4 upper, 5 beyond ASCII; ASCII punctuation is 'other'.
_CLASS = np.array([5 if i > 127 else 4 if 65 <= i <= 90 else 3 if 97 <= i <= 122 else 2 if 48 <= i <= 57 else 1 if i == 32 or 9 <= i <= 13 else 0 for i in range(256)])


class Model:
    def __init__(self, cuts: np.ndarray, weights: np.ndarray, bias: float):
        self.cuts, self.weights, self.bias = cuts, weights, bias

    def inputs(self, x: np.ndarray) -> np.ndarray:
        bins = [np.eye(BINS, dtype=np.float32)[np.searchsorted(c, x[:, i], side="right")] for i, c in enumerate(self.cuts)]
        return np.concatenate([*bins, x[:, N_STATS:]], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative risk by momentum descent; where the second part is below 0 its gradient is turned round."""
    both = np.concatenate([positive, unlabelled])
    stats = both[:, :N_STATS]
    even = np.linspace(*np.quantile(stats, [0.01, 0.995], axis=0), BINS - BINS // 2 + 1)[1:-1].T
    cuts = np.concatenate([np.quantile(stats, np.arange(1, BINS // 2 + 1) / (BINS // 2 + 1), axis=0).T, even], axis=1)
    cuts = np.sort(cuts, axis=1).astype(np.float32)
    model = Model(cuts, np.zeros(0, np.float32), 0.0)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    w, b = np.zeros(p.shape[1], np.float32), np.float32(np.log(prior / (1 - prior)))
    mw, mb = np.zeros_like(w), np.float32(0)
    for _ in range(STEPS):
        _, gw, gb = risk(w, b, p, u, np.float32(prior))
        mw, mb = 0.9 * mw + gw + DECAY * w, 0.9 * mb + gb
        w, b = w - RATE * mw, b - RATE * mb
    return Model(cuts, w.astype(np.float32), float(b))


def risk(w: np.ndarray, b: float, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray, float]:
    """(non-negative risk, direction of its weights, of its bias): the gradient, but turned round while the second part is below 0."""
    zp, zu = p @ w + b, u @ w + b
    gp, gu = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))  # l(-)' = sigmoid(z); l(+)' = sigmoid(z) - 1
    first, second = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    plus = (prior * (p.T @ (gp - 1)) / len(p), prior * (gp - 1).mean())
    minus = (u.T @ gu / len(u) - prior * (p.T @ gp) / len(p), gu.mean() - prior * gp.mean())
    if second < 0:
        return float(first), -minus[0], -minus[1]
    return float(first + second), plus[0] + minus[0], plus[1] + minus[1]


def _measured(docs: DataFrame) -> DataFrame:
    """(mark, x) of rows (mark, text)."""

    def run(batches):
        for b in batches:
            for x in pieces(b, "text"):
                yield {"mark": x["mark"], "x": [measures(t).tobytes() for t in x["text"]]}

    return map_rows(docs.select("mark", "text"), run, "mark int, x binary")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[Model | None, float]:
    """(model, prior). labels: the rows that may teach; a document with none of them counts as unlabelled if it isn't in labels."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    taught = known.where("__teach").groupBy(id_col).agg(F.min(label_col).alias("low"), F.count("*").alias("n"), F.sum(label_col).alias("ones"))
    n, ones = taught.agg(F.sum("n"), F.sum("ones")).first()
    if not n:
        return None, 0.5
    prior = min(0.99, max(0.01, float(ones) / n))
    first = lambda df: df.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample)
    plain = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col(id_col).isNotNull())
    positive = first(taught.where("low = 1"))
    # With labels on every document all of `taught` serve: U without positives would make the second part negative.
    for others in (plain.select(id_col).join(known.select(id_col), id_col, "left_anti"), taught):
        marks = positive.withColumn("mark", F.lit(1)).unionByName(first(others).withColumn("mark", F.lit(0)))
        one = plain.join(F.broadcast(marks), id_col).groupBy("mark", id_col).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        got = _measured(one).toArrow()  # at most 2 * sample rows
        x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, N_STATS + PAIRS)
        mark = got["mark"].to_numpy()
        if (mark == 0).any():
            break
    if not (mark == 1).any() or not (mark == 0).any():
        return None, prior
    order = np.lexsort(x.T)  # sums don't depend on the order of arrival
    x, mark = x[order], mark[order]
    return fit(x[mark == 1], x[mark == 0], prior), prior


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted), taught by the labels outside fold `held`."""
    importable(docs.sparkSession)
    known = labels.select(id_col, label_col).withColumn("__teach", id_bucket(id_col, folds) != held)
    model, prior = train(docs, known, id_col, text_col, label_col)

    def run(batches):
        for b in batches:
            for x in pieces(b, text_col):
                n = len(x[text_col])
                score = model.score(np.stack([measures(t) for t in x[text_col]])) if model else np.full(n, prior)
                yield {id_col: x[id_col], "score": score.astype(np.float64).tolist()}

    out = map_rows(docs.select(id_col, text_col), run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.select(id_col, (id_bucket(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
