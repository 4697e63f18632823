"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed character trigrams (BUCKETS buckets; letters lower-cased, every other
character is a word edge, and each letter is the middle of one trigram), counted over all training documents. A
document is a mixture of languages: expectation-maximisation estimates the proportions from the trigrams'
likelihoods, and the language set is chosen by penalised likelihood (each further language must gain more than
PENALTY * log(trigrams)). Sets grow by the full mixture's proportions, up to all learned languages, for as long as a
larger set can still win: the full mixture's likelihood plus its duality gap bounds what any set reaches. The prediction is the largest proportion of the chosen set.

Null texts and texts without a letter are `und` with score 0; so is everything if nothing was learned. Ties go to
the smaller language name. Texts are read whole. Repeated rows count, and are answered, each. Other columns are not
looked at, whatever their names; a table without rows has none in the result.

The model, which every executor gets, has at most CELLS numbers: with more than CELLS / BUCKETS languages the buckets
are joined, two by two, until it fits. Any number of languages is learned.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import id_bucket, importable, map_rows, pieces

BUCKETS = 1 << 16
ALPHA = 0.05
PENALTY = 3.0
STEPS, SET_STEPS = 8, 5
CELLS = 1 << 24
CHUNK_CHARS = 2 << 20


def folds_of(languages: int) -> int:
    """How often the buckets are halved for so many languages."""
    k = 0
    while (BUCKETS >> k) * languages > CELLS and BUCKETS >> k > 256:
        k += 1
    return k


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(which text, bucket) of every trigram."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[np.minimum(code, 65535)]
    high = np.flatnonzero(code > 65535)
    if len(high):
        is_letter[high] = [chr(c).isalpha() for c in code[high].tolist()]
    code = np.where(is_letter, code, 32).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    key = code[at - 1] | code[at] << np.uint64(21) | code[at + 1] << np.uint64(42)
    bucket = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    ends = np.cumsum([len(t) + 2 for t in low])
    return np.searchsorted(ends, at, side="right"), bucket.astype(np.int64)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name, and P(bucket | language) as (BUCKETS, languages), from all rows of df with a language."""
    importable(df.sparkSession)

    def run(batches):
        total: dict[str, np.ndarray] = {}

        def flush():
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield {"lang": [lang] * len(at), "bucket": at.tolist(), "n": n[at].tolist()}

        for b in batches:
            for x in pieces(b, text_col, CHUNK_CHARS):
                of, bucket = trigrams(x[text_col])
                names = sorted(set(x[lang_col]))
                which = np.array([names.index(v) for v in x[lang_col]], np.int64)[of]
                for i, name in enumerate(names):
                    total[name] = total.get(name, 0) + np.bincount(bucket[which == i], minlength=BUCKETS)
            if len(total) > 64:
                yield from flush()
                total.clear()
        yield from flush()

    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias(lang_col), text_col)
    fold = folds_of(rows.select(lang_col).distinct().count())
    counted = map_rows(rows, run, "lang string, bucket int, n bigint")
    found = counted.groupBy("lang", F.shiftright("bucket", fold).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    names, which = np.unique(np.array(found["lang"].to_pylist(), object), return_inverse=True) if found.num_rows else (np.array([], object), [])
    counts = np.full((BUCKETS >> fold, len(names)), ALPHA)
    counts[found["bucket"].to_numpy(), which] += found["n"].to_numpy()
    return [str(x) for x in names], (counts / counts.sum(0, keepdims=True)).astype(np.float32)


def _em(share: np.ndarray, p: np.ndarray, n: np.ndarray, first: np.ndarray, of: np.ndarray, total: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        r = p * share[of]
        r *= (n / np.maximum(r.sum(1), 1e-30))[:, None]
        share = np.add.reduceat(r, first, axis=0) / total[:, None]
    return share


def infer(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chosen, share): language index (-1: none) and proportions of the chosen set, for each text."""
    size = table.shape[1]
    chosen, shares = np.full(len(texts), -1, np.int64), np.zeros((len(texts), size))
    of, bucket = trigrams(texts)
    if not len(of) or not size:
        return chosen, shares
    buckets = len(table)
    key, n = np.unique(of * buckets + (bucket * buckets // BUCKETS), return_counts=True)
    texts_of = key // buckets
    if len(key) * size > CELLS and texts_of[0] != texts_of[-1]:  # by halves, so that little is held at once; one text has at most CELLS
        half = len(texts) // 2
        return tuple(np.concatenate(x) for x in zip(infer(texts[:half], table), infer(texts[half:], table)))
    docs, first = np.unique(texts_of, return_index=True)
    p, n = table[key % buckets].astype(np.float64), n.astype(np.float64)
    total = np.add.reduceat(n, first)
    local = np.repeat(np.arange(len(docs)), np.diff(np.append(first, len(key))))
    single = np.add.reduceat(n[:, None] * np.log(p), first, axis=0)
    share = _em(np.full((len(docs), size), 1 / size), p, n, first, local, total, STEPS)
    best, score = np.zeros_like(share), single.max(1)
    best[np.arange(len(docs)), single.argmax(1)] = 1.0
    # The likelihood is concave in the shares, so no mixture exceeds that of `share` by more than the gap.
    mixed = np.maximum((p * share[local]).sum(1), 1e-30)
    gap = np.add.reduceat(p * (n / mixed)[:, None], first, axis=0).max(1) - total
    reach, cost = np.add.reduceat(n * np.log(mixed), first) + gap, PENALTY * np.log(total + 1)
    open_ = np.arange(len(docs))
    ranks = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    sub = local
    for k in range(2, size + 1):
        able = reach[open_] - (k - 1) * cost[open_] > score[open_]
        if not able.all():
            mask, open_ = able[sub], open_[able]
            p, n = p[mask], n[mask]
            _, first = np.unique(sub[mask], return_index=True)
            sub = np.repeat(np.arange(len(open_)), np.diff(np.append(first, len(n))))
        if not len(open_):
            break
        start = np.where(ranks[open_] < k, np.maximum(share[open_], 1e-3), 0)
        got = _em(start / start.sum(1, keepdims=True), p, n, first, sub, total[open_], SET_STEPS)
        fit = np.add.reduceat(n * np.log(np.maximum((p * got[sub]).sum(1), 1e-30)), first) - (k - 1) * cost[open_]
        better = fit > score[open_]
        score[open_[better]] = fit[better]
        best[open_[better]] = got[better]
    chosen[docs], shares[docs] = best.argmax(1), best
    # A lone language's score is still its proportion in the full mixture.
    lone = best.max(1) >= 1.0
    shares[docs[lone], chosen[docs[lone]]] = np.minimum(1.0, share[lone, best[lone].argmax(1)])
    return chosen, shares


def predict(df: DataFrame, names: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, languages): languages lists the chosen set with its proportions."""
    spark = df.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            for x in pieces(b, text_col, CHUNK_CHARS):
                chosen, shares = infer(x[text_col], shared.value)
                yield {
                    id_col: x[id_col],
                    "lang_pred": [names[i] if i >= 0 else "und" for i in chosen.tolist()],
                    "score": [float(min(1.0, s[i])) if i >= 0 else 0.0 for s, i in zip(shares, chosen.tolist())],
                    "languages": [" ".join(f"{names[k]}:{s[k]:.3f}" for k in np.argsort(-s, kind="stable") if s[k] >= 0.0005) for s in shares],
                }

    return map_rows(df.select(id_col, text_col), run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double, languages string")


def identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The model of the rows outside fold `held`, applied to all."""
    fold = id_bucket("doc_id", folds) == held
    names, table = train(docs.where(~fold))
    found = predict(docs, names, table)
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "languages")
