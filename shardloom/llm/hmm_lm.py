"""Language-model scoring by a hidden Markov model over word classes.

Tokens are the words of the text with A-Z lower-cased (runs of characters other than U+0020 and U+0009-U+000D),
then one end token. Exact counts of all training tokens make the vocabulary. The most frequent words, HEAD at most,
are classes of their own; every other word falls in one of TAIL classes by crc32, and its probability within the
class is (c + 1) / (class total + class types + 1), unseen words sharing the extra place. STATES latent states emit
classes. The model's size is thus fixed, while counts of rare words stay in a table that is joined, never sent out
whole; words left for the join are rare by construction, so no key is hot.

Training is Baum-Welch: each task adds up expected transition and emission counts and Spark sums them by class. A text
longer than SEGMENT tokens is worked on in pieces side by side; each piece reads WARM tokens on both sides too, which
settle its states at the ends, and every token and every transition of the text is counted in just one piece. Every round runs over all training documents: at least LEAST_ROUNDS, until
one gains less than GAIN nats a token. Scores are log10 probabilities by the scaled forward recursion over each
whole text, with no cut.

Null and empty texts are just the end token. Rows repeat freely: each counts in training and gets a row. Null ids
are in fold 0. Without training rows every token has probability 1 under the base formula, (0+1)/(0+1), and the
model's score is the base score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import id_bucket, importable, map_rows, pieces, stored

HEAD, TAIL = 32_768, 4_096
STATES = 12
SEGMENT, WARM = 320, 16
LEAST_ROUNDS, GAIN = 4, 0.02
SMOOTH = 20.0
FLUSH_WORDS = 400_000
BATCH_TOKENS = 1 << 19
END = b""
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def tokens(text: str | None) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    words.append(END)
    return words


def vocabulary(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all tokens of df; the end token is the empty word."""
    importable(df.sparkSession)

    def run(batches):
        total: Counter[bytes] = Counter()
        for b in batches:
            for x in pieces(b, text_col):
                for t in x[text_col]:
                    total.update(tokens(t))
                if len(total) > FLUSH_WORDS:
                    yield {"word": [w.decode("utf-8", "surrogatepass") for w in total], "n": list(total.values())}
                    total.clear()
        yield {"word": [w.decode("utf-8", "surrogatepass") for w in total], "n": list(total.values())}

    return map_rows(df.select(text_col), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """What executors need to know of the vocabulary: at most HEAD words and TAIL totals."""

    def __init__(self, vocab: DataFrame, head: int = HEAD, tail: int = TAIL):
        n, v = vocab.agg(F.sum("n"), F.count("*")).first()
        self.n, self.v, self.tail = int(n or 0), int(v), tail
        # Counts by size, in at most a thousand steps, show from which count on there are no more than `head` words.
        step = F.floor(F.log2("n") * 16)
        sizes = vocab.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
        held, self.least = 0, 1 << 62
        for r in sizes:
            held += r["words"]
            if held > head:
                break
            self.least = r["least"]
        is_head = (F.col("n") >= self.least) | (F.col("word") == "")
        rows = sorted((r["word"].encode("utf-8", "surrogatepass"), r["n"]) for r in vocab.where(is_head).collect())
        self.index = {w: i for i, (w, _) in enumerate(rows)}
        self.counts = np.array([c for _, c in rows], np.int64)
        self.totals, self.types = np.zeros(tail, np.int64), np.zeros(tail, np.int64)
        bucket = F.crc32(F.col("word").cast("binary")) % tail
        for r in vocab.where(~is_head).groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("t")).collect():
            self.totals[r["b"]], self.types[r["b"]] = r["n"], r["t"]
        self.is_head = is_head

    @property
    def size(self) -> int:
        return len(self.counts) + self.tail

    def shares(self) -> np.ndarray:
        """Smoothed share of each class among training tokens."""
        n = np.concatenate([self.counts, self.totals + 0.5])
        return n / max(n.sum(), 1.0)

    def picklable(self) -> tuple:
        return self.index, self.counts, self.tail


def encoded(df: DataFrame, classes: Classes, id_col: str, text_col: str, fold) -> tuple[DataFrame, str]:
    """A stored table (row, id_col, held_out, n_tokens, classes, n_head, head_log, tail): tail lists the words to join, with their counts in the text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(classes.picklable())

    def run(batches):
        index, counts, tail = shared.value
        get, size, logs = index.get, len(counts), np.log10(counts + 1.0)
        for b in batches:
            for x in pieces(b, text_col):
                out = {"id": x["id"], "held_out": x["held_out"], "n_tokens": [], "classes": [], "n_head": [], "head_log": [], "tail": []}
                for t in x[text_col]:
                    words = tokens(t)
                    at = np.array([get(w, -1) for w in words], np.int32)
                    unknown = at < 0
                    known = at[~unknown]
                    rare = list(compress(words, unknown.tolist()))
                    left: Counter[bytes] = Counter(rare)
                    where = {w: size + zlib.crc32(w) % tail for w in left}
                    at[unknown] = [where[w] for w in rare]
                    out["n_tokens"].append(len(words))
                    out["classes"].append(at.astype(np.uint16).tobytes())
                    out["n_head"].append(len(known))
                    out["head_log"].append(float(logs[known].sum()))
                    out["tail"].append([{"word": w.decode("utf-8", "surrogatepass"), "tf": n} for w, n in left.items()])
                yield out

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), fold.alias("held_out"), text_col)
    rows = map_rows(source, run, f"id {kind}, held_out boolean, n_tokens bigint, classes binary, n_head bigint, head_log double, tail array<struct<word:string,tf:bigint>>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")


class Model:
    """start and inner: state shares at a text's begin and anywhere in it; step: transitions; emit: (classes, states)."""

    def __init__(self, start, inner, step, emit):
        self.start, self.inner, self.step, self.emit = (np.ascontiguousarray(x, np.float32) for x in (start, inner, step, emit))


def first_model(shares: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
    """Sticky states with perturbed shares."""
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * rng.uniform(0.2, 1.8, (len(shares), states))
    step = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(step, 0.95 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Model(even, even, step, emit / emit.sum(0))


def segments(codes: list[np.ndarray], length: int = SEGMENT, warm: int = WARM) -> tuple[np.ndarray, ...]:
    """All tokens, and each piece's begin and length with what it reads beside, where in it its own tokens begin and end, whether it begins a text; longest first."""
    flat = np.concatenate(codes)
    size = np.array([len(c) for c in codes], np.int64)
    begin = np.cumsum(size) - size
    n = -(-size // length)
    which = np.repeat(np.arange(len(codes)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    first, last = k * length, np.minimum((k + 1) * length, size[which])
    low, high = np.maximum(first - warm, 0), np.minimum(last + warm, size[which])
    order = np.argsort(low - high, kind="stable")
    return flat, (begin[which] + low)[order], (high - low)[order], (first - low)[order], (last - low)[order], (low == 0)[order]


def expected(codes: list[np.ndarray], m: Model, length: int = SEGMENT, warm: int = WARM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: (begin counts, transition counts, tokens, their state shares, log likelihoods by step)."""
    flat, a, long, own, end, begins = segments(codes, length, warm)
    top = int(long[0])
    active = np.searchsorted(-long, -np.arange(1, top + 1), side="right")
    one = np.ones(len(m.start), np.float32)
    seen, alpha, heard = [], [], []
    fit = np.zeros(top)
    now = np.where(begins[:, None], m.start, m.inner)
    for t in range(top):
        n = active[t]
        c = flat[a[:n] + t]
        e = m.emit[c]
        now = (now if t == 0 else now[:n] @ m.step) * e
        s = np.maximum(now @ one, np.float32(1e-30))
        mine = (own[:n] <= t) & (t < end[:n])
        fit[t] = np.log(s).sum(where=mine, dtype=np.float64)
        s = (1 / s)[:, None]
        now *= s
        e *= s
        seen.append(c)
        alpha.append(now)
        heard.append(e)
    # alpha and beta are scaled alike, so their product is the states' share; it takes alpha's place.
    moves = np.zeros_like(m.step, np.float64)
    start = np.zeros(len(m.start))
    counted: list[np.ndarray | None] = [None] * top
    beta = np.ones_like(alpha[-1])
    for t in range(top - 1, -1, -1):
        n = active[t]
        mine = (own[:n] <= t) & (t < end[:n])
        whole = bool(mine.all())
        share = alpha[t] * beta
        if t:
            back = heard[t]
            back *= beta
            moves += alpha[t - 1][:n].T @ (back if whole else back * mine[:, None])
            beta = np.ones_like(alpha[t - 1])
            np.matmul(back, m.step.T, out=beta[:n])
        else:
            start = share[begins[:n] & (own[:n] == 0)].sum(0, dtype=np.float64)
        alpha[t] = share if whole else share[mine]
        counted[t] = seen[t] if whole else seen[t][mine]
    return start, moves * m.step, np.concatenate(counted), np.concatenate(alpha), fit


def _added(code: np.ndarray, share: np.ndarray, total: np.ndarray) -> None:
    """Adds each token's state shares to its class."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    total[code[first]] += np.add.reduceat(share[order], first, axis=0)


def _grouped(batch: list[bytes], most: int = BATCH_TOKENS):
    part, n = [], 0
    for x in batch:
        c = np.frombuffer(x, np.uint16)
        part.append(c)
        n += len(c)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def round_of(rows: DataFrame, model: Model, shares: np.ndarray) -> tuple[Model, float]:
    """One Baum-Welch round over rows (classes): counts are added up by task, then by Spark. Also the mean log likelihood of a token before it."""
    spark, states = rows.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(model)
    names = [f"s{k}" for k in range(states)]

    def run(batches):
        m = shared.value
        emit, moves, start = np.zeros(m.emit.shape, np.float64), np.zeros((states, states)), np.zeros(states)
        fit = np.zeros(states)  # the first place holds the log likelihood
        for b in batches:
            for part in _grouped(b["classes"]):
                first, move, code, share, logs = expected(part, m)
                fit[0] += logs.sum()
                start += first
                moves += move
                _added(code, share, emit)
        at = np.flatnonzero(emit.any(1))
        yield {"class": at.tolist(), **{name: emit[at, k].tolist() for k, name in enumerate(names)}}
        extra = np.concatenate([moves, start[None], fit[None]])
        yield {"class": [-1 - k for k in range(states + 2)], **{name: extra[:, k].tolist() for k, name in enumerate(names)}}

    schema = "class int, " + ", ".join(f"{n} double" for n in names)
    got = map_rows(rows.select("classes"), run, schema).groupBy("class").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    shared.destroy()
    if not got.num_rows:
        return model, 0.0
    at = got["class"].to_numpy()
    value = np.stack([got[n].to_numpy() for n in names], axis=1)
    emit, extra = np.zeros(model.emit.shape), np.zeros((states + 2, states))
    emit[at[at >= 0]] = value[at >= 0]
    extra[-1 - at[at < 0]] = value[at < 0]
    occupied = emit.sum(0)
    step = extra[:states] + 0.1
    start = extra[states] + 0.1
    inner = occupied + 0.1
    emit = (emit + SMOOTH * shares[:, None]) / (occupied + SMOOTH)
    return Model(start / start.sum(), inner / inner.sum(), step / step.sum(1, keepdims=True), emit), float(extra[states + 1, 0] / max(occupied.sum(), 1.0))


def baum_welch(rows: DataFrame, shares: np.ndarray, states: int = STATES, burn_in: int | None = None, gain: float = GAIN) -> Model:
    """rows: (classes) of the training documents, all of them in every round."""
    model, before, done = first_model(shares, states), -np.inf, 0
    least = LEAST_ROUNDS if burn_in is None else burn_in
    while True:
        model, fit = round_of(rows, model, shares)
        done += 1
        if done >= least and fit - before < gain:
            return model
        before = fit


def forward(codes: list[np.ndarray], m: Model) -> np.ndarray:
    """log10 probability of each sequence of classes, whole: the scaled forward recursion, all sequences in step."""
    size = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-size, kind="stable")
    flat, begin = np.concatenate(codes), np.cumsum(size) - size
    a, long = begin[order], size[order]
    total = np.zeros(len(codes))
    active = np.searchsorted(-long, -np.arange(1, int(long[0]) + 1), side="right")
    now = np.broadcast_to(m.start, (len(codes), len(m.start)))
    for t, n in enumerate(active.tolist()):
        now = (now if t == 0 else now[:n] @ m.step) * m.emit[flat[a[:n] + t]]
        s = np.maximum(now.sum(1), 1e-30)
        now = now / s[:, None]
        total[:n] += np.log10(s)
    out = np.empty(len(codes))
    out[order] = total
    return out


def scores(rows: DataFrame, model: Model) -> DataFrame:
    """(row, class_score): the hidden Markov part of the score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            at = 0
            for part in _grouped(b["classes"], 4 * BATCH_TOKENS):
                yield {"row": b["row"][at : at + len(part)], "class_score": forward(part, shared.value).tolist()}
                at += len(part)

    return map_rows(rows.select("row", "classes"), run, "row bigint, class_score double")


def tail_sums(rows: DataFrame, vocab: DataFrame, classes: Classes) -> DataFrame:
    """(row, tail_known, tail_log, tail_score) from the words that are not classes of their own."""
    spark = rows.sparkSession
    words = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    rare = vocab.where(~classes.is_head)
    joined = words.join(rare, "word", "left").select("row", "tf", F.coalesce("n", F.lit(0)).alias("n"), (F.crc32(F.col("word").cast("binary")) % classes.tail).cast("int").alias("b"))
    width = spark.createDataFrame([(i, float(np.log10(n + t + 1))) for i, (n, t) in enumerate(zip(classes.totals.tolist(), classes.types.tolist()))], "b int, w double")
    joined = joined.join(F.broadcast(width), "b")
    log = F.log10(F.col("n") + 1)
    return joined.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("tail_known"), F.sum(F.col("tf") * log).alias("tail_log"), F.sum(F.col("tf") * (log - F.col("w"))).alias("tail_score"))


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = df.sparkSession
    importable(spark)
    fold = id_bucket(id_col, folds) == held
    vocab, _ = stored(vocabulary(df.where(~fold), text_col), "vocabulary")
    classes = Classes(vocab)
    rows, _ = encoded(df, classes, id_col, text_col, fold)
    model = baum_welch(rows.where("not held_out").select("classes"), classes.shares()) if classes.n else None
    out = rows.drop("classes", "tail").join(tail_sums(rows, vocab, classes), "row", "left")
    if model:
        out = out.join(scores(rows, model), "row")
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    base = F.col("head_log") + part("tail_log") - F.col("n_tokens") * F.lit(float(np.log10(classes.n + classes.v + 1)))
    score = F.col("class_score") + part("tail_score") if model else base
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_head") + part("tail_known")).alias("n_known"), F.lit(classes.n).cast("bigint").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
