"""SimHash near-duplicates by Golay-code fuzzy hashing.

A-Z are lower-cased; words are runs of characters other than U+0020 and U+0009-U+000D. A text's fingerprint has bit b set if more than half of its word shingles' hashes have it (XXH64 of the UTF-8
shingle, seed 42; shingles of SHINGLE words, repeats included; fewer words are one shingle; a text without words,
null or empty, has fingerprint zero and links like any other). Fingerprints within RADIUS bits are linked, and a
component is what links reach.

Candidate search is exact. The 64 bits are three segments (22, 21, 21 bits), each padded to 23 bits for the perfect
binary Golay code (23, 12), in which every vector is within 3 of exactly one codeword. Four errors over three
segments leave, for some ordered pair of segments, one of two cases (pigeonhole):

* 0 and at most 2 errors: keys are the first segment as it is, and every codeword index within 4 of the second.
  Two vectors at distance 2 share such a codeword: the nearest to a vector midway between them.
* 1 and 1 errors: keys are all pairs of codeword indices within 4 of the two segments; the nearest codeword of x
  is within 4 of anything at distance 1 from x. These keys have 24 bits. Beyond LONG distinct fingerprints, where so
  many would meet under each, the third segment, which then has 2 errors at most, adds its codeword indices within 4:
  five times the keys, of 36 bits, for the same links.

Equal fingerprints collapse before that, so copies are never paired. Fingerprints that meet under a key form a
bucket; buckets are read as a sorted stream. Buckets up to CHUNK are searched whole; larger ones are cut into chunks by hash and every pair of chunks
is searched as a bucket of its own, so no task holds more than two chunks. A search keeps a spanning forest of the
bucket's links, never its pairs: from each reached fingerprint all not yet reached ones within RADIUS are taken at
once. Components come from large-star and small-star steps over the forest's edges, stored in the shared folder.
Minima by key are stored before they are joined to the rows they come from, so that both sides are plain shuffles and
Spark's skew join can split the key of a large component, of a hub or of the empty text.

Empty tables give empty results; very long texts are read whole, their hashes added up in bounded pieces.

Rows with a null id have a fingerprint, but no id to give; their component is that of the others with their
fingerprint. Repeated rows give repeated results. Other columns are left alone.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import drop_path, importable, map_rows, pieces, scratch, stored

SHINGLE = 4
RADIUS = 4
CHUNK = 4_096
LONG = 1 << 27
#: Fingerprints whose keys one task makes.
KEYED = 1 << 15
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints."""
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        if not words:
            continue
        if len(words) <= shingle:
            hashes = np.array([digest(b" ".join(words), 42)], np.uint64)
        else:
            text = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[: -shingle] + 1])
            hashes = np.array([digest(text[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64)
        out[i] = majority(hashes)
    return out


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codewords by index; by syndrome: the nearest codeword's error; all errors of weight <= 4, and where a syndrome's begin."""
    errors = [0]
    bits = [1 << i for i in range(23)]
    from itertools import combinations

    for weight in range(1, 5):
        errors += [sum(c) for c in combinations(bits, weight)]
    errors = np.array(errors, np.int64)
    of = syndrome(errors)
    weight = np.bitwise_count(errors.astype(np.uint64)).astype(np.int64)
    order = np.lexsort((weight, of))
    first = np.searchsorted(of[order], np.arange(2049))
    words = np.zeros(4096, np.int64)
    for i in range(12):
        words ^= np.where((np.arange(4096) >> i) & 1, GENERATOR << i, 0)
    return words, errors[order][first[:-1]], errors[order], first


def syndrome(vectors: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit vector modulo the generator."""
    v = vectors.copy()
    for bit in range(22, 10, -1):
        v = np.where((v >> bit) & 1, v ^ (GENERATOR << (bit - 11)), v)
    return v


@cache
def _index_of() -> np.ndarray:
    out = np.full(1 << 23, -1, np.int16)
    out[golay()[0]] = np.arange(4096)
    return out


def nearest(vectors: np.ndarray) -> np.ndarray:
    """Index of the only codeword within 3."""
    return _index_of()[vectors ^ golay()[1][syndrome(vectors)]].astype(np.int64)


def within4(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which vector, codeword index) of all codewords within 4."""
    _, _, errors, first = golay()
    s = syndrome(vectors)
    n = first[s + 1] - first[s]
    row = np.repeat(np.arange(len(vectors)), n)
    at = np.repeat(first[s] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return row, _index_of()[vectors[row] ^ errors[at]].astype(np.int64)


def keys(prints: np.ndarray, long: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(which print, key), without repeats of a pair. long: pair keys with the third segment."""
    seg = [((prints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    wide = [within4(s) for s in seg]
    rows, found = [], []
    for i in range(3):
        for j in range(3):
            if i != j:  # 0 errors in i, up to 2 in j
                row, cw = wide[j]
                rows.append(row)
                found.append(((i * 3 + j) << 40) | (seg[i][row] << 12) | cw)
    for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):  # 1 error in each; the pair of nearest codewords is among those looked up
        row, pair = _paired(*wide[i], *wide[j], len(prints))
        if long:
            row, pair = _paired(row, pair, *wide[k], len(prints))
        rows.append(row)
        found.append((16 + i * 3 + j) << 40 | pair)
    return np.concatenate(rows), np.concatenate(found)


def _paired(ra: np.ndarray, ca: np.ndarray, rb: np.ndarray, cb: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index of a << 12 | index of b) of all pairs of codewords of the same row; rows ascend."""
    nb = np.bincount(rb, minlength=n)
    begin, k = np.cumsum(nb) - nb, nb[ra]
    a = np.repeat(np.arange(len(ra)), k)
    b = np.repeat(begin[ra] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    return ra[a], ca[a] << 12 | cb[b]


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct prints."""
    left, edges = prints.copy(), []
    reached: list[np.ndarray] = []
    while len(left):
        if not reached:
            front, left = left[:1], left[1:]
            reached.append(front)
            continue
        front = reached.pop()
        for x in front:
            if not len(left):
                break
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                got = left[near]
                edges += [(int(x), int(y)) for y in got]
                reached.append(got)
                left = left[~near]
    return edges


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, long: int = LONG) -> tuple[DataFrame, str]:
    """(a, b) among distinct fingerprints in column `print` (signed long): edges of spanning forests that together join all that is linked. Also the path of a scratch table to drop once they are read."""
    if radius > RADIUS:
        raise ValueError(f"the keys find links of at most {RADIUS} bits")
    importable(prints.sparkSession)
    total = prints.count()
    is_long = total > long

    def emit(batches):
        for b in batches:
            x = np.array(b["print"], np.int64)
            for k in range(0, len(x), 500):
                part = x[k : k + 500]
                row, key = keys(part.view(np.uint64), is_long)
                yield {"key": pa.array(key), "print": pa.array(part[row])}

    # A print is 8 bytes and its keys thousands, so tasks are cut by prints, not by the bytes of the input.
    dealt = prints.select("print").repartition(max(1, -(-total // (KEYED >> 2 if is_long else KEYED))), "print")
    keyed = map_rows(dealt, emit, "key bigint, print bigint")
    heavy, path = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "heavy")
    place = F.lit(0).cast("int")
    buckets = keyed.select("key", place.alias("i"), place.alias("j"), "print")
    if not heavy.isEmpty():
        parts = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
        met = keyed.join(heavy, "key", "left").select("key", parts.alias("parts"), "print")
        own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
        met = met.select("key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "print")
        buckets = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print")

    def search(batches):
        held = None
        for b in batches:
            rows = np.stack([b.column(i).to_numpy() for i in range(4)])
            held = rows if held is None else np.concatenate([held, rows], axis=1)
            change = np.flatnonzero((held[:3, 1:] != held[:3, :-1]).any(0))
            if len(change):  # the last bucket may go on in the next batch
                cut = int(change[-1]) + 1
                yield _linked(held[:, :cut], radius)
                held = held[:, cut:]
        if held is not None:
            yield _linked(held, radius)

    dealt = buckets.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(search, "a bigint, b bigint").distinct(), path


def _linked(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links inside each run of equal (key, i, j): pairs of two in one go, a spanning forest of larger buckets."""
    prints = rows[3].view(np.uint64) if rows.flags.c_contiguous else np.ascontiguousarray(rows[3]).view(np.uint64)
    first = np.concatenate([[0], np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1])
    size = np.diff(np.append(first, rows.shape[1]))
    at = first[size == 2]
    at = at[(np.bitwise_count(prints[at] ^ prints[at + 1]) <= radius) & (prints[at] != prints[at + 1])]
    a, b = [prints[at]], [prints[at + 1]]
    for k in np.flatnonzero(size > 2).tolist():
        bucket = prints[first[k] : first[k] + size[k]]
        if size[k] < 64 and not (np.bitwise_count(bucket ^ bucket[:, None]) <= radius).sum() > size[k]:
            continue  # nothing here is near anything else
        edges = np.array(forest(np.unique(bucket), radius), np.uint64).reshape(-1, 2)
        a.append(edges[:, 0])
        b.append(edges[:, 1])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that edges (a, b) reach, for every node that has an edge. Alternates large-star and small-star steps."""
    spark = edges.sparkSession
    now, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_path = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, large_path = stored(large.where("a <> b").distinct(), "large")
        least, least_path = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        step = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after, new_path = stored(step, "edges")
        state = after.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        for old in (path, low_path, large_path, least_path):
            drop_path(spark, old)
        now, path = after, new_path
        if tuple(state) == before:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        before = tuple(state)


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, more: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, print as a signed long), and the columns `more` of df as they are."""
    importable(df.sparkSession)

    def run(batches):
        for b in batches:
            for x in pieces(b, text_col):
                yield {id_col: x[id_col], "print": fingerprints(x[text_col], shingle).view(np.int64).tolist(), **{c: x[c] for c in more}}

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (id_col, *more))
    return map_rows(df.select(id_col, text_col, *more), run, f"{kinds}, print bigint")


def _classified(df: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, chunk: int = CHUNK, more: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *more, print, root, component_id): root is a fingerprint that stands for the component, whatever the ids are."""
    docs, _ = stored(fingerprinted(df, id_col, text_col, more=more), "prints")
    distinct = docs.groupBy("print").agg(F.min(id_col).alias("first"))
    distinct, distinct_path = stored(distinct, "distinct")
    edges, keys_path = links(distinct, radius, chunk)
    roots, roots_path = stored(components(edges), "roots")
    drop_path(df.sparkSession, keys_path)
    classes = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    classes, classes_path = stored(classes, "classes")
    least, least_path = stored(classes.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    by_print, _ = stored(classes.join(least, "root").select("print", "root", "component_id"), "by-print")
    for path in (distinct_path, roots_path, classes_path, least_path):
        drop_path(df.sparkSession, path)
    return docs.join(by_print, "print")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(id_col, fingerprint, component_id): component_id is the smallest id of the component."""
    return _classified(df, id_col, text_col, radius, chunk).select(id_col, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


#: Two hashes of the text, 128 bits: with the id they name a row, so rows that share an id, or have none, stay apart.
_KEY = ("__a", "__b")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with all their columns, exactly one of each component: that of the smallest id, null ids last, then of the smallest text key. Rows that repeat that id and text leave one, the least by all columns."""
    keyed = df.withColumns(dict(zip(_KEY, (F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)))))
    same = _classified(keyed, id_col, text_col, more=_KEY).groupBy("root", id_col, *_KEY).agg(F.count("*").alias("__n"))
    best = same.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *_KEY, "__n")).alias("k"))
    keep, _ = stored(best.select(F.col("k.id").alias("__id"), F.col("k.__a").alias("__ka"), F.col("k.__b").alias("__kb"), F.col("k.__n").alias("__n")), "keep")
    # The ids grow with the documents, so they are never broadcast: the same sort-merge join at every size.
    met = keyed[id_col].eqNullSafe(keep["__id"]) & (keyed["__a"] == keep["__ka"]) & (keyed["__b"] == keep["__kb"])
    rows = keyed.join(keep.hint("merge"), met)
    once = rows.where("__n = 1").select(*df.columns)
    if keep.where("__n > 1").isEmpty():
        return once
    row = F.struct(*df.columns)
    least = rows.where("__n > 1").groupBy(id_col, *_KEY).agg(F.min_by(row, row.cast("string")).alias("__row"))
    return once.unionByName(least.select("__row.*"))
