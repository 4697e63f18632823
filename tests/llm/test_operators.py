"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.llm import byte_bpe, decontaminate, hmm_lm, html_text, language_id, pii, pu_quality, quality_rules, range_coder, simhash, token_output

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977} été" for i in range(30_000))
ODD = [None, "", " ", "\n\n", "a", "é" * 300, "x" * 70_000, LONG, "same text here", "same text here", "mail a.b@c.example +1 (017) 555-7713 4111 1111 1111 1111 10.0.0.255"]


def frame(spark, texts, **more):
    """Documents with an id for each text, a clashing extra column, and a null id at the end."""
    rows = [(i, t, "x", *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    names = ["doc_id", "text", "n_tokens", *more]
    kinds = {"lang": "string"}
    return spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if n == 'doc_id' else kinds.get(n, 'string')}" for n in names)).repartition(3)


def got(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# -- 1 --


def blocks_of(spark, ids, bits=16):
    raw = np.array(ids, "<u2" if bits == 16 else "<u4").tobytes()
    df = spark.createDataFrame([(raw, bits)], "ids binary, bits int")
    return bytes(df.select(range_coder.blocks(spark, F.col("ids"), F.col("bits"))).head()[0])


def ids_of(spark, coded, sizes, bits=16):
    df = spark.createDataFrame([(bytearray(coded), bits, sizes)], "blocks binary, bits int, sizes array<bigint>")
    return df.select(range_coder.documents(spark, F.col("blocks"), F.col("bits"), F.col("sizes"), True)).head()[0]


def split_blocks(coded):
    out, at = [], 0
    while at < len(coded):
        n, crc, size = np.frombuffer(coded[at : at + 12], "<u4").tolist()
        out.append((n, crc, coded[at : at + 12 + size]))
        at += 12 + size
    return out


def test_range_coder_round_trip(spark):
    rng = np.random.default_rng(3)
    runs = np.repeat(rng.integers(0, 9, 4_000), rng.integers(1, 60, 4_000))
    cases = [[], [0], [65535], [7] * 70_000, list(range(65536)) * 2, rng.integers(0, 65536, 140_000).tolist(), runs.tolist(), (rng.zipf(1.3, 200_000) % 50_000).tolist()]
    for ids in cases:
        coded = blocks_of(spark, ids)
        assert [n for n, _, _ in split_blocks(coded)] == [min(range_coder.BLOCK, len(ids) - k) for k in range(0, len(ids), range_coder.BLOCK)]
        (found,) = ids_of(spark, coded, [len(ids)])
        assert found["ids"] == ids and found["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    wide = rng.integers(0, 1 << 18, 9_000).tolist()
    assert ids_of(spark, blocks_of(spark, wide, 18), [9_000], 18)[0]["ids"] == wide


def test_range_coder_blocks_are_independent_and_checked(spark):
    ids = (np.random.default_rng(1).zipf(1.3, 200_000) % 50_000).tolist()
    coded = blocks_of(spark, ids)
    done = split_blocks(coded)
    for k, (n, crc, one) in enumerate(done):
        own = ids[k * range_coder.BLOCK : (k + 1) * range_coder.BLOCK]
        assert crc == zlib.crc32(np.array(own, "<u4").tobytes())
        assert ids_of(spark, one, [n])[0]["ids"] == own
    n, _, one = done[1]
    for place in (4, 20, len(one) // 2):
        with pytest.raises(Exception, match="block"):
            ids_of(spark, one[:place] + bytes([one[place] ^ 255]) + one[place + 1 :], [n])
    with pytest.raises(Exception, match="less ids"):
        ids_of(spark, one, [n + 1])


def test_ids_of_texts_take_less_than_order_0(spark):
    """Against the entropy of the ids' counts over all texts, which a static order-0 code can't beat."""
    path = "/root/testdata/sf0.001/documents.parquet"
    texts = [r["text"] for r in spark.read.parquet(path).orderBy("doc_id").collect()]
    ids = np.concatenate(token_output.words(WORD_BPE).encode(texts))
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(blocks_of(spark, ids)) * 8 < -(share * np.log2(share)).sum() * len(ids)


def test_words_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    parts = ["a", "B", "é", "É", "ß", "İ", "ǅ", "Σ", "'s", "'", "’", "...", "!", "-", "1", "٣", "漢", " ", " ", "\n", "\x1c", "<|endoftext|>", "$", "ll", "😀", "\u0301", "h\u0331", "H\u0331", "\u1e97", "ﬁ", "K", "×", "÷", "Þ", "ª", "²", "\x85", "\x00", "ÿ", "Ÿ", "abcdefghijklmnopqrs", "a" * 40]
    rng = random.Random(5)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3_000)]
    for text, ids in zip(texts, token_output.words(WORD_BPE).encode(texts)):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text


def test_token_output(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    texts = [*ODD, "a " * 1_200_000, "after a text that fills a segment"]
    found = got(token_output.round_trip(frame(spark, texts), WORD_BPE))
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (found[i]["start"], found[i]["n_tokens"]) == (start, len(ids))
        assert found[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_output.round_trip(frame(spark, []), WORD_BPE).count() == 0


def test_token_files_give_the_ids_back(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    token_output.write(frame(spark, ODD), WORD_BPE, str(tmp_path / "ids"))
    found = {r["id"]: r["ids"] for r in token_output.read_ids(spark, str(tmp_path / "ids")).collect()}
    assert found == {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(ODD)}


# -- 2 --


def test_hmm(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "LEAST_ROUNDS", 2)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B", "c", "dd"] if i % 2 else ["x", "y", "z"]) for _ in range(rng.randint(0, 40))) for i in range(80)] + [None, "", "unseen word"]
    found = got(hmm_lm.scored(frame(spark, texts)))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    c = Counter(w for i, t in enumerate(texts) if not held[i] for w in hmm_lm.tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        toks = hmm_lm.tokens(t)
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(toks), sum(c[w] > 0 for w in toks), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks), rel_tol=1e-9)
        assert r["score"] < 0
    some = [i for i in range(80) if held[i]]
    assert sum(found[i]["score"] for i in some) > sum(found[i]["base_score"] for i in some)


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    share = rng.random(7)
    m = hmm_lm.first_model(share / share.sum(), 3)
    codes = [rng.integers(0, 7, n) for n in (5, 1, 3)]
    for x, y in zip(codes, hmm_lm.forward(codes, m)):
        total = 0.0
        for path in np.ndindex(*[3] * len(x)):
            p = m.start[path[0]] * m.emit[x[0], path[0]]
            for a, b, c in zip(path, path[1:], x[1:]):
                p *= m.step[a, b] * m.emit[c, b]
            total += float(p)
        assert math.isclose(y, math.log10(total), rel_tol=1e-4)
    start, moves, seen, share, _ = hmm_lm.expected([codes[0]], m)
    assert math.isclose(moves.sum(), 4, rel_tol=1e-4) and math.isclose(start.sum(), 1, rel_tol=1e-4) and np.allclose(share.sum(1), 1, atol=1e-4)


def test_baum_welch_round_against_enumeration():
    """Expected counts of a short text over all state paths."""
    import itertools

    m = hmm_lm.first_model(np.array([0.5, 0.3, 0.2]), 2)
    x = [0, 2, 1, 1, 0]
    start, moves, share, total = np.zeros(2), np.zeros((2, 2)), np.zeros((len(x), 2)), 0.0
    for path in itertools.product(range(2), repeat=len(x)):
        p = float(m.start[path[0]] * m.emit[x[0], path[0]])
        for a, b, c in zip(path, path[1:], x[1:]):
            p *= float(m.step[a, b] * m.emit[c, b])
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for t, k in enumerate(path):
            share[t, k] += p
    got_start, got_moves, seen, got_share, fit = hmm_lm.expected([np.array(x)], m)
    assert np.allclose(got_start, start / total, atol=1e-4) and np.allclose(got_moves, moves / total, atol=1e-4)
    assert seen.tolist() == x and np.allclose(got_share, share / total, atol=1e-4)
    assert math.isclose(fit.sum(), math.log(total), rel_tol=1e-4)


def test_pieces_of_long_texts_count_what_whole_texts_do():
    rng = np.random.default_rng(5)
    share = rng.random(40)
    m = hmm_lm.first_model(share / share.sum(), 4)
    codes = [rng.integers(0, 40, n) for n in (1, 700, 64, 65, 3)]
    pieces = hmm_lm.expected(codes, m, 64, 24)
    whole = hmm_lm.expected(codes, m, 10_000, 0)
    assert sorted(pieces[2].tolist()) == sorted(whole[2].tolist()) and math.isclose(pieces[1].sum(), sum(len(c) - 1 for c in codes), rel_tol=1e-4)
    assert np.allclose(pieces[0], whole[0], atol=1e-2) and np.allclose(pieces[1], whole[1], rtol=0.02, atol=0.3)
    assert math.isclose(pieces[4].sum(), whole[4].sum(), rel_tol=1e-3)


def test_hmm_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")
    r = hmm_lm.scored(df).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)
    assert hmm_lm.scored(df.limit(0)).count() == 0


# -- 3 --


def brute_contaminated(texts, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            x = words(item)
            n = min(10, len(x))
            for k in range(max(1, len(x) - 9) if x else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == x[k : k + n]:
                        hit.update(range(i, i + n))
                        names.add(str(name))
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("most", [100_000, 3])
def test_decontaminate(spark, most):
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "été", "x1", "z"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 10, 12, 14])))) for i in range(12)] + [(50, None), (51, "!!"), (52, "alpha beta"), (53, "alpha beta")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)] + [f"{items[2][1]}; {items[3][1]}. {items[2][1]}", None, "", "alpha, BETA", "alpha, BETA"]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = got(decontaminate.report(decontaminate.matches(frame(spark, texts), benchmark, block_windows=most)))
    for i, expected in enumerate(brute_contaminated(texts, items)):
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == expected
    kept = {r["doc_id"] for r in decontaminate.clean(frame(spark, texts), benchmark, block_windows=most).collect()}
    assert kept == {i for i in range(len(texts)) if not found[i]["contaminated"]}


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    r = got(decontaminate.report(decontaminate.matches(frame(spark, ["a b"]), none)))
    assert (r[0]["n_words"], r[0]["contaminated"], r[0]["items_sha256"]) == (2, False, hashlib.sha256(b"").hexdigest())
    assert decontaminate.matches(frame(spark, []), none).count() == 0


# -- 4 --


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="a.@-1290+ ()\né", max_size=40))
def test_pii_patterns(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_pii(spark):
    rng = random.Random(4)
    lines = [f"call +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} or mail jo.{i}@mail{i % 9}.example.com from 10.0.{i}.7 with {i * 7919:06d} things" for i in range(60)]
    texts = [*ODD, *lines, "9" * 50_000, "mail jo.5@mail5.example.com again jo.5@mail5.example.com"]
    found = got(pii.find(frame(spark, texts)))
    for i, t in enumerate(texts):
        base = brute_pii(t or "")
        assert found[i]["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(filter(None, pii.written(base).split(","))) <= set(found[i]["spans"].split(","))
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
    out = got(pii.redact(frame(spark, texts)))
    assert out[11]["text"].startswith("call <phone> or mail <email> from <ip>") and out[8]["text"] == "same text here" and out[0]["text"] is None
    assert pii.find(frame(spark, [])).count() == 0


def test_marginals_follow_skip_edges():
    field = pii.Field(np.zeros((pii.N_FEATURES, 5)), np.zeros((5, 5)), np.full(5, 4.0))
    g = pii.Graph(["x +1 (017) 555-7713 then 555-7713 and 999"])
    p = pii.marginals(g, field)
    free = [i for i in range(len(g.labels)) if g.labels[i] == 0]
    assert p[free[0], 4] > 0.9 and p[free[1], 4] < 0.3 and np.allclose(p.sum(1), 1)


# -- 5 --


def test_pu_quality(spark):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(["the", "of", "thing", "word", "and", "paper"]) for _ in range(rng.randint(50, 200)))
    bad = lambda: " ".join(rng.choice(["A###", "B%%%", "C&&&"]) for _ in range(rng.randint(50, 200)))
    quality = [int(rng.random() < 0.8) for _ in range(600)]
    texts = [good() if q else bad() for q in quality] + [None, ""]
    labels = spark.createDataFrame([(i, q, None) for i, q in enumerate(quality) if i % 2 == 0] + [(None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    found = got(pu_quality.scored(frame(spark, texts), labels))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] for i in held) and len(found) == 602
    assert np.mean([found[i]["predicted"] == quality[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    none = got(pu_quality.scored(frame(spark, ["a"]), labels.limit(0)))
    assert none[0]["score"] == 0.5
    assert pu_quality.scored(frame(spark, []), labels).count() == 0


# -- 6 --


def test_language_id(spark):
    rng = random.Random(0)
    say = {"en": ["the", "thing", "with", "there"], "de": ["der", "und", "schön", "über"], "fr": ["le", "été", "que", "leçon"]}
    langs = [rng.choice(list(say)) for _ in range(200)]
    texts = [" ".join(rng.choice(say[x]) for _ in range(rng.randint(1, 60))) for x in langs] + [None, "", "123 !", " ".join(["the thing with"] * 30 + ["der und schön"] * 30)]
    df = frame(spark, texts, lang=[*langs, "en", "en", "en", None])
    found = got(language_id.identified(df))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([found[i]["lang_pred"] == langs[i] for i in held]) == 1.0
    assert [(found[i]["lang_pred"], found[i]["score"]) for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert {x.split(":")[0] for x in found[203]["languages"].split()} == {"en", "de"}
    assert all(0 <= r["score"] <= 1 for r in found.values())
    none = got(language_id.identified(frame(spark, ["abc"], lang=[None])))
    assert none[0]["lang_pred"] == "und"


def test_trigrams_count_letters():
    of, bucket = language_id.trigrams(["ab c", None, "漢a"])
    assert of.tolist() == [0, 0, 0, 2, 2] and ((0 <= bucket) & (bucket < language_id.BUCKETS)).all()


# -- 7 --


def test_byte_bpe(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "don't  stop\n\n now <|endoftext|> 漢字 😀" * 5]
    found = got(byte_bpe.round_trip(frame(spark, texts), RANKS, PATTERN))
    for i, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    ids = byte_bpe.encode(frame(spark, texts), RANKS, PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(ids, RANKS, PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab '\n\t1é!", max_size=200), st.integers(1, 20))
def test_safe_parts(text, size):
    c = byte_bpe.codec(RANKS, PATTERN)
    parts = list(byte_bpe.safe_parts(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in c.encode(p)] == c.encode(text)


# -- 8 --


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>one<p>two &nbsp; &amp; three<!-- x", "one two & three"),
        ("<head><title>t</title></head><body><nav><a href=a>menu</a></nav><article><h1>Head</h1><p>Some <b>bold</b> text.</p><p>Ok.</article><footer>foot</footer>", "Head Some bold text. Ok."),
        ("<div class='content'><p>Body here.</p><div id=comments><p>great post, thank you very much for it</p></div></div><aside>more things to read in here</aside><form>name<input></form>", "Body here."),
        ("<div class='cookie-notice'>We use cookies on this site</div><main><p>Text</p><script>var a='</p>';</script></main>", "Text"),
        ("<article>a<br>b<i>c</i></article>", "a bc"),
        ("<div><a href=1>one</a> <a href=2>two</a></div>", ""),
        ("a < b", "a < b"),
        ("<p title=\"a>b\">x</p>", "x"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é é</p></article>", "z"), (1, None, None, "z"), (None, "v", "<p>" * 5_000 + "deep</p>", "z")], "page_id bigint, url string, html string, text string")
    rows = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert rows == [(0, "deep", 4), (1, "", 0), (1, "é é", 3)]
    x = html_text.features(html_text.blocks("<p>a <a>b</a></p><p>c</p>"))
    assert x[0].tolist() == [2, 0.5, 0, 0, 1, 0, 0, 0]


# -- 9 --


def brute_print(t):
    words = (t or "").encode().translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in zip(ids, prints):
        for j, y in zip(ids, prints):
            if bin(x ^ y).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("chunk", [4096, 2])
def test_simhash(spark, chunk):
    rng = random.Random(7)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(200)] for _ in range(8)]
    texts = [None, "", "one two", "One  TWO", "a b c d", "a b c d e"]
    for words in base:
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            texts.append(" ".join(w))
    found = got(simhash.near_duplicates(frame(spark, texts), chunk=chunk))
    prints = [brute_print(t) for t in texts]
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert {i: found[i]["component_id"] for i in range(len(texts))} == brute_components(list(range(len(texts))), prints)
    kept = [r["doc_id"] for r in simhash.deduplicated(frame(spark, texts)).collect()]
    assert sorted(kept) == sorted({r["component_id"] for r in found.values()})


def test_simhash_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    for errors in (0, 1, 2, 3, 4):
        for _ in range(60):
            x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            y = x
            for b in rng.choice(64, errors, replace=False):
                y ^= 1 << int(b)
            for long in (False, True):
                row, key = simhash.keys(np.array([x, y], np.uint64), long)
                assert set(key[row == 0]) & set(key[row == 1]), (x, y)


def test_simhash_long_keys_find_the_same_links(spark):
    rng = np.random.default_rng(11)
    prints = rng.integers(-(1 << 63), 1 << 63, 60)
    for _ in range(3):
        prints = np.concatenate([prints, prints[:40] ^ (1 << rng.integers(0, 63, 40)) ^ (1 << rng.integers(0, 63, 40))])
    df = spark.createDataFrame([(int(x),) for x in set(prints.tolist())], "print bigint")
    roots = []
    for long in (1 << 27, 0):
        edges, _ = simhash.links(df, long=long)
        roots.append({r["node"]: r["root"] for r in simhash.components(edges).collect()})
    assert roots[0] == roots[1] and len(roots[0]) > 60


@pytest.mark.parametrize("long, pair_bits, most", [(False, 24, 4.0), (True, 36, 0.2)])
def test_simhash_comparisons_of_uniform_prints(long, pair_bits, most):
    """Meetings of unrelated prints for each key of a million prints, measured on 20,000: linear until the keys are full."""
    rng = np.random.default_rng(2)
    n = 20_000 if not long else 4_000
    row, key = simhash.keys(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), long)
    pairs = key[key >> 40 >= 16]
    meetings = sum(c * (c - 1) / 2 for c in np.unique(pairs, return_counts=True)[1].tolist())
    assert meetings / len(pairs) * (1_000_000 / n) < most


def test_golay_is_perfect():
    words, *_ = simhash.golay()
    assert len(set(words.tolist())) == 4096
    assert min(int(w).bit_count() for w in words[1:].tolist()) == 7
    v = np.random.default_rng(1).integers(0, 1 << 23, 500)
    near = words[simhash.nearest(v)]
    assert (np.bitwise_count((near ^ v).astype(np.uint64)) <= 3).all()


def test_components_of_long_chains(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(i, i + 1) for i in range(1000, 1010)] + [(1005, 1010)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {k: v for k, v in found.items() if k not in (0, 1000)} == {**{i: 0 for i in range(1, n + 1)}, **{i: 1000 for i in range(1001, 1011)}}


def test_simhash_odd_tables(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, "zz yy xx ww vv")], "doc_id bigint, text string")
    rows = sorted((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert rows == [("5", 5), ("5", 5), ("9", 9), ("None", 5)]
    assert sorted(r["doc_id"] for r in simhash.deduplicated(df).collect()) == [5, 9]


# -- 10 --


def brute_rules(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i : i + 3])].append(i)
    inside = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab \n\t#é\x85\xa0", max_size=120))
def test_rule_measures(text):
    t = quality_rules.Text(text)
    assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == brute_rules(text)[:5]


def test_quality_rules(spark):
    rng = random.Random(1)
    fine = " ".join(f"word{rng.randint(0, 9999)}" for _ in range(80))
    texts = [*ODD, fine, fine.upper(), " ".join(w + "###" for w in fine.split()), "ab cd ef " * 40]
    found = got(quality_rules.annotate(frame(spark, texts)))
    for i, t in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(t)
        assert not (r["kept"] and r["base_failed"])
    n = len(ODD)
    assert [found[i]["kept"] for i in range(n, n + 4)] == [True, False, False, False]
    kept = {r["doc_id"] for r in quality_rules.filter_docs(frame(spark, texts)).collect()}
    assert kept == {i for i, r in found.items() if r["kept"]}
    assert quality_rules.annotate(frame(spark, [])).count() == 0
    assert quality_rules.order([("slow", 10.0, 0.5), ("fast", 1.0, 0.2), ("never", 0.1, 0.0)]) == ["fast", "slow", "never"]
