"""Cases in which an operator once did less than its whole job."""

import math
import random
import re
import time

import numpy as np
import pytest

from shardloom.llm import hmm_lm, html_text, language_id, pii, pu_quality, simhash


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


# -- near-duplicates: rows, not ids --


def test_deduplicated_keeps_a_row_of_each_component(spark):
    rows = [(None, prose(i), "s") for i in range(6)]  # clean documents without an id
    rows += [(7, prose(100), "s"), (7, prose(101), "s")]  # clean documents that share an id
    rows += [(1, prose(200), "s"), (2, prose(200), "s"), (None, prose(200), "s")]  # copies, one without an id
    rows += [(None, prose(300), "s")] * 3  # copies without ids
    rows += [(9, prose(400), "z"), (9, prose(400), "y")]  # an id and a text twice
    rows += [(None, None, "s"), (None, "", "s"), (4, " ", "s")]  # no words: one component
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    expected = {*rows[:8], (1, prose(200), "s"), (None, prose(300), "s"), (9, prose(400), "y"), (4, " ", "s")}
    for n in (1, 5):
        found = [tuple(r) for r in simhash.deduplicated(df.repartition(n)).collect()]
        assert len(found) == len(expected) and set(found) == expected


def test_deduplicated_lone_null_id_lets_no_copy_back_in(spark):
    rows = [(None, prose(1)), (3, prose(2)), (None, prose(2))]
    found = [tuple(r) for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(found) == 2 and set(found) == {(None, prose(1)), (3, prose(2))}


# -- personal data --


def test_evidence_reaches_every_occurrence():
    field = pii.Field(np.zeros((pii.N_FEATURES, 5)), np.zeros((5, 5)), np.full(5, 4.0))
    text = "call +1 (017) 555-7713 now " + " or ".join(["555-7713"] * 40) + " and 999"
    graph = pii.Graph([text])
    free = [i for i in range(len(graph.labels)) if graph.labels[i] == 0]
    p = pii.marginals(graph, field)
    assert p[free[:-1], 4].min() >= pii.MARGIN and p[free[-1], 4] < 0.3
    base, every = pii.spans([text], field)[0]
    assert len(every) == len(base) + 40
    assert pii.spans(["a@b.example " * 3, text, "no 12345 or 12345"], field)[1] == (base, every)


def test_messages_run_until_they_settle():
    field = pii.Field(np.zeros((pii.N_FEATURES, 5)), np.eye(5) * 12.0, np.zeros(5))
    graph = pii.Graph(["jo@mail.example " + " ".join(str(i) for i in range(30))])
    assert pii.marginals(graph, field)[:, 1].min() >= pii.MARGIN


# -- html --


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><div class='overflow-hidden'><p>Kept text.</p></div><p title='The hidden cost'>More.</p><section id='hidden-figures'><p>Third.</p></section></article>", "Kept text. More. Third."),
        ("<article><h2 id='related-work'>Related work</h2><p>One.</p><h2 id=search-methods>Search</h2><p id=share>Two.</p><section id='social-effects'><p>Three.</p></section></article>", "Related work One. Search Two. Three."),
        ("<article><p>Seen.</p><p hidden>a</p><div style='color:red; display : none'><p>b</p></div><p aria-hidden=true>c</p><p HIDDEN=''>d</p></article>", "Seen."),
        ("<article><p hidden='until-found'>Found.</p><p aria-hidden='false' data-id='comments'>Too.</p></article>", "Found. Too."),
        ("<article><p>Body.</p><div class='comment-content'><p>Great post, thank you for it.</p></div><section id='comments-list'><p>I liked it as well.</p></section></article>", "Body."),
        (f"<div class='social-entry-menu'>{'<p>' + 'long words here ' * 60 + '</p>'}</div>", ("long words here " * 60).strip()),
    ],
)
def test_article_text_is_kept(page, text):
    assert html_text.main_text(page) == text


def test_long_prose_stays_in_a_container_that_speaks_against_it():
    part = " ".join(["word"] * 200)
    form = "".join(f"<p>{part}</p>" for _ in range(5))
    assert html_text.main_text(f"<form>{form}</form>").count(part) >= 3
    assert html_text.main_text(f"<div id=comments><p>Jo</p><p>{part}</p><p>3 May</p></div>") == ""
    assert html_text.main_text(f"<article><p>Ok.</p><div hidden>{form}</div></article>") == "Ok."


def pages_of(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]


def test_pages_give_their_article(spark):
    """Against a plain reading of pages of one known form: what stands in <article>, block by block."""
    import html as entities

    for page in pages_of(spark):
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        blocks = re.split(r"</?(?:h1|p|br|div|ul|li)[^>]*>", body)
        found = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert html_text.main_text(page) == " ".join(b for b in found if b)


def test_neighbours_decide_and_class_names_do_not(spark):
    changed = total = 0
    for page in pages_of(spark):
        x = html_text.features(html_text.blocks(page))
        alone = x.copy()
        alone[:, 2:6] = 0
        kept = html_text.shares(html_text.tree(), x) >= 0.5
        changed += int((kept != (html_text.shares(html_text.tree(), alone) >= 0.5)).any())
        total += 1
        assert html_text.main_text(re.sub(r' (class|id|role)="[^"]*"', "", page)) == html_text.main_text(page)
    assert changed > total / 2


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>x" * 100_000, "<svg>" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<p>a<a href='" * 60_000, "&" * 500_000, "<!--" * 200_000, "<ul>" + "<li>x" * 150_000])
def test_work_grows_with_the_page(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav><a href=x>Home</a></nav><article><h1>A short title</h1><p>Few words.</p></article>", "A short title Few words."),
        ("<ul><li><a>Home</a><li><a>News</a></ul><div>Buy more of this now please</div><h1>A title of the page</h1><p>" + "word " * 60 + "</p>", "A title of the page " + "word " * 59 + "word"),
        ("<article><p>One two.</p><ul><li><a>See</a></ul><p>Then a few more words.</p><div class=ad>Buy it now</div><p>End.</p></article>", "One two. See Then a few more words. End."),
        ("<p>Only this.</p>", "Only this."),
    ],
)
def test_adverts_by_their_neighbours(page, text):
    assert html_text.main_text(page) == text


# -- languages --


def test_more_than_four_languages():
    names = [chr(c) * 3 for c in range(ord("a"), ord("g"))]
    table = np.full((language_id.BUCKETS, 6), 1e-7)
    for i, w in enumerate(names):
        of, bucket = language_id.trigrams([w])
        table[bucket, i] = 1 / 3
    chosen, shares = language_id.infer([" ".join(names * 50)], table.astype(np.float32))
    assert np.allclose(shares[0], 1 / 6, atol=0.01)


def test_a_small_share_of_a_long_text():
    table = np.full((language_id.BUCKETS, 3), 1e-7)
    for i, w in enumerate(["aaa", "bbb", "ccc"]):
        table[language_id.trigrams([w])[1], i] = 1 / 3
    chosen, shares = language_id.infer([" ".join(["aaa"] * 9_850 + ["bbb"] * 150), "aaa " * 500], table.astype(np.float32))
    assert chosen.tolist() == [0, 0] and abs(shares[0, 1] - 0.015) < 0.002 and shares[0, 2] == 0 and (shares[1] > 0).tolist() == [True, False, False]


def test_language_sets_against_all_sets():
    """Penalised likelihoods of all 31 sets of five languages, each by many EM steps."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    table = rng.dirichlet(np.full(language_id.BUCKETS, 0.02), 5).T.astype(np.float32) + np.float32(1e-9)
    alphabet = "abcdefghijklm"
    for k in range(12):
        words = ["".join(rng.choice(list(alphabet), 3)) for _ in range(40)]
        text = " ".join(rng.choice(words, 300))
        of, bucket = language_id.trigrams([text])
        p, n = table[bucket].astype(np.float64), len(bucket)
        scores = {}
        for size in range(1, 6):
            for some in combinations(range(5), size):
                share = np.full(size, 1 / size)
                for _ in range(400):
                    r = p[:, some] * share
                    share = (r / r.sum(1, keepdims=True)).mean(0)
                scores[some] = np.log((p[:, some] * share).sum(1)).sum() - (size - 1) * language_id.PENALTY * np.log(n + 1)
        _, shares = language_id.infer([text], table)
        got = tuple(np.flatnonzero(shares[0] > 0).tolist())
        assert max(scores.values()) - scores[got] < 0.02 * abs(max(scores.values())), (k, got)


def test_many_languages(spark):
    """More languages than the model has room for with all buckets: the buckets are joined."""
    assert language_id.folds_of(4) == 0 and language_id.folds_of(256) == 0 and language_id.folds_of(1_000) == 2
    table = np.full((language_id.BUCKETS >> 2, 3), 1e-7)
    for i, w in enumerate(["aaa", "bbb", "ccc"]):
        table[language_id.trigrams([w])[1] >> 2, i] = 1 / 3
    chosen, _ = language_id.infer(["aaa " * 9, "bbb", None, "ccc ccc"], table.astype(np.float32))
    assert chosen.tolist() == [0, 1, -1, 2]


# -- positive-unlabelled quality --


def test_risk_and_its_gradient():
    rng = np.random.default_rng(1)
    p, u = rng.normal(0.5, 1, (40, 6)), rng.normal(0, 1, (70, 6))
    for prior, scale in ((0.3, 0.1), (0.9, 3.0)):
        w, b = rng.normal(0, scale, 6), 0.2
        value, gw, gb = pu_quality.risk(w, b, p, u, prior)
        loss = lambda z: math.log1p(math.exp(-z))
        first = prior * sum(loss(float(x @ w + b)) for x in p) / len(p)
        second = sum(loss(-float(x @ w + b)) for x in u) / len(u) - prior * sum(loss(-float(x @ w + b)) for x in p) / len(p)
        assert math.isclose(value, first + max(0.0, second), rel_tol=1e-9)
        if second >= 0:
            for i in range(6):
                step = np.eye(6)[i] * 1e-6
                slope = (pu_quality.risk(w + step, b, p, u, prior)[0] - pu_quality.risk(w - step, b, p, u, prior)[0]) / 2e-6
                assert math.isclose(slope, gw[i], rel_tol=1e-4, abs_tol=1e-6)


def test_labels_on_every_document(spark):
    rng = random.Random(0)
    words = {1: ["the", "of", "thing", "paper"], 0: ["A###", "B%%%", "C&&&"]}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(80))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    found = {r["doc_id"]: r["predicted"] for r in pu_quality.scored(docs, labels).collect()}
    assert np.mean([found[i] == i % 2 for i, _ in rows]) > 0.97


# -- the sample of the field --


def test_field_is_fitted_to_the_first_distinct_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda graph: seen.append(sorted(graph.span)) or len(graph.base))
    texts = [f"mail u{i}@x.example " + "a" * i for i in range(30)] + ["copy 1@"] * 500 + ["no sign", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [pii.train(df.repartition(n), most=10) for n in (1, 7)] == [10, 10] and seen[0] == seen[1]
    assert pii.train(df) == 31 and pii.train(df.limit(0)) == 0


# -- hidden Markov model --


def test_every_round_is_over_all_documents(spark, monkeypatch):
    sizes, fits, real = [], [], hmm_lm.round_of

    def watched(rows, model, shares):
        sizes.append(rows.count())
        out = real(rows, model, shares)
        fits.append(out[1])
        return out

    monkeypatch.setattr(hmm_lm, "round_of", watched)
    codes = [(np.array([i % 2, 2 + i % 2] * 3, np.uint16).tobytes(),) for i in range(1_600)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(codes)], "row bigint, classes binary")
    hmm_lm.baum_welch(rows, np.full(4, 0.25), 2, burn_in=2)
    assert set(sizes) == {1_600} and fits[-1] - fits[-2] < hmm_lm.GAIN and fits[-1] > fits[0]
