"""Null and repeated ids, columns named like the operators' own, and empty tables."""

import public_tokenizers
import pytest

from shardloom.llm import byte_bpe, hmm_lm, html_text, language_id, pii, pu_quality, quality_rules, token_output

TEXTS = ["The first text, about a thing.", None, "", "mail me@here.example now", "The first text, about a thing."]
CLASHING = "mark string, score string, held_out string, spans string, print string, id string, row string, tie string, part string, start string, n_tokens string"
WORD_BPE, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    extra = tuple("x" for _ in CLASHING.split(","))
    rows = [(i, t, "en", *extra) for i, t in zip([5, 6, 7, None, 5], TEXTS)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, {CLASHING}").repartition(2)


def labels(spark):
    return spark.createDataFrame([(5, 1), (6, 0), (7, 1), (None, 1), (8, None)], "doc_id bigint, quality int")


OPERATORS = {
    "op1": lambda d: token_output.round_trip(d, WORD_BPE),
    "op2": lambda d: hmm_lm.scored(d),
    "op4": lambda d: pii.find(d),
    "op5": lambda d: pu_quality.scored(d, labels(d.sparkSession)),
    "op6": lambda d: language_id.identified(d),
    "op7": lambda d: byte_bpe.round_trip(d, RANKS, public_tokenizers.PATTERN),
    "op10": lambda d: quality_rules.annotate(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(docs, name):
    """A result for each row, the same for rows that repeat; none for a table without rows."""
    found = OPERATORS[name](docs).drop("start").collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["5", "5", "6", "7", "None"]
    fives = [r for r in found if r["doc_id"] == 5]
    assert fives[0] == fives[1]
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(None, "u", "<p>One text.</p>", "x", "x"), (1, None, None, "x", "x"), (1, None, "", "x", "x")], "page_id bigint, url string, html string, text string, n_chars string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()) == [("1", "", 0), ("1", "", 0), ("None", "One text.", 9)]
    assert html_text.extract(pages.limit(0)).count() == 0
