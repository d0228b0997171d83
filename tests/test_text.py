"""Text functions, one test a rule."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T


@pytest.fixture
def one(spark):
    def run(f, *values):
        df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first()[0]

    return run


def test_white_space_is_unicode(one):
    assert one(T.norm_ws, "  a 　b\n\tc﻿") == "a b c"
    assert one(T.norm_ws, None) is None and one(T.norm_ws, "") == ""


def test_title_key_deletes_marks(one):
    assert one(T.norm_title, "MD&A  Lock-Up: Été!") == "mda lockup été"


def test_slug_and_ids(one):
    assert one(T.slugify, "?!") == "untitled"
    assert len(one(T.slugify, "word " * 40)) == 80
    assert one(lambda c: T.stable_id("section", F.lit(40), T.slugify(c)), "Risk Factors") == "section-40-riskfactors"
    assert one(lambda c: T.stable_id("chunk", c, F.lit(2)), "section-40-riskfactors") == "chunk-section40riskfactors-2"
    assert one(lambda c: T.stable_id(c, F.lit(None), F.lit(""), "b"), "A") == "a-b"


def test_tokens_and_excerpt(one):
    assert one(T.estimate_tokens, "") == 1 and one(T.estimate_tokens, "abcde") == 2
    assert one(lambda c: T.excerpt(c, 5), "abcde") == "abcde"
    assert one(lambda c: T.excerpt(c, 5), "abc def") == "abc..."


def test_source_excerpt(one):
    assert one(T.is_source_excerpt, "Revenue ......$4,694", "revenue $4,694") is True
    assert one(T.is_source_excerpt, "abc", "") is True
    assert one(T.is_source_excerpt, "abc", "abd") is False


def test_page_furniture_and_quotes(one):
    assert one(T.strip_page_furniture, "the 62 Table of Contents rules TABLE OF CONTENTS end") == "the rules end"
    assert one(T.prettify_quote, "Revenue ......$4,694$4,067 (1,943)27 2026December 15.4%Costs Total$29") == "Revenue $4,694 $4,067 (1,943) 27 2026 December 15.4% Costs Total $29"


def test_sentences(one):
    assert one(T.split_sentences, "Mr. Lee came. He left! (Why?) No one at U.S. Steel knew, e.g. Ann. So") == ["Mr. Lee came.", "He left!", "(Why?) No one at U.S. Steel knew, e.g. Ann.", "So"]
    assert one(T.split_sentences, "") == []


def test_sentences_keep_digits_at_their_ends(one):
    assert one(T.split_sentences, "0 Call 490. 1 Ask 101. It is 112") == ["0 Call 490. 1 Ask 101.", "It is 112"]
    assert one(T.split_sentences, "It cost 10") == ["It cost 10"]


def test_first_characters_have_one_capital(one):
    assert [one(lambda c: T.scrub_terms(c, []), x) for x in ("ßa", "ﬁn", "ᾳ", "éa", "a", "")] == ["ẞa", "ﬁn", "ᾼ", "Éa", "A", ""]


def test_clamp(one):
    assert one(lambda c: T.clamp_sentence(c, 10), "short") == "short"
    assert one(lambda c: T.clamp_sentence(c, 10), "one two three four") == "one two…"
    assert one(lambda c: T.clamp_sentence(c, 5), "abcdefgh") == "abcd…"


@pytest.mark.parametrize(
    ("title", "ok"),
    [
        ("Our operations could be materially harmed by launch delays in the field", True),
        ("Our operations could be harmed", False),
        ("Additionally, our operations could be materially harmed by launch delays", False),
        ("These operations could be materially harmed by launch delays in the field", False),
        ("Rules of the market to the extent applied, are different and may harm us all", False),
        ("If rules of the market to the extent applied, they may harm us and others too", True),
        ("A decline in sales hurt the group deeply, they could fail to pay at any time", False),
        ("Act (or the rules under it) could be read to harm our business in the field", False),
        ("The weather in the valley was pleasant and the harvest was good that season", False),
    ],
)
def test_clean_title(one, title, ok):
    assert one(T.is_clean_title, title) is ok


def test_policy_words(one):
    assert one(T.has_advice, "You should  buy it") is True and one(T.has_advice, "agreed not to sell") is False
    assert all(one(T.has_advice, f"a must{c}buy") for c in "- \t\n\u00a0") and not one(T.has_advice, "a mustbuy")
    assert one(T.has_parser_language, "Parser found it") is True
    assert one(T.has_prohibited_language, "they hold it") is True and one(T.has_prohibited_language, "holding") is False


def test_boundaries_are_ascii(one):
    assert one(lambda c: T.has(c, r"\bcaf\b"), "café") is True  # é ends the word
    assert one(lambda c: T.has(c, r"\b(regulat)\b"), "regulatory") is False


def test_scrub_and_ip(one):
    assert one(lambda c: T.scrub_terms(c, [(r"\bevidence cards?\b", "figures")]), "Evidence cards say") == "Figures say"
    assert one(T.client_ip, " 1.2.3.4 , p", "x") == "1.2.3.4"
    assert one(T.client_ip, " ,p", "x") == "x" and one(T.client_ip, None, "") == "unknown"
