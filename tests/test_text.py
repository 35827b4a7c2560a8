"""Golden rows for the text rules, checked against Python's own regex semantics."""

import re

import pytest
from pyspark.sql import functions as F

from factlens.functions import text as T
from factlens.operators.ml import claim_topic, constant_label
from factlens.operators.responses import parse_responses

PY_URL = re.compile(r'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+')
PY_MENTION = re.compile(r"@\w+")

SAMPLES = [
    "see https://a.b/c#frag and http://x.y/~u/p) now",
    "HTTPS://UPPER.CASE/x stays, https://ok.com/p?q=1&r=2.",
    "hi @josé_1 and @名前 and mail bob@example.com",
    "combining @café mark",
    "no links at all",
    "tail's\n",
    "Bob's",
]


def _one(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_mask_urls_matches_python(spark):
    got = _one(spark, SAMPLES, T.mask_urls)
    assert got == [PY_URL.sub("{{URL}}", s) for s in SAMPLES]


def test_mask_mentions_matches_python_unicode_word(spark):
    got = _one(spark, SAMPLES, T.mask_mentions)
    assert got == [PY_MENTION.sub("{{USERNAME}}", s) for s in SAMPLES]


def test_strip_possessive_matches_python_dollar(spark):
    got = _one(spark, SAMPLES, T.strip_possessive)
    assert got == [re.sub(r"'s$", "", s) for s in SAMPLES]


@pytest.mark.parametrize("s", ["  a \t b\n\n c  ", "", "   ", "x y z　w", "a\x0bb\x1cc"])
def test_collapse_ws_is_python_split_join(spark, s):
    assert _one(spark, [s], T.collapse_ws) == [" ".join(s.split())]
    assert _one(spark, [s], lambda c: F.size(T.words(c))) == [len(s.split())]


def test_wiki_links(spark):
    s = "[[Paris|the capital]] and [[London]] and [[A_b|c d]]"
    assert _one(spark, [s], T.strip_wiki_links) == ["the capital and London and c d"]


@pytest.mark.parametrize("raw,expected", [
    ("2025031", ""), (None, ""), ("20250230", "20250230"), ("20250301123456", "2025-03-01"), ("abcdefgh", "abcdefgh"),
])
def test_parse_seen_date(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(T.parse_seen_date("x")).first()[0] == expected


def test_map_label_and_slug(spark):
    got = _one(spark, ["LABEL_0", "LABEL_2", "LABEL_7", "other"], T.map_label)
    assert got == ["SUPPORTS", "NOT ENOUGH INFO", "LABEL_7", "other"]
    assert _one(spark, ["Hello, World! 123 and more"], T.slug) == ["helloworld12"]


def test_label_variants(spark):
    assert _one(spark, ["LABEL_0", "x1", "2", "12", "none", None], T.map_label_by_digit) == ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO", "REFUTES", "ERROR - WHAT?!?", None]
    assert _one(spark, ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO", "LABEL_0", None], T.label_id) == [0, 1, 2, None, None]
    assert _one(spark, ["LABEL_1", "LABEL_0", None], T.claim_label) == ["Claim", "Opinion", "Opinion"]
    df = spark.createDataFrame([(0, 1), (1, 0), (2, None)], "i int, y int")
    assert [tuple(r) for r in df.orderBy("i").select(claim_topic("y"), constant_label()).collect()] == [("claim", "political"), ("other", "political"), ("other", "political")]


def test_response_parsing(spark):
    df = spark.createDataFrame([(1, '{"who": "A", "what": "B"}'), (2, 'assistant\nsure {"who": "C"} ok'),
                                (3, "no json here"), (4, "{broken")], "id int, response string")
    out = {r["id"]: r for r in parse_responses(df).collect()}
    assert out[1]["parsed"] and out[1]["who"] == "A" and out[1]["what"] == "B"
    assert out[2]["parsed"] and out[2]["who"] == "C"
    assert not out[3]["parsed"] and out[3]["raw"] == "no json here"
    assert not out[4]["parsed"]
