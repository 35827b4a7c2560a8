"""Pronoun resolution with hand-made entity tables (the reference's test sentences)."""

from pyspark.sql import functions as F

from factlens.operators import annotate as AN
from factlens.operators import coref as CR

SENTS = {
    1: ("Steven is a cool guy, he always shows up on time", [("Steven", "PERSON")],
        "Steven is a cool guy, Steven always shows up on time"),
    2: ("Apple is a greedy company, it is only after your money!", [("Apple", "ORG")],
        "Apple is a greedy company, Apple is only after your money!"),
    3: ("Democrats hate Donald Trump, but they can't do anything about him.",
        [("Democrats", "NORP"), ("Donald Trump", "PERSON")],
        "Democrats hate Donald Trump, but Democrats can't do anything about Donald Trump."),
    4: ("Donald Trump's Big Beautiful Bill is garbage, his actions speak louder than his lies.",
        [("Donald Trump ' s", "PERSON"), ("Big Beautiful Bill", "WORK_OF_ART")],
        "Donald Trump's Big Beautiful Bill is garbage, Donald Trump's actions speak louder than Donald Trump's lies."),
    5: ("The US bombs Iran, so they retaliate.", [("US", "GPE"), ("Iran", "GPE")],
        "The US bombs Iran, so Iran retaliate."),
    6: ("He said it.", [], "He said it."),
}


def _tables(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in SENTS.items()], "doc_id long, text string")
    toks = AN.annotate(docs)[0].cache()
    tl = {}
    for r in toks.collect():
        tl.setdefault(r["doc_id"], []).append(r["text"])
    ents = []
    for k, (_, es, _) in SENTS.items():
        words = tl[k]
        for text, label in es:
            parts = text.split(" ")
            for i in range(len(words)):
                if words[i:i + len(parts)] == parts:
                    ents.append((k, i, i + len(parts), label, text.replace(" ' s", "'s")))
                    break
    e = spark.createDataFrame(ents, "doc_id long, start_tok int, end_tok int, label string, text string")
    return docs, toks, e


def test_priority_rule(spark):
    docs, toks, ents = _tables(spark)
    got = {r["doc_id"]: r["resolved_text"] for r in CR.resolve_pronouns(docs, toks, ents).collect()}
    assert got == {k: v[2] for k, v in SENTS.items()}


def test_nearest_rule_singular(spark):
    docs = spark.createDataFrame([(1, "Paris hosts Acme Corp and it grows.")], "doc_id long, text string")
    toks = AN.annotate(docs)[0]
    ents = spark.createDataFrame([(1, 0, 1, "GPE", "Paris"), (1, 2, 4, "ORG", "Acme Corp")],
                                 "doc_id long, start_tok int, end_tok int, label string, text string")
    r = CR.resolve_pronouns(docs, toks, ents, rule="nearest").first()
    assert r["resolved_text"] == "Paris hosts Acme Corp and Acme Corp grows."
    assert F is not None
