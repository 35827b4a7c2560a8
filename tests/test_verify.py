"""Flagship status rules (FIXTURES §1) and the classifier hooks."""

from pyspark.sql import functions as F

from factlens.operators import ml as ML
from factlens.plans.verify import MSG_NO_CLAIMS, MSG_NON_POLITICAL, verify_posts


class _Fixed:
    """Test classifier: label by a keyword, fixed confidence."""

    def __init__(self, word, yes, no, conf):
        self.word, self.yes, self.no, self.conf = word, yes, no, conf

    def score(self, df, id_col, text_col):
        lab = F.when(F.lower(F.col(text_col)).contains(self.word), self.yes).otherwise(self.no)
        return df.select(id_col, lab.alias("label"), F.lit(self.conf).alias("confidence"))


def test_status_rules(spark):
    posts = spark.createDataFrame([
        (1, "The senate passed the budget bill today. The vote was close in the senate."),
        (2, "I love sunny mornings. Coffee is great."),
        (3, ""),
        (4, "The senate is nice. Senate."),
    ], "post_id long, text string")
    chunks = spark.createDataFrame([(10, "u1", "the senate passed the budget bill"), (11, "u2", "coffee mornings")],
                                   "chunk_id long, url string, content string")
    labels = spark.createDataFrame([(10, "SUPPORTS")], "chunk_id long, label string")
    topic = _Fixed("senate", "POLITICAL", "NON_POLITICAL", 0.99)
    claim = _Fixed("budget", "claim", "other", 0.95)
    out = {r["post_id"]: r for r in verify_posts(posts, chunks, labels, topic=topic, claim=claim, k=1).collect()}
    assert out[1]["success"] and out[1]["message"] is None
    assert [c["text"] for c in out[1]["extracted_claims"]] == ["The senate passed the budget bill today"]
    res = out[1]["fact_check_results"][0]
    assert (res["verdict"], res["evidence_count"], res["source_urls"]) == ("SUPPORTS", 1, ["u1"])
    assert not out[2]["success"] and out[2]["message"] == MSG_NON_POLITICAL and out[2]["extracted_claims"] == []
    assert not out[3]["success"] and out[3]["message"] == MSG_NON_POLITICAL       # empty post (§8 D4)
    assert not out[4]["success"] and out[4]["message"] == MSG_NO_CLAIMS


def test_pandas_model_and_spark_ml_hooks(spark):
    df = spark.createDataFrame([(1, "vote now"), (2, "cats sleep"), (3, "vote today"), (4, "dogs run")] * 3,
                               "id long, text string").withColumn("id", F.monotonically_increasing_id())
    df = df.withColumn("label", F.when(F.col("text").contains("vote"), "claim").otherwise("other"))

    def load():
        return lambda texts: (["claim" if "vote" in t else "other" for t in texts], [0.9] * len(texts))

    p = ML.PandasModelClassifier(load, batch_size=2).score(df, "id", "text")
    assert {r["label"] for r in p.where(F.col("id") >= 0).collect()} == {"claim", "other"}
    clf = ML.train_text_classifier(df, "text", "label")
    s = clf.score(df, "id", "text").join(df.select("id", F.col("label").alias("actual")), "id")
    assert s.where(F.col("label") == F.col("actual")).count() == df.count()


def test_judge_and_embedder_hooks(spark):
    """A plugged judge decides; a claim it fails on is an ERROR without evidence."""
    posts = spark.createDataFrame([(1, "The senate cut the budget twice. The senate kept the budget whole. The senate lost the budget vote.")],
                                  "post_id long, text string")
    chunks = spark.createDataFrame([(10, "u1", "the senate and the budget")], "chunk_id long, url string, content string")
    seen = []

    def embedder(df, id_col, text_col):
        seen.append(id_col)
        return df.select(id_col, F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))

    def judge(claims, hits):
        failed = F.col("text").contains("whole")
        verdict = F.when(F.col("text").contains("twice"), "REFUTES")
        return claims.select("claim_id", verdict.alias("verdict"), F.lit(0.7).alias("confidence"), failed.alias("failed"))

    out = verify_posts(posts, chunks, None, topic=_Fixed("senate", "POLITICAL", "NON_POLITICAL", 0.99),
                       claim=_Fixed("budget", "claim", "other", 0.95), k=1, embedder=embedder, judge=judge).first()
    got = [(r["verdict"], r["confidence"], r["evidence_count"], r["source_urls"]) for r in out["fact_check_results"]]
    assert got == [("REFUTES", 0.7, 1, ["u1"]), ("ERROR", 0.0, 0, []), ("INSUFFICIENT_EVIDENCE", 0.0, 1, ["u1"])]
    assert seen == ["claim_id", "chunk_id"]
