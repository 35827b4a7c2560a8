"""Golden rows for rules that an oracle with the same slip would not catch."""

import pytest
from pyspark.sql import functions as F

from factlens import session
from factlens.functions import text as T
from factlens.operators import chunks as C
from factlens.operators import filters as FI
from factlens.operators import retrieve as R
from factlens.operators import sampling as S
from factlens.operators import sentences as SE
from factlens.plans.q_verify import evidence_bundle
from factlens.plans.verify import verify_posts
from tests.test_verify import _Fixed


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_page_chunk_id_is_never_cut(spark):
    got = [one(spark, T.page_chunk_id(F.lit("p"), F.lit(n))) for n in (7, 1234, 12345)]
    assert got == ["p_chunk_0007", "p_chunk_1234", "p_chunk_12345"]


def test_slug_folds_case(spark):
    assert one(spark, T.slug(F.lit("Stra\u00dfe Gr\u00f6\u00dfe"))) == "strassegrsse"
    assert one(spark, T.slug(F.lit("\ufb01ne \u1e9e"))) == "finess"


def test_challenge_is_stripped_of_any_white_space(spark):
    d = spark.createDataFrame([(1, "\tNumerical Reasoning\n"), (2, " \n"), (3, "\tOther "), (4, None)], "id int, challenge string")
    assert [tuple(r) for r in FI.challenge_filter(d).collect()] == [(3, "other")]


def test_promoted_sentences_are_claims(spark):
    d = spark.createDataFrame([("a long sentence", "claim", 0.9), ("another sentence", "other", 0.5), ("a third sentence", "other", 0.9)],
                              "text string, label string, confidence double")
    got = {r["text"]: (r["label"], r["is_factual_claim"]) for r in SE.claim_gate(d).collect()}
    assert got == {"a long sentence": ("claim", True), "another sentence": ("claim", True)}


def test_rows_without_label_or_id_are_sampled_and_split(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (None, "a"), (4, None)], "id long, label string")
    assert S.stratified_exact_sample(d, "label", "id", 10).count() == 5
    split = S.stratified_split(d, "label", "id", 0.4)
    assert split.count() == 5
    assert split.where("split = 'test'").count() == 2 and split.where("split = 'val'").count() == 2
    assert S.sample_with_replacement(d, "label", "id").count() == 6


def test_hits_without_text_are_no_evidence(spark):
    r = spark.createDataFrame([(1, 1, "u1", "t"), (1, 2, "u2", ""), (1, 3, "u3", None), (1, 4, "u1", "s")], "claim_id int, rank int, url string, content string")
    row = evidence_bundle(r).first()
    assert (row["evidence"], row["evidence_count"], row["source_urls"]) == (["t", "s"], 2, ["u1"])


def test_store_is_searched_by_its_own_ids(spark, tmp_path):
    arts = spark.createDataFrame([("u1", "the senate passed a bill"), ("u2", "cats sleep all day")], "url string, full_content string")
    store = C.append_chunks(spark, str(tmp_path / "store"), C.chunk_articles(arts))
    q = R.embed_text(spark.createDataFrame([("q:1", "senate bill")], "qid string, text string"), "qid", "text", 64)
    hits = R.knn_join(q, R.embed_text(store, "chunk_id", "content", 64), k=1, i_id="chunk_id").collect()
    want = store.where("url = 'u1'").first()["chunk_id"]
    assert [(h["qid"], h["item_id"], h["rank"]) for h in hits] == [("q:1", want, 1)]


def test_failed_append_is_completed(spark, tmp_path):
    path = str(tmp_path / "store")
    arts = spark.createDataFrame([("u1", " ".join(f"w{i}" for i in range(200)))], "url string, full_content string")
    chunks = C.chunk_articles(arts)
    n = chunks.count()
    assert n > 2
    C.append_chunks(spark, path, chunks.where("chunk_index < 2"))  # what a failed append left
    for _ in range(2):
        assert C.append_chunks(spark, path, chunks).count() == n


def test_posts_of_many_sentences_do_not_mix(spark):
    long = ". ".join(f"The senate passed budget number {i} today" for i in range(1500)) + "."
    posts = spark.createDataFrame([(1, long), (2, "The senate passed the budget bill today.")], "post_id long, text string")
    chunks = spark.createDataFrame([("c1", "u1", "the senate passed the budget bill")], "chunk_id string, url string, content string")
    labels = spark.createDataFrame([("c1", "SUPPORTS")], "chunk_id string, label string")
    out = {r["post_id"]: r for r in verify_posts(posts, chunks, labels, topic=_Fixed("senate", "POLITICAL", "NON_POLITICAL", 0.99),
                                                 claim=_Fixed("budget", "claim", "other", 0.95), k=1).collect()}
    assert len(out[1]["extracted_claims"]) == 1500 and len(out[2]["extracted_claims"]) == 1
    assert len(out[1]["fact_check_results"]) == 1500 and len(out[2]["fact_check_results"]) == 1


def test_no_local_scratch_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
