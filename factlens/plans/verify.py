"""M10 verify_posts and A15 assemble_response: one DataFrame job from posts to one
response row per post.

topic score (hook) -> F6 gate -> W6 pronouns -> U1 sentences -> claim score (hook)
-> F7 gate -> evidence loop (M1 keywords -> J8 search of the articles -> J3, U3, K3 append)
-> M7 embed -> J5 top-k over the chunk store -> A16 bundle -> M8 judge
-> M9 status -> A15 response. The loop is one search and one append for the whole batch: every claim of a batch sees the
store as it was before and what the batch itself has appended, a version of its own, and nothing of later batches. The gates are real filters, so later (costlier)
stages only see political posts and claim sentences; every stage is keyed by post
or claim id, so the job partitions by those ids and never gathers posts on the
driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.operators import annotate as AN
from factlens.operators import chunks as C
from factlens.operators import coref as CR
from factlens.operators import inverted as INV
from factlens.operators import keywords as KW
from factlens.operators import ml as ML
from factlens.operators import retrieve as R
from factlens.operators import sentences as SE
from factlens.session import ensure_checkpoint_dir

# Response messages.
MSG_NON_POLITICAL = "Non political content detected."
MSG_NO_CLAIMS = "No factual claims detected."
DIM = 64


def assemble_response(posts: DataFrame, gate: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """Per post the claims (sentence order), the verdicts, success flag, message."""
    ec = claims.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct(
        "sent_idx", "text", F.col("confidence").alias("confidence"), "is_factual_claim"))).alias("_c"))
    fr = results.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct(
        "sent_idx", F.col("text").alias("claim"), "verdict", F.col("verdict_confidence").alias("confidence"),
        "evidence_count", "source_urls"))).alias("_r"))
    j = posts.join(gate.select("post_id", "is_political", "classification"), "post_id", "left") \
        .join(ec, "post_id", "left").join(fr, "post_id", "left")
    political = F.coalesce(F.col("classification") == SE.POLITICAL, F.lit(False))
    n_claims = F.coalesce(F.size("_c"), F.lit(0))
    claims_out = F.transform(F.coalesce("_c", F.array()), lambda s: F.struct(
        s["text"].alias("text"), s["confidence"].alias("confidence"), s["is_factual_claim"].alias("is_factual_claim")))
    results_out = F.transform(F.coalesce("_r", F.array()), lambda s: F.struct(
        s["claim"].alias("claim"), s["verdict"].alias("verdict"), s["confidence"].alias("confidence"),
        s["evidence_count"].alias("evidence_count"), s["source_urls"].alias("source_urls")))
    return j.select(
        "post_id", F.col("text").alias("original_text"),
        (political & F.coalesce("is_political", F.lit(False))).alias("is_political"),
        F.coalesce("classification", F.lit(SE.NON_POLITICAL)).alias("classification"),
        F.when(political, claims_out).otherwise(F.array()).alias("extracted_claims"),
        F.when(political, results_out).otherwise(F.array()).alias("fact_check_results"),
        (political & (n_claims > 0)).alias("success"),
        F.when(~political, F.lit(MSG_NON_POLITICAL)).when(n_claims == 0, F.lit(MSG_NO_CLAIMS))
        .otherwise(F.lit(None).cast("string")).alias("message"))


@dataclass
class Articles:
    """What the evidence loop searches: ``table`` (doc, url, channel, full_content and U3's optional columns), its stored
    index, and per channel the back-off levels of its searches."""

    table: DataFrame
    index: INV.InvertedIndex
    channels: tuple = (("news", KW.NEWS_LEVELS), ("index", KW.INDEX_LEVELS), ("wiki", KW.WIKI_LEVELS))

    @classmethod
    def of(cls, table: DataFrame, **options) -> "Articles":
        return cls(table, INV.build(table, id_col="doc", text_col="full_content", scope=("channel",)), **options)


def claim_keywords(claims: DataFrame, annotator=AN.annotate) -> DataFrame:
    """M1 per claim, lower-cased and distinct in first-seen order: ``doc_id`` (the claim), kw_idx, keyword."""
    toks, ents = annotator(claims.select(F.col("claim_id").alias("doc_id"), "text"), "doc_id", "text")
    kw = KW.extract_keywords(toks, ents).groupBy("doc_id", F.lower("keyword").alias("keyword")).agg(F.min("kw_idx").alias("_i"))
    return kw.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_i")) - 1).alias("kw_idx"), "keyword")


def gather_articles(claims: DataFrame, articles: Articles, annotator=AN.annotate) -> DataFrame:
    """The search half of the loop: ``claim_id, channel, doc`` of the first level with hits in each channel."""
    kw = claim_keywords(claims, annotator).checkpoint(eager=True)
    asked = None  # all channels and levels in one search; a channel is a term of its articles
    for channel, levels in articles.channels:
        lt = KW.claim_level_terms(kw, levels).withColumn("channel", F.lit(channel))
        asked = lt if asked is None else asked.unionByName(lt)
    keys = ["claim_id", "channel", "level"]
    limits = asked.select("channel", "level", "lim").distinct()
    terms = asked.select(*keys, "term").union(asked.select(*keys).distinct().withColumn("term", INV.value_term("channel", F.col("channel"))))
    most = max(lim for _, levels in articles.channels for _, lim in levels)
    hits = INV.search(articles.index, terms, keys, most).join(limits, ["channel", "level"]).where(F.col("rank") <= F.col("lim"))
    best = hits.groupBy("claim_id", "channel").agg(F.min("level").alias("level"))
    return hits.join(best, keys).select("claim_id", "channel", "doc")


def claim_results(claims: DataFrame, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """M9 per claim with the urls of its hits in first-seen order (none for a claim that the judge failed on)."""
    status = ML.verdict_status(claims.select("claim_id"), hits, verdicts)
    first = hits.groupBy("claim_id", "url").agg(F.min("rank").alias("_f"))
    urls = first.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("_f", "url")))["url"].alias("source_urls"))
    return (claims.select("claim_id", "post_id", "sent_idx", "text")
            .join(status.withColumnRenamed("confidence", "verdict_confidence"), "claim_id")
            .join(urls, "claim_id", "left")
            .withColumn("source_urls", F.when(F.col("verdict") == "ERROR", F.array().cast("array<string>"))
                        .otherwise(F.coalesce("source_urls", F.array().cast("array<string>")))))


def verify_posts(posts: DataFrame, chunks: DataFrame | None, evidence_labels: DataFrame, *, topic, claim,
                 k: int = 5, annotator=AN.annotate, embedder=None, judge=None, articles: Articles | None = None,
                 store_path: str | None = None, version: int = 1) -> DataFrame:
    """``posts``: post_id, text. ``chunks``: chunk_id, url, content and, when the
    store keeps them, its ``embedding`` vectors (the store).
    ``evidence_labels``: chunk_id or url, and label (votes for the default judge). ``articles``: searched for every
    claim's keywords; what is found and new is chunked, embedded and appended, to the versioned store ``store_path`` as
    ``version`` (K3), or without a path to ``chunks`` for this batch alone. Hooks:
    ``embedder(df, id_col, text_col)`` gives (id, embedding); ``judge(claims, hits)``
    gives (claim_id, verdict, confidence) and, if it can fail on a claim, a boolean
    ``failed`` (status ERROR)."""
    embed = embedder or (lambda df, id_col, text_col: R.embed_text(df, id_col, text_col, DIM))
    scored = ML.score_batch(posts, "post_id", "text", topic).withColumn("status", SE.min_length_status("text"))
    gate = SE.topic_gate(scored.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
                         .withColumn("label", F.coalesce("label", F.lit(SE.NON_POLITICAL))))
    # gate, claims and hits are small (a row per post / claim / hit) and each feeds
    # several consumers: checkpoint them so the k-NN scoring upstream runs once.
    ensure_checkpoint_dir(posts.sparkSession)
    gate = gate.checkpoint(eager=True)
    political = gate.where(F.col("classification") == SE.POLITICAL).select("post_id", "text")
    toks, ents = annotator(political.withColumnRenamed("post_id", "doc_id"), "doc_id", "text")
    resolved = CR.resolve_pronouns(political.withColumnRenamed("post_id", "doc_id"), toks, ents)
    sents = SE.split_sentences(resolved.select(F.col("doc_id").alias("post_id"), "resolved_text"),
                               "post_id", "resolved_text")
    sents = sents.select(F.concat_ws(":", "post_id", "sent_idx").alias("claim_id"), "post_id", "sent_idx", "text")
    cs = ML.score_batch(sents, "claim_id", "text", claim).where(F.col("label").isNotNull())
    claims = SE.claim_gate(cs, claim_label="claim").checkpoint(eager=True)
    if articles is not None:
        found = gather_articles(claims, articles, annotator).select("doc").distinct()
        new = C.chunk_articles(C.dedupe_articles(articles.table.join(found, "doc"), ["doc"]).drop("doc", "channel"))
        new = embed(new.select("chunk_id", "content"), "chunk_id", "content").join(new, "chunk_id")
        if store_path:
            chunks = C.append_version(posts.sparkSession, store_path, new, version)
        else:
            chunks = chunks.unionByName(C.new_urls_only(new, chunks), allowMissingColumns=True).checkpoint(eager=True)
    elif store_path:
        chunks = C.store_as_of(posts.sparkSession, store_path, version)
    qv = embed(claims.select("claim_id", "text"), "claim_id", "text")
    cv = (chunks.select("chunk_id", "embedding") if "embedding" in chunks.columns
          else embed(chunks.select("chunk_id", "content"), "chunk_id", "content"))
    hits = R.knn_join(qv, cv, k=k, q_id="claim_id", i_id="chunk_id", items_materialized="embedding" in chunks.columns)
    hits = hits.select(F.col("qid").alias("claim_id"), F.col("item_id").alias("chunk_id"), "score", "rank") \
        .join(chunks.select("chunk_id", "url", "content"), "chunk_id").checkpoint(eager=True)
    verdicts = judge(claims, hits) if judge else ML.judge(hits, evidence_labels, item_col="url" if "url" in evidence_labels.columns else "chunk_id")
    results = claim_results(claims, hits, verdicts)
    return assemble_response(posts, gate, claims, results)
