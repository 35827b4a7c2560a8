"""Sources, sinks and evidence resolution on inline fixtures (FIXTURES §4.4)."""

import json

from pyspark.sql import functions as F

from factlens.operators import evidence as EV
from factlens.sources import readers as RD
from factlens.sources import sinks as SK


def test_evidence_refs_and_resolution(spark, tmp_path):
    lines = [
        {"id": 1, "claim": "c1", "label": "SUPPORTS", "challenge": " Search ",
         "evidence": [{"content": ["New_York_City_sentence_0", "Paris_sentence_4"]},
                      {"content": ["Paris_cell_0_1"]}]},
        {"id": 2, "claim": "c2", "label": "REFUTES", "challenge": "numerical reasoning",
         "evidence": [{"content": ["Missing_Page_sentence_0"]}]},
    ]
    p = tmp_path / "ev.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in lines[:1]) + "\n\n" + json.dumps(lines[1]) + "\n")
    raw = RD.read_evidence_jsonl(spark, str(p))
    assert raw.count() == 2
    refs = sorted((r["id"], r["page"], r["sentence_key"]) for r in EV.explode_evidence_refs(raw).collect())
    assert refs == [(1, "New_York_City", "sentence_0"), (1, "Paris", "sentence_4"), (2, "Missing_Page", "sentence_0")]
    store = spark.createDataFrame([("New_York_City", json.dumps({"sentence_0": "NYC is [[big|large]]."})),
                                   ("Paris", json.dumps({"sentence_1": "other"}))], "id string, data string")
    wiki = RD.read_wiki_store(store)
    res = EV.resolve_evidence(raw, wiki).collect()
    assert [(r["id"], r["evidence"]) for r in res] == [(1, ["NYC is large."])]
    miss = EV.unresolved_count(raw, wiki).first()
    assert (miss["missing_pages"], miss["missing_refs"]) == (1, 2)
    titles = {r["id"]: (r["titles"], r["pages"]) for r in EV.extract_titles(raw).collect()}
    assert titles[1] == (["New_York_City", "Paris"], ["New_York_City", "Paris"])


def test_shards_roundtrip_and_delimited(spark, tmp_path):
    df = spark.range(0, 25).withColumn("x", F.col("id") * 2)
    SK.write_shards(df.coalesce(1), str(tmp_path / "s"), rows_per_file=10)
    files = [f for f in (tmp_path / "s").iterdir() if f.name.startswith("part-")]
    assert len(files) == 3
    assert RD.read_shards(spark, str(tmp_path / "s"), "part-").count() == 25
    assert RD.read_shards(spark, str(tmp_path / "s"), "part-", max_chunks=1).count() == 10
    tsv = tmp_path / "t.tsv"
    tsv.write_text("1\tfalse\tsaid x\n2\ttrue\tsaid y\n")
    d = RD.read_delimited(spark, str(tsv), ("id", "label", "statement"))
    assert [tuple(r) for r in d.orderBy("id").collect()] == [("1", "false", "said x"), ("2", "true", "said y")]


def test_json_arrays_and_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "t1", "label": 1}]))
    (tmp_path / "b.json").write_text(json.dumps([{"text": "t2", "label": 0, "Unnamed: 0": 5}]))
    u = RD.read_json_array(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert u.count() == 2 and "Unnamed: 0" in u.columns
    news = json.dumps({"articles": [{"source": {"id": None, "name": "S"}, "author": "A", "title": "T",
                                     "url": "https://x/1", "publishedAt": "2024-01-01", "content": "c"}]})
    gd = json.dumps({"articles": [{"title": "G", "url": "https://y/2", "domain": "y", "seendate": "20240105T120000Z"}]})
    wk = json.dumps({"query": {"pages": {"12": {"title": "W", "pageid": 12, "extract": "e"}}}})
    df = spark.createDataFrame([(news, gd, wk)], "n string, g string, w string")
    n = RD.flatten_api_payload(df, "news", "n").first()
    g = RD.flatten_api_payload(df, "index", "g").first()
    w = RD.flatten_api_payload(df, "wiki", "w").first()
    assert (n["source"], n["url"]) == ("S", "https://x/1")
    assert (g["published_at"], g["word_count"], g["language"]) == ("2024-01-05", 0, "")
    assert (w["title"], w["page_id"]) == ("W", 12)


def test_export_and_nfkd(spark, tmp_path):
    import datetime as dt
    import unicodedata

    from factlens.functions.text import nfkd

    df = spark.createDataFrame([("é ﬁ", "a"), ("x", "b")], "text string, label string")
    path = SK.export(df, str(tmp_path), "sample", "csv", ["label"], stamp=dt.datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("sample_20240102030405")
    back = spark.read.option("header", True).csv(path)
    assert sorted(r["label"] for r in back.collect()) == ["a", "b"]
    got = [r[0] for r in df.select(nfkd("text")).collect()]
    assert got == [unicodedata.normalize("NFKD", "é ﬁ"), "x"]
