"""Streaming ingest with value state: the same url in one batch, across batches, after a restart and behind the
watermark; responses per batch; trending windows."""

import datetime as dt

from pyspark.sql import functions as F

from factlens.operators import chunks as C
from factlens.streaming import ingest as IN
from factlens.streaming import trending as TR

SCHEMA = "url string, full_content string, ts timestamp"
T0 = dt.datetime(2024, 1, 1, 12, 0)


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def _feed(spark, src, batches, start=0):
    for i, b in enumerate(batches, start):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(str(src / f"b{i}"))


def _stream(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))


def _ingest(spark, src, tmp_path, **options):
    q = IN.stream_ingest_articles(spark, _stream(spark, src), str(tmp_path / "store"), str(tmp_path / "ck"), **options)
    q.awaitTermination()
    return q, spark.read.parquet(str(tmp_path / "store"))


def test_ingest_remembers_urls_and_drops_late(spark, tmp_path):
    src = tmp_path / "in"
    b1 = [("u1", "later text", _at(1)), ("u1", "a b c", _at(0)), ("u2", "d e", _at(5))]
    b2 = [("u2", "other", _at(6)), ("u3", "f g", _at(300))]
    b3 = [("u4", "late row", _at(-180)), ("u5", "h i", _at(300))]
    _feed(spark, src, (b1, b2, b3))
    q, store = _ingest(spark, src, tmp_path)
    assert IN.rows_dropped_late(q) == 1          # u4 arrived behind the watermark
    assert {(r.url, r.content) for r in store.collect()} == {("u1", "a b c"), ("u2", "d e"), ("u3", "f g"), ("u5", "h i")}
    # a restart goes on from the checkpoint: what was seen stays seen, nothing is read twice
    _feed(spark, src, ([("u1", "again", _at(310)), ("u6", "new", _at(310))],), start=3)
    _, store = _ingest(spark, src, tmp_path)
    urls = [r.url for r in store.select("url").collect()]
    assert sorted(urls) == ["u1", "u2", "u3", "u5", "u6"]


def test_ingest_equals_batch_append(spark, tmp_path):
    rows = [(f"u{i % 17}", f"text {i} " * (i % 40 + 1), _at(i)) for i in range(60)]
    _feed(spark, tmp_path / "in", [rows[i:i + 15] for i in range(0, 60, 15)])
    _, store = _ingest(spark, tmp_path / "in", tmp_path)
    batch = C.dedupe_articles(spark.createDataFrame(rows, SCHEMA), ["ts"])
    want = C.append_chunks(spark, str(tmp_path / "batch"), C.chunk_articles(batch, C.LIVE_SIZE, C.LIVE_OVERLAP))
    cols = ["chunk_id", "url", "chunk_index", "content"]
    assert sorted(map(tuple, store.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_ingest_starts_from_a_store_and_forgets_after_retention(spark, tmp_path):
    known = spark.createDataFrame([("u1", _at(0))], "url string, at timestamp")
    batches = ([("u1", "known", _at(1)), ("u2", "one", _at(2))], [("u3", "moves time on", _at(500))], [("u3", "same", _at(501))],
               [("u2", "two", _at(502)), ("u1", "fresh", _at(503))])
    _feed(spark, tmp_path / "in", batches)
    _, store = _ingest(spark, tmp_path / "in", tmp_path, known=known, retention_ms=60 * 60 * 1000)
    assert sorted((r.url, r.content) for r in store.collect()) == [("u1", "fresh"), ("u2", "one"), ("u2", "two"), ("u3", "moves time on")]


def test_replayed_batch_replaces_its_rows(spark, tmp_path):
    out = str(tmp_path / "store")
    batch = spark.createDataFrame([("u1", "a b"), ("u2", "c")], "url string, full_content string")
    for _ in range(2):
        IN.ingest_batch(out)(batch, 7)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u1", "u2"]


def test_append_version(spark, tmp_path):
    path = str(tmp_path / "versions")
    chunk = lambda *urls: C.chunk_articles(spark.createDataFrame([(u, f"text of {u}") for u in urls], "url string, full_content string"))
    C.append_version(spark, path, chunk("a", "b"), 0)
    one = C.append_version(spark, path, chunk("b", "c"), 1).collect()
    again = C.append_version(spark, path, chunk("b", "c"), 1).collect()  # a repeated batch
    C.append_version(spark, path, chunk("a", "d"), 2)
    assert sorted(r.url for r in one) == sorted(r.url for r in again) == ["a", "b", "c"]
    assert sorted((r.url, r.version) for r in C.store_as_of(spark, path, 9).collect()) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]


def test_trending_sliding(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 30)
    ev = spark.createDataFrame([("a", t0), ("a", t0), ("b", t0), ("b", t0 + dt.timedelta(hours=2))],
                               "topic string, ts timestamp")
    r = TR.trending(ev, "topic", "ts", "2 hours", "1 hour", 1)
    got = {(x["window_start"].hour, x["topic"], x["n"]) for x in r.collect()}
    assert (0, "a", 2) in got and (23, "a", 2) in got and (2, "b", 1) in got
    assert F is not None
