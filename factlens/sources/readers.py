"""Sources: S1 read_shards, S2 read_delimited, S3 read_json_array, S4
read_evidence_jsonl, S5 read_wiki_store, S6 flatten_api_payload.

All readers are lazy DataFrame scans with explicit schemas where the shape is
known (no inference pass over the data)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.functions.text import parse_seen_date
from factlens.operators.evidence import EVIDENCE_SCHEMA


def _list_files(spark: SparkSession, directory: str, prefix: str, suffix: str = ".parquet") -> list[str]:
    """File names under ``directory`` (metadata listing through the Hadoop FS)."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    return sorted(n for n in names if n.startswith(prefix) and n.endswith(suffix))


def read_shards(spark: SparkSession, directory: str, prefix: str, max_chunks: int | None = None) -> DataFrame:
    """The parquet shards ``prefix*.parquet`` of a folder in name order; with
    ``max_chunks`` only the first n shards are read (partial runs)."""
    names = _list_files(spark, directory, prefix)
    if max_chunks is not None:
        names = names[:max_chunks]
    if not names:
        raise FileNotFoundError(f"no {prefix}*.parquet under {directory}")
    base = directory.rstrip("/")
    return spark.read.parquet(*[f"{base}/{n}" for n in names])


# The 14 declared columns of the statement TSV.
STATEMENT_COLUMNS = ("id", "label", "statement", "subject", "speaker", "speaker_job_title", "state", "party",
                     "barely_true_counts", "false_counts", "half_true_counts", "mostly_true_counts",
                     "pants_on_fire_counts", "context")


def read_delimited(spark: SparkSession, path: str, columns=STATEMENT_COLUMNS, sep: str = "\t",
                   header: bool = False) -> DataFrame:
    """Headerless delimited text with declared (string) columns; with
    ``header=True`` the file's header is skipped and the declared names kept."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
            .option("multiLine", True).option("escape", '"').csv(path))


def read_json_array(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """S3: files each holding one JSON array of objects, unioned by field name. Without a schema all files are read as VARIANT in one
    job and their fields merged by an aggregate; a field of several types, or of none, becomes a string."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        return r.schema(schema).json(paths)
    arrays = r.option("singleVariantColumn", "array").json(paths)
    items = arrays.lateralJoin(spark.tvf.variant_explode(F.col("array").outer())).select("value")
    merged = items.agg(F.schema_of_variant_agg("value")).first()[0]
    if not merged.startswith("OBJECT<"):  # no object in any file
        return spark.createDataFrame([], T.StructType([]))
    ddl = re.sub(r"(: |ARRAY<)(?:VOID|VARIANT)(?=[,>])", r"\1STRING", merged).replace("OBJECT<", "STRUCT<")
    return items.select(F.col("value").cast(ddl).alias("o")).select("o.*")


def read_evidence_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One claim record per line (blank lines are skipped by the JSON source);
    malformed lines are kept as nulls with ``_corrupt_record`` rather than failing."""
    schema = T.StructType(EVIDENCE_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def read_wiki_store(df: DataFrame, id_col: str = "id", data_col: str = "data") -> DataFrame:
    """Page store rows (id, JSON object ``sentence_<n>`` -> text) as
    ``id, sentences MAP<STRING,STRING>``. ``df`` is any scan of the store (parquet,
    JDBC with partitioned reads, ...)."""
    return df.select(F.col(id_col).alias("id"), F.from_json(F.col(data_col), "map<string,string>").alias("sentences"))


NEWS_PAYLOAD = ("struct<articles:array<struct<source:struct<id:string,name:string>,author:string,title:string,"
                "description:string,url:string,urlToImage:string,publishedAt:string,content:string>>>")
INDEX_PAYLOAD = ("struct<articles:array<struct<title:string,url:string,url_mobile:string,domain:string,"
                 "seendate:string,language:string,wordcount:bigint,socialimage:string>>>")
WIKI_PAYLOAD = "struct<query:struct<pages:map<string,struct<title:string,pageid:bigint,extract:string>>>>"


def flatten_api_payload(df: DataFrame, kind: str, payload_col: str = "payload") -> DataFrame:
    """Landed API responses (one JSON document per row) to article rows."""
    if kind == "news":
        p = df.select(F.from_json(payload_col, NEWS_PAYLOAD).alias("p"))
        a = p.select(F.explode_outer("p.articles").alias("a")).where(F.col("a").isNotNull())
        return a.select(F.col("a.url").alias("url"), F.col("a.title").alias("title"),
                        F.col("a.source.name").alias("source"), F.col("a.author").alias("author"),
                        F.col("a.publishedAt").alias("published_at"), F.col("a.description").alias("description"),
                        F.col("a.content").alias("content"))
    if kind == "index":
        p = df.select(F.from_json(payload_col, INDEX_PAYLOAD).alias("p"))
        a = p.select(F.explode_outer("p.articles").alias("a")).where(F.col("a").isNotNull())
        return a.select(F.coalesce("a.url", F.lit("")).alias("url"), F.coalesce("a.title", F.lit("")).alias("title"),
                        F.coalesce("a.domain", F.lit("")).alias("source"),
                        parse_seen_date(F.col("a.seendate")).alias("published_at"),
                        F.coalesce("a.language", F.lit("")).alias("language"),
                        F.coalesce("a.wordcount", F.lit(0)).alias("word_count"),
                        F.coalesce("a.socialimage", F.lit("")).alias("social_image"))
    if kind == "wiki":
        p = df.select(F.from_json(payload_col, WIKI_PAYLOAD).alias("p"))
        first = F.element_at(F.map_values("p.query.pages"), 1)
        return p.select(first["title"].alias("title"), first["pageid"].alias("page_id"),
                        first["extract"].alias("content")).where(F.col("title").isNotNull())
    raise ValueError(kind)
