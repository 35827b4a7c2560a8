"""DuckDB SQL fragments shared by the oracle statements (same rules as the Spark side,
spelled independently in SQL)."""

from __future__ import annotations

from factlens.functions.text import sql_words

TOKEN_SPLIT_RE = r"[^\p{L}\p{N}]+"


def n_chunks_sql(nw: str, size: int, overlap: int) -> str:
    step = size - overlap
    return (f"(CASE WHEN {nw} = 0 THEN 0 WHEN {nw} <= {size} THEN 1 "
            f"ELSE ({nw} - {size} + {step - 1}) // {step} + 1 END)")


def doc_chunks_cte(size: int = 64, overlap: int = 8, name: str = "chunks") -> str:
    """documents -> chunk rows (doc_id, url, chunk_id, chunk_index, content, word_count, total_chunks)."""
    step = size - overlap
    return f"""
{name}_w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
{name}_n AS (SELECT doc_id, w, {n_chunks_sql('len(w)', size, overlap)} AS total_chunks FROM {name}_w),
{name}_e AS (SELECT doc_id, w, total_chunks, unnest(range(total_chunks)) AS i FROM {name}_n),
{name} AS (
  SELECT doc_id, 'doc:' || CAST(doc_id AS VARCHAR) AS url, md5('doc:' || CAST(doc_id AS VARCHAR) || '_' || CAST(i AS VARCHAR)) AS chunk_id,
         CAST(i AS INTEGER) AS chunk_index,
         array_to_string(list_slice(w, i * {step} + 1, i * {step} + {size}), ' ') AS content,
         CAST(len(list_slice(w, i * {step} + 1, i * {step} + {size})) AS INTEGER) AS word_count,
         CAST(total_chunks AS INTEGER) AS total_chunks
  FROM {name}_e)"""


def embed_cte(src: str, id_col: str, text_col: str, dim: int = 64, name: str = "emb") -> str:
    """Hashed bag-of-words: bucket = int(first 8 hex of md5(token)) mod dim, L2-normalised."""
    return f"""
{name}_t AS (SELECT {id_col} AS id, unnest(string_split_regex(lower({text_col}), '{TOKEN_SPLIT_RE}')) AS tok FROM {src}),
{name}_b AS (SELECT id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim} AS INTEGER) AS b, count(*)::DOUBLE AS c
             FROM {name}_t WHERE tok <> '' GROUP BY id, b),
{name}_n AS (SELECT id, sqrt(sum(c * c)) AS nrm, map(list(b), list(c)) AS m FROM {name}_b GROUP BY id),
{name} AS (SELECT id, list_transform(range({dim}), lambda i: coalesce(m[CAST(i AS INTEGER)], 0.0) / nrm) AS v
           FROM {name}_n WHERE nrm > 0)"""


def l2sim(a: str, b: str) -> str:
    return f"1 - list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
