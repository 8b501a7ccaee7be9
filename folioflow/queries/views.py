"""The surrogate shapes of sources.tables as SQL."""

from __future__ import annotations

PAPERS = """papers AS (SELECT cast(doc_id AS VARCHAR) AS paper_id, split_part(text, chr(10), 1) AS title, [lang, source] AS categories,
  cast(DATE '2020-01-01' + cast(doc_id % 1500 AS INTEGER) AS DATE) AS published, text AS markdown FROM documents)"""
LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)"""
BLOCKS = LINES + """,
blocks AS (SELECT doc_id || ':b' || idx AS block_id, cast(doc_id AS VARCHAR) AS paper_id, cast(idx AS INTEGER) AS idx,
  ['prose', 'equation', 'code', 'table', 'caption'][idx % 5 + 1] AS type, text, 'S' || (idx // 3) AS section_path FROM lines)"""
COLLECTION = """collection AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'summary' ELSE 'chunk' END AS kind, cast(doc_id AS VARCHAR) AS paper_id, text,
  [lang, source] AS categories, cast(DATE '2020-01-01' + cast(doc_id % 1500 AS INTEGER) AS DATE) AS published, embedding
  FROM embeddings JOIN documents ON vec_id = doc_id)"""
QUESTIONS = """questions AS (SELECT item_id AS query_id, text, embedding AS vector FROM benchmark JOIN embeddings ON vec_id = item_id)"""
STATE = """last AS (SELECT user_id, arg_max(value, event_id) AS v, max(ts) AS updated_at FROM events WHERE event_type <> 'error' GROUP BY 1),
state AS (SELECT cast(user_id AS VARCHAR) AS paper_id, ['harvested', 'parsed', 'chunked', 'summarized', 'embedded', 'stored', 'done'][cast(floor(v) AS INTEGER) % 7 + 1] AS stage, updated_at FROM last)"""
FAILURES = """failures AS (SELECT cast(user_id AS VARCHAR) AS paper_id, ts, props AS error, event_id FROM events WHERE event_type = 'error')"""
QUARANTINE = FAILURES + """,
quarantine AS (SELECT paper_id, arg_min(error, event_id) AS error, min(event_id) AS event_id FROM failures GROUP BY 1),
diagnostics AS (SELECT paper_id, CASE WHEN cast(json_extract(error, '$.k') AS INTEGER) % 2 = 0 THEN 'PermanentError' ELSE 'TransientError' END AS error_type
  FROM quarantine WHERE cast(json_extract(error, '$.k') AS INTEGER) % 5 <> 0)"""


def words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\s\x1c-\x1f\x85\p{{Z}}]+'), lambda w: w <> '')"


def tokens(text: str) -> str:
    return words(f"lower({text})")


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
