"""Seams for models: a Python callable becomes an Arrow function; each has a deterministic stand-in."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.session import ship

#: Texts of one call to a service.
BATCH = 32
DIM = 64
HEADER_WORDS = 130
SUMMARY_CHARS = 500


def embedder(call: Callable[[list[str]], list[list[float]]], dim: int):
    """text -> unit vector. `call` gets at most BATCH texts; a vector of another length, or of zeros, is an error."""

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), BATCH):
                for v in call([t or "" for t in texts.iloc[at : at + BATCH]]):
                    if len(v) != dim:
                        raise ValueError(f"a vector of {len(v)} instead of {dim}")
                    n = sum(x * x for x in v) ** 0.5
                    if n == 0:
                        raise ValueError("zero vector")
                    out.append([x / n for x in v])
            yield pd.Series(out)

    ship(SparkSession.active())
    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, T.ArrayType(T.DoubleType()))


def unit_vectors(call: Callable[[list[str]], list[list[float]]]) -> Callable[[list[str]], list[list[float]]]:
    """`call` held to a vector for each text, none of zeros and all numbers finite; vectors of length one."""

    def checked(texts: list[str]) -> list[list[float]]:
        vectors = [] if not texts else list(call([t or "" for t in texts]))
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        out = []
        for v in vectors:
            n = sum(x * x for x in v) ** 0.5
            if not 0 < n < float("inf"):
                raise ValueError("zero vector" if n == 0 else "a vector that is not finite")
            out.append([x / n for x in v])
        return out

    return checked


def fake_vectors(texts: list[str], dim: int = DIM) -> list[list[float]]:
    """Gaussian numbers seeded by the text's SHA-256."""
    out = []
    for t in texts:
        r = random.Random(int.from_bytes(hashlib.sha256(t.encode()).digest(), "big"))
        out.append([r.gauss(0, 1) for _ in range(dim)])
    return out


def reranker(call: Callable[[str, list[str]], list[float]]):
    """(query, text) -> score; `call` gets one query and at most BATCH texts."""

    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=text.index)
        for q, group in text.groupby(query):
            for at in range(0, len(group), BATCH):
                part = group.iloc[at : at + BATCH]
                out.loc[part.index] = call(q, list(part))
        return out

    ship(SparkSession.active())
    score.__annotations__ = {"query": pd.Series, "text": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, T.DoubleType())


def guarded(call: Callable[[list[str]], list], attempts: int = 3, permanent: tuple[type[BaseException], ...] = (ValueError,), value: T.DataType = T.StringType(), wait_s: float = 0.0):  # noqa: B008
    """text -> (ok, value, error_type, error). A batch that fails is done one by one; each is tried `attempts` times unless its error is permanent, with waits that double from `wait_s`."""
    result = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("value", value), T.StructField("error_type", T.StringType()), T.StructField("error", T.StringType())])

    def one(text: str) -> tuple:
        error: BaseException | None = None
        for n in range(attempts):
            if n and wait_s:
                time.sleep(wait_s * 2 ** (n - 1))
            try:
                return True, call([text])[0], None, None
            except permanent as e:
                return False, None, "PermanentError", str(e)
            except Exception as e:  # noqa: BLE001  what a service may raise isn't known
                error = e
        return False, None, "TransientError", str(error)

    def run(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for at in range(0, len(texts), BATCH):
            part = list(texts.iloc[at : at + BATCH])
            try:
                rows += [(True, v, None, None) for v in call(part)]
            except Exception:  # noqa: BLE001  one by one tells which text it was
                rows += [one(t) for t in part]
        return pd.DataFrame(rows, columns=["ok", "value", "error_type", "error"])

    ship(SparkSession.active())
    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, result)


def fake_summary(paper_id: Column, markdown: Column) -> Column:
    """The first characters of the trimmed text, or a note for a blank one."""
    t = F.trim(F.coalesce(markdown, F.lit("")))
    return F.when(t == "", F.concat(F.lit("[fake summary: "), paper_id, F.lit("]"))).otherwise(F.substring(t, 1, SUMMARY_CHARS))


def clamped_header(header: Column) -> Column:
    """At most HEADER_WORDS words of a generated header; blank stays blank."""
    from folioflow.functions.text import first_words

    return F.when(F.trim(header) == "", F.lit("")).otherwise(first_words(header, HEADER_WORDS))


def generated_headers(chunks: DataFrame, summaries: DataFrame, call: Callable[[list[str]], list[str]], prompt: str, attempts: int = 3, wait_s: float = 0.0) -> DataFrame:
    """id, header, error_type, error of chunks (id, paper_id, text) with their papers' summaries (paper_id, text).

    `prompt` has {summary} and {chunk}; `call` gets prompts. A blank chunk, and one without a summary, has a blank header and isn't asked about. An
    answer is cut to HEADER_WORDS words; a blank one is a failure for good of its chunk alone, whose header stays null.
    """
    said = summaries.select("paper_id", F.trim("text").alias("summary"))
    j = chunks.select("id", "paper_id", F.trim("text").alias("chunk")).join(said, "paper_id", "left")
    # the summary goes in last, so that braces in a chunk aren't taken for its place
    head, _, tail = prompt.partition("{summary}")
    put = lambda part: F.replace(F.lit(part), F.lit("{chunk}"), F.col("chunk")) if "{chunk}" in part else F.lit(part)
    asked = F.concat(put(head), F.col("summary"), put(tail))
    blank = (F.coalesce("chunk", F.lit("")) == "") | (F.coalesce("summary", F.lit("")) == "")
    to_ask = j.filter(~blank).select("id", asked.alias("prompt")).withColumn("r", guarded(call, attempts, wait_s=wait_s)("prompt"))
    empty = F.col("r.ok") & (F.trim(F.coalesce("r.value", F.lit(""))) == "")
    made = to_ask.select("id", F.when(F.col("r.ok") & ~empty, clamped_header(F.trim("r.value"))).alias("header"), F.when(empty, "PermanentError").otherwise(F.col("r.error_type")).alias("error_type"), F.when(empty, "an empty header").otherwise(F.col("r.error")).alias("error"))
    none = F.lit(None).cast("string")
    return made.unionByName(j.filter(blank).select("id", F.lit("").alias("header"), none.alias("error_type"), none.alias("error")))


def with_headers(chunks: DataFrame, headers: DataFrame) -> DataFrame:
    """`chunks` (id, text) with embed_text: the header and a blank line before the text, or the text alone; the text itself stays for word counts."""
    j = chunks.join(headers.select("id", "header"), "id", "left")
    return j.withColumn("embed_text", F.when(F.coalesce("header", F.lit("")) != "", F.concat("header", F.lit("\n\n"), "text")).otherwise(F.col("text"))).drop("header")


def parsed(documents: DataFrame, parse: Callable[[bytes], list[dict]], schema: T.StructType) -> DataFrame:
    """Rows of `schema` from documents (paper_id, content) by a parser; documents that it can't read give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"paper_id": p, **r} for p, c in zip(pdf["paper_id"], pdf["content"], strict=True) for r in parse(c)]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    ship(documents.sparkSession)
    return documents.select("paper_id", "content").mapInPandas(run, schema)
