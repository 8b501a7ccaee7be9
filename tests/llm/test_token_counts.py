"""Token counts held against the vocabulary's library: whole texts, and every prefix encoded anew."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    from folioflow.llm.token_counts import Counter

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return Counter(f.read())


def test_whole_table(spark, sf_dir, library):
    from folioflow.llm.token_counts import op13_token_counts

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op13_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


PARTS = [
    "a", "b", "the", " ", "  ", "\n", "\t", "'re", "'ll", "'ve", "'s", "'", "1", "234", "!", "<|", "|>", "<|endoftext|>", "é", "ß", "𝔘", "😀", "²", "Ⅷ", "\x1c", "\xa0", " ", "\u0085", "x" * 9, "_", "don't we've", " " * 20, "中文",
    "endoftext", "ing", "tion", "\x00", "é", "٣٤",
]


def test_every_prefix(counter, library):
    rng = random.Random(7)
    for _ in range(800):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert counter.every_prefix(text).tolist() == [library(text[:i]) for i in range(1, len(text) + 1)], text
        assert counter.count(text) == library(text)


def test_random_characters_and_memory(counter, library, monkeypatch):
    """Code points of the whole range; a memory that is full all the time gives the same."""
    from folioflow.llm import token_counts

    monkeypatch.setattr(token_counts, "MEMO", 3)
    monkeypatch.setattr(token_counts, "PAIRS", 5)
    rng = random.Random(8)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    assert counter.count_all(texts) == [library(t) for t in texts]
    long = ["x" * 50_000, "long " * 20_000, " " * 30_000, "ab" * 20_000 + "<|endoftext|>" * 50]
    assert counter.count_all(long) == [library(t) for t in long]


def test_odd_rows(spark, library):
    from folioflow.llm.token_counts import with_token_counts

    rows = [(1, "one two", "a"), (1, "one two", "a"), (None, None, None), (2, "", "b"), (3, "x" * 100_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prefix string")
    out = with_token_counts(docs, "counted", prefixes=True)
    assert out.columns == ["doc_id", "text", "prefix", "counted"]
    got = sorted(((r.doc_id or 0, r.counted.n_bytes, r.counted.n_tokens, len(r.counted.prefix)) for r in out.collect()))
    assert got == [(0, 0, 0, 0), (1, 7, 2, 7), (1, 7, 2, 7), (2, 0, 0, 0), (3, 100_000, library("x" * 100_000), 100_000)]
    assert with_token_counts(docs.limit(0)).collect() == []
    assert with_token_counts(docs.withColumnRenamed("prefix", "Tokens"), "tokens").columns == ["doc_id", "text", "tokens"]


def test_truncation_and_budgets(spark, library):
    """Answers from the stored counts alone, against encoding every prefix."""
    from folioflow.llm.token_counts import most_within, tokens_before, truncated, with_token_counts

    texts = ["hello world, it's fine", "we're  here\n\n now", "<|endoftext|>x", "", "ünï 𝔘x hello"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    c = with_token_counts(docs, "c", prefixes=True)
    for budget in (0, 1, 2, 3, 5, 50):
        for r in c.select("text", most_within(F.col("c.prefix"), budget).alias("n"), truncated(F.col("text"), F.col("c.prefix"), budget).alias("t"), tokens_before(F.col("c.prefix"), budget).alias("before")).collect():
            best = max(i for i in range(len(r.text) + 1) if library(r.text[:i]) <= budget)
            assert (r.n, r.t, r.before) == (best, r.text[:best], library(r.text[:budget]))
