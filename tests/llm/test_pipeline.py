"""The pipeline on the test tables, each stage against what it should do to its input."""

import collections

import pytest
from test_operators import ASSIGN, near_duplicates_by_hand, stats_by_hand


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        p = str(tmp_path_factory.mktemp("stage") / str(n))
        f(spark, docs, sf_dir).write.parquet(p)
        docs = spark.read.parquet(p)
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_clean_documents(spark, sf_dir, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    for r in stages[0].collect():
        n = stats_by_hand(r.text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        if r.doc_id in labels or failed:
            assert (r.doc_id in kept) == (not failed and labels[r.doc_id] == 1 if r.doc_id in labels else False)


def test_one_of_each_group_stays(stages):
    rows = stages[1].orderBy("doc_id").collect()
    _, roots = near_duplicates_by_hand([r.text for r in rows])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({rows[i].doc_id for i in roots})


def test_secrets_go_and_documents_stay(stages):
    before, after = ({r.doc_id: r.text for r in stages[i].collect()} for i in (2, 3))
    assert before.keys() == after.keys()
    for d, t in before.items():
        had = any(len(m[2]) >= 6 for m in ASSIGN.finditer(t))
        assert not any(len(m[2]) >= 6 for m in ASSIGN.finditer(after[d]))
        if not had and after[d] != t:
            assert "[hex]" in after[d]


def test_mixture_keeps_all_and_packing_too(spark, sf_dir, stages):
    assert collections.Counter(stages[3].collect()) == collections.Counter(stages[4].collect())
    pieces = stages[5].collect()
    total = collections.Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert total == {r.doc_id: r.doc_tokens for r in pieces}
    assert set(total) == {r.doc_id for r in stages[4].collect()}


def test_run_equals_its_stages(spark, sf_dir, stages):
    import corpus_pipeline

    ids = lambda df: sorted({r.doc_id for r in df.select("doc_id").collect()})
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(stages[5])


def test_sequences_follow_the_mixture(spark, tmp_path, monkeypatch):
    """Shares of run()'s result by sequence_id, over files of unequal size and sources of unequal lengths."""
    import numpy as np

    import corpus_pipeline
    from folioflow.llm import mixing

    rng = np.random.default_rng(7)
    rows = [(i, " the" * int(rng.integers(2200, 5000) if i % 5 else rng.integers(100, 1500)), "en", "long" if i % 5 else "short", 0) for i in range(2000)]
    for part in (rows[:1400], rows[1400:1500], rows[1500:]):
        df = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
        place = {r.doc_id: r.mix.position for r in mixing.placed(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pieces.groupby("doc_id").length.sum().to_dict() == {r[0]: len(r[1]) // 4 + 1 for r in rows}
    ordered = sorted(rows, key=lambda r: place[r[0]])
    tokens = np.array([len(r[1]) // 4 + 1 for r in ordered])
    short = np.append(0, np.cumsum(tokens * np.array([r[3] == "short" for r in ordered])))
    at = np.append(0, np.cumsum(tokens))
    pieces = pieces.sort_values("sequence_id")
    run = pieces.sequence_id.rank(method="dense").astype(int).sub(1) // 184
    assert run.max() > 10
    end = 0
    for _, g in pieces.groupby(run):
        begin, end = end, end + g.length.sum()
        want = (np.interp(end, at, short) - np.interp(begin, at, short)) / (end - begin)
        got = g.length[g.doc_id % 5 == 0].sum() / (end - begin)
        assert abs(got - want) < 0.05
