"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, for every operator and stage."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, stats string, kept string, mix string, row string, tag string, __row string, k1 int, band int, score string, language string, secrets string, pii string, cut string, fingerprint string"


@pytest.fixture(scope="module")
def odd(spark):
    words = " ".join(f"word{i % 90}x{i % 7}" for i in range(400))
    base = [
        (1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, words + " more", "en", None, 5), (None, "null id here", None, "a", None), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "fr", "b", 0),
        (5, "   \n\t ", "fr", "b", 6), (6, "𝔘😀 ünïcode\x00nul", "de", "b", 3), (7, "long " * 60_000, "de", "a", 9), (8, "x" * 300_000, "de", "a", 9), (9, "one", "xx", "c", 3),
    ]
    rest = ["c", "c", "c", "c", "c", "c", "c", 1, 1, "c", "c", "c", "c", "c", "c"]
    return spark.createDataFrame([(*r, *rest) for r in base], SCHEMA)


def operators(spark):
    import corpus_pipeline
    from folioflow.llm import fingerprints, language_id, mixing, ngram_join, packing, pii, quality_classifier, quality_rules, secrets, suffix_dedup

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    return {
        "language": lambda d: language_id.with_language(d, language_id.train(d)),
        "fingerprint": fingerprints.with_fingerprint,
        "edited": fingerprints.edited_fingerprints,
        "repeats": suffix_dedup.remove_repeats,
        "pii": pii.find_personal_data,
        "secrets": secrets.with_secrets,
        "near": ngram_join.near_duplicates,
        "packing": packing.pack,
        "mixing": mixing.placed,
        "classifier": lambda d: quality_classifier.with_score(d, quality_classifier.train(d, labels)),
        **{f"stage {n}": (lambda f: lambda d: f(spark, d, ""))(f) for n, f in corpus_pipeline.STAGES},
    }


NAMES = ["language", "fingerprint", "edited", "repeats", "pii", "secrets", "near", "packing", "mixing", "classifier", "stage quality rules", "stage n-gram Jaccard join", "stage secret scans", "stage mixing sources to target weights", "stage packing"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd, name):
    assert operators(spark)[name](odd.limit(0)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    out = operators(spark)[name](odd)
    rows = out.collect()
    if name in ("language", "fingerprint", "edited", "repeats", "pii", "secrets", "near", "mixing", "classifier", "stage secret scans", "stage mixing sources to target weights"):
        assert len(rows) == 12
    if name.startswith("stage") and name != "stage packing":
        assert out.columns == odd.columns
    if name == "language":
        said = {r.doc_id: r.language for r in rows if r.doc_id is not None}
        assert said[3].lang_pred == said[4].lang_pred == said[5].lang_pred == "und" and said[1].lang_pred == "en"
    elif name == "repeats":
        cut = {r.doc_id: r.cut for r in rows}
        assert len(cut[1].kept) == len(cut[7].kept) == len(cut[8].kept) == 0 and cut[4].n_bytes == 0 and cut[3].spans == []
        assert bytes(cut[2].kept) == b"" or len(cut[2].kept) < 400
    elif name == "near":
        cls = {r.doc_id: (r.class_id, r.n_links) for r in rows if r.doc_id is not None}
        assert cls[1] == (1, 2) and cls[2] == (1, 2) and cls[3] == cls[4] == (3, 2)
        assert cls[5] == (5, 0)
    elif name == "packing":
        assert sum(r.length for r in rows if r.start == 0) >= 12 and {r.doc_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    elif name == "classifier":
        assert all(0 <= r.score <= 1 for r in rows)
    elif name == "stage quality rules":
        assert {r.doc_id for r in rows} <= {1, 2, 7, 8} and {1, 2} <= {r.doc_id for r in rows}
    elif name == "stage n-gram Jaccard join":
        assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 3, 5, 6, 7, 8, 9] and len(rows) == 8
    elif name == "stage packing":
        assert {r.doc_id for r in rows} == {None, *range(1, 10)}


def test_edited_of_a_single_row(spark):
    from folioflow.llm.fingerprints import edited_fingerprints

    r = edited_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(r) == 1 and r[0].near_next == 1.0


def test_sketches():
    import numpy as np

    from folioflow.llm.fingerprints import Sketch

    rng = np.random.default_rng(1)
    big = np.unique(rng.integers(0, 2**64, 40_000, dtype=np.uint64))
    small = np.sort(rng.choice(big, 400, replace=False))
    a, b = Sketch.of(big), Sketch.of(small)
    assert Sketch.parse(a.text()).text() == a.text()
    assert abs(b.containment(a) - 1) < 1e-9 and abs(a.containment(b) - 0.01) < 0.01
    assert a.merged(b).text() == a.text()
    one, two = Sketch.of(big[:20_000]), Sketch.of(big[20_000:])
    assert one.merged(two).hashes.tolist() == a.hashes.tolist()
    none = Sketch.of(np.zeros(0, np.uint64))
    assert none.likeness(none) == 1.0 and none.likeness(b) == 0.0 and none.containment(b) == 1.0
