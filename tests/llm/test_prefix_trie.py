"""The trie against SQL and against sets of prefixes kept by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest


def by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    paths, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        s = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(s) + 1):
            paths[s[:d]].append(c)
        ends[s].append(c)
    children = defaultdict(int)
    for p in paths:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in paths.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (m[0], len(p), paths[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in paths.items()
    )


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, `key` string, at string, node int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "a", 1) for r in rows], SCHEMA)


def test_query_equals_sql(spark, sf_dir):
    from oracle import compare, connect

    from folioflow.llm.prefix_trie import op11_prefix_trie
    from folioflow.llm.sql import OP11_SQL

    compare(spark, connect(sf_dir), op11_prefix_trie, OP11_SQL, sf_dir)


@pytest.mark.parametrize("local", [0, 12, 10_000])
def test_refinement_by_spark_and_in_tasks(spark, local):
    """A hot conversation, shared heads, ties, nulls, turnless ones; every class split by Spark, some, or none."""
    from folioflow.llm.prefix_trie import prefix_trie

    rng = random.Random(5)
    rows = []
    for c in range(60):
        n = rng.randint(1, 11)
        for t in range(n):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "ünï"])))
    for c in range(100, 140):
        rows += [(c, t, "user", f"same {t}") for t in range(10)]
    rows += [(7, 1, "user", "tie")] * 3 + [(None, 1, "user", "lost"), (301, 0, "user", "x" * 50_000)]
    assert found(prefix_trie(frame(spark, rows), local)) == by_hand(rows)


def test_small_tables(spark):
    from folioflow.llm.prefix_trie import prefix_trie

    assert prefix_trie(frame(spark, [(1, 1, "user", "x")]).limit(0)).collect() == []
    for rows in ([(5, 0, "user", "x"), (5, 1, "user", "y")], [(1, 0, "user", "x")], [(None, 0, "user", "x")], [(11, 0, None, None), (12, None, None, None)]):
        for local in (0, 100):
            assert found(prefix_trie(frame(spark, rows), local)) == by_hand(rows)
