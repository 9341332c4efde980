"""Shared entities and paths against a plain search, without a table of what each document reaches."""

import itertools

import numpy as np

from skein.operators import entity_graph


def slow_hops(own, a, b, most):
    seen, last = {a}, {a}
    for h in range(1, most + 1):
        last = {d for d in own if d not in seen and any(own[d] & own[x] for x in last)}
        if b in last:
            return h
        seen |= last
    return None


def test_paths_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(entity_graph, "BATCH", 100)
    rng = np.random.default_rng(4)
    own = {d: {f"e{(d + k) % 90}" for k in rng.integers(0, 3, size=rng.integers(0, 3))} for d in range(100)}
    graph = spark.createDataFrame([(d, e) for d, es in own.items() for e in es] + [(0, None)], "doc_id long, entity string")
    pairs = list(itertools.combinations(range(100), 2))
    df = spark.createDataFrame(pairs, "src long, dst long")
    counts = entity_graph.shared_counts(df, graph)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r["src"], r["dst"]): r["shared"] for r in counts.collect()} == {(a, b): len(own[a] & own[b]) for a, b in pairs}
    hops = {p: slow_hops(own, *p, 4) for p in pairs}
    found = {(r["src"], r["dst"]): r["edges"] for r in entity_graph.path_lengths(df, graph, 5).collect()}
    assert found == {p: h and 2 * h for p, h in hops.items()} and {1, 2, 3, 4, None} == set(hops.values())


def test_no_entities(spark):
    df = spark.createDataFrame([(1, 2)], "src long, dst long")
    none = spark.createDataFrame([], "doc_id long, entity string")
    assert entity_graph.path_lengths(df, none, 5).first()["edges"] is None and entity_graph.shared_counts(df, none).first()["shared"] == 0
