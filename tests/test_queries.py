"""Every threading query against its SQL, and hand-computed cases of the rules."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import community, metrics, pairs, text, tuning
from skein.plans import registry
from skein.plans.articles import Settings, articles


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    return sorted([tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, data, duck, name):
    found = registry.queries()[name](spark, data)
    rows = found.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(found.columns)
    at = [rel.columns.index(c) for c in found.columns]
    assert plain(rows) == plain([[r[i] for i in at] for r in rel.fetchall()])


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, weight double").withColumn("src_pos", F.col("src")).withColumn("dst_pos", F.col("dst"))


def threads_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["thread_id"], set()).add(r["node"])
    return sorted(map(sorted, out.values()))


def test_trim_and_cut(spark):
    e = edges(spark, [(1, 2, 0.30), (1, 3, 0.40), (2, 3, 0.35), (3, 4, 0.50), (3, 5, 0.20), (6, 7, 0.10)])
    assert threads_of(community.communities(e, Settings())) == [[1, 2], [3, 4, 5], [6, 7]]


@pytest.mark.parametrize(("scope", "threads"), [("first", 99), ("component", 98)])
def test_auto_threshold_scope(spark, scope, threads):
    weight = lambda i: {2: 0.10, 3: 0.11}.get(i, 0.3 if i % 2 == 0 else 0.9)
    rows = [(-2, -1, 0.5)] + [(i // 2, i, weight(i)) for i in range(2, 203)]
    found = threads_of(community.communities(edges(spark, rows), Settings(auto_scope=scope)))
    assert len([t for t in found if t[0] > 0]) == threads


def test_zero_weight_is_no_edge(spark):
    found = community.best_parents(edges(spark, [(1, 3, 0.0), (2, 3, 0.4)])).collect()
    assert [tuple(r) for r in found] == [(3, 2, 0.4)]


def points(spark, rows):
    return spark.createDataFrame([(i, [math.cos(a), math.sin(a)], float(s), 0, i) for i, a, s in rows], "doc_id long, emb array<double>, sec double, part_id int, doc_pos long")


def test_equal_times_give_no_pair(spark):
    assert pairs.similar_pairs(points(spark, [(0, 0.0, 5), (1, 0.0, 5)]), Settings()).count() == 0


def test_band_loses_no_pair(spark):
    rows = [(i, (i * 37 % 100) / 50, i * i % 97 + i) for i in range(60)]
    rows.sort(key=lambda r: r[2])
    rows = [(i, a, s) for i, (_, a, s) in enumerate(rows)]
    span = rows[-1][2] - rows[0][2]
    got = {(r["src"], r["dst"]) for r in pairs.similar_pairs(points(spark, rows), Settings(alpha=10.0, w=0.7)).collect()}
    want = {(i, j) for i, a, s in rows for j, b, t in rows if i < j and 1 - math.cos(a - b) * math.exp(-10 * abs(s - t) / span) < 0.7}
    assert got == want and want


def test_agreement(spark):
    df = spark.createDataFrame(list(zip([1, 1, 2, 2, 2], [0, 0, 0, 1, 1], strict=True)), "t int, p int")
    h, n = metrics.agreement(df, "t", "p").first()
    assert h == pytest.approx(0.4325381) and n == pytest.approx(0.4325381)
    assert metrics.agreement(df.withColumn("t", F.lit(1)), "t", "p").first()[0] == 1.0


def test_diversity(spark):
    docs = spark.createDataFrame([(0, ["x", "y"]), (1, ["x", "z"]), (2, ["q"])], "text_id long, tokens array<string>")
    members = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 2, 2)], "thread_id long, doc_id long, text_id long")
    got = {r[0]: r[1] for r in text.diversity(members, docs).collect()}
    assert got[1] == pytest.approx(math.log(3)) and math.isnan(got[2])


def test_grid_sizes(spark):
    assert tuning.grid(spark).count() == 330 and tuning.grid(spark, quick=False).count() == 1650


def test_positions_over_several_partitions(spark, tmp_path):
    n, d = 50_000, str(tmp_path)
    when = F.timestamp_seconds(F.lit(1.6e9) + F.col("id") * 7919 % (2 * n))
    spark.range(2 * n).select(F.col("id").alias("event_id"), when.alias("ts")).write.parquet(f"{d}/events.parquet")
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (F.xxhash64("id", k) % 1000).cast("float"))
    spark.range(n).select(F.col("id").alias("vec_id"), vector.alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{d}/embeddings.parquet")
    spark.range(100).select(F.col("id").alias("doc_id")).write.parquet(f"{d}/documents.parquet")
    rows = articles(spark, d).select("doc_id", "doc_pos", F.size("emb")).collect()
    order = sorted(range(n), key=lambda i: (2 * i * 7919 % (2 * n), i))
    assert sorted((r["doc_pos"], r["doc_id"]) for r in rows) == list(enumerate(order))
