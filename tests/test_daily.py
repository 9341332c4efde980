"""Daily steps against the rules written out in plain Python, as a run and as a stream."""

import datetime
import math

import numpy as np

from skein.operators import community
from skein.plans.articles import Settings
from skein.streaming.daily import DailyThreads

P = Settings(alpha=3.0, w=0.8)
DAYS = [(0, 3), (3, 4), (4, 5), (5, 6)]


def made():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        ts = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(hours=i * 6 * 24 / 60)
        rows.append((i, rng.normal(size=6).tolist(), i % 4, ts, ts.timestamp()))
    return rows


def slow(rows, windows):
    """Forest after all windows: nodes in order of first sight, and parents."""
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    start, edges, order = rows[0][4], {}, []
    for lo, hi in windows:
        new = [i for i, r in enumerate(rows) if lo <= (r[4] - start) / 86400 < hi]
        for s in range(max(new, default=-1) + 1):
            for t in new:
                d = 1 - x[s] @ x[t] * math.exp(-3 * abs(rows[s][4] - rows[t][4]) / (120 * 86400))
                if s < t and d < 0.8:
                    edges[(s, t)] = d
                    order += [n for n in (s, t) if n not in order]
        best = {t: min((w, s) for (s, u), w in edges.items() if u == t) for t in {t for _, t in edges}}
        forest = {(s, t): round(w, 12) for t, (w, s) in best.items()}
        root = {}
        for n in order:
            r = n
            while r in best:
                r = best[r][1]
            root[n] = r
        th, cut = None, {}
        for r in dict.fromkeys(root[n] for n in order):
            w = [v for (_, t), v in forest.items() if root[t] == r]
            if w:
                if th is None:
                    q1, q3 = np.percentile(w, [25, 75])
                    th = min(max(1.5 * (q3 - q1) * q3, 0), 100)
                cut[r] = round(np.percentile(w, th), 12)
        children = {n: sum(s == n for s, _ in forest) for n in order}
        edges = {(s, t): edges[(s, t)] for (s, t), w in forest.items() if not (w > cut[root[t]] and children[t] > 1)}
    return order, set(edges)


def check(spark, daily, rows, windows):
    order, forest = slow(rows, windows)
    last = daily._last(spark, 1 << 62)
    assert {(r["src"], r["dst"]) for r in spark.read.parquet(f"{daily.path}/forest/epoch={last}").collect()} == forest
    up = {t: s for s, t in forest}
    want = {}
    for n in order:
        r = n
        while r in up:
            r = up[r]
        want[n] = r
    assert {r["node"]: r["thread_id"] for r in daily.members(spark).collect()} == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, emb array<double>, story_id int, ts timestamp, sec double")


def test_run_follows_the_rules_and_can_repeat_a_step(spark, tmp_path):
    rows, daily = made(), DailyThreads(str(tmp_path), P)
    df = frame(spark, rows)
    daily.run(df, history_days=3, step_days=1)
    check(spark, daily, rows, DAYS)
    daily.step(df.where("ts >= '2024-01-06'"), 3)
    check(spark, daily, rows, DAYS)
    daily.step(df.limit(0), 4)
    check(spark, daily, rows, DAYS)
    logged = spark.read.json(f"{tmp_path}/metrics").collect()
    assert len(logged) == 2 and max(r["all_docs"] for r in logged) == 60


def test_stream_of_files_equals_the_run(spark, tmp_path):
    rows = made()
    start = rows[0][4]
    for k, (lo, hi) in enumerate(DAYS[:2]):
        frame(spark, [r for r in rows if lo <= (r[4] - start) / 86400 < hi]).coalesce(1).write.parquet(f"{tmp_path}/in/day={k}")
    daily = DailyThreads(f"{tmp_path}/state", P)
    stream = spark.readStream.schema("doc_id long, emb array<double>, story_id int, ts timestamp, sec double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    assert daily.follow(stream).awaitTermination(120)
    check(spark, daily, rows[:40], DAYS[:2])


def test_compose_and_induced(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.1)], "src long, dst long, weight double")
    b = spark.createDataFrame([(1, 2, 0.9)], "src long, dst long, weight double")
    assert sorted(map(tuple, community.compose([a, b]).collect())) == [(1, 2, 0.9), (2, 3, 0.1)]
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    assert [tuple(r) for r in community.induced(a, nodes).collect()] == [(1, 2, 0.5)]
