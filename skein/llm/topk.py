"""Exact top-k inner product search over quantised vectors, by norm-bucketed retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import Scratch

BLOCK_ROWS = 8192
QUERY_ROWS = 512
QUERY_BLOCKS_PER_GROUP = 64
FOCUS = 3
#: Blocks' lengths that the driver holds, to tell which blocks a query has to visit.
STEPS = 4096
TOP = np.iinfo(np.int64).max
BLOCK = "block int, n int, dim int, top double, kind string, ids binary, cells binary"


def usable(vector: str) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def _pack(dim: int, rows: int | None):
    """Rows (id, vec as doubles of whole value) of a partition, longest first, to one block row, or to several of ``rows``."""

    def run(batches):
        from pyspark import TaskContext

        part, ids, mats = TaskContext.get().partitionId(), [], []
        for pdf in batches:
            if len(pdf):
                mat = np.zeros((len(pdf), dim))
                for i, v in enumerate(pdf["vec"]):
                    mat[i, : len(v)] = v
                ids.append(pdf["id"].to_numpy(np.int64))
                mats.append(mat)
        if not ids:
            return
        key, mat = np.concatenate(ids), np.concatenate(mats)
        norm = np.sqrt((mat * mat).sum(1))
        order = np.lexsort((key, -norm))
        key, mat, norm = key[order], mat[order], norm[order]
        for at in range(0, len(key), rows or len(key)):
            k, m = key[at : at + (rows or len(key))], mat[at : at + (rows or len(key))]
            most = np.abs(m).max(initial=0)
            kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
            yield pd.DataFrame([(part, len(k), dim, float(norm[at]), kind, k.astype("<i8").tobytes(), m.astype(kind).tobytes())], columns=["block", "n", "dim", "top", "kind", "ids", "cells"])

    return run


def _open(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, "<i8")
    mat = np.frombuffer(row.cells, row.kind).reshape(len(ids), row.dim).astype(np.float64)
    return ids, mat, np.sqrt((mat * mat).sum(1))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole inner products: BLAS doubles while these are exact, Python integers beyond, held at the ends of a long."""
    bound = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if bound < 2**53:
        return (q @ v.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in q], dtype=object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in v], dtype=object).reshape(v.shape).T
    return np.clip(exact, -TOP, TOP).astype(np.int64)


def _best(q_ids, got, ids, k, floor):
    """Of a score matrix, each row's k highest that reach its floor; ties to smaller ids."""
    out = []
    for i in range(len(q_ids)):
        score, other = got[i], ids
        keep = other != q_ids[i]
        score, other = score[keep], other[keep]
        if len(score) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            keep = score >= max(cut, floor[i])
        else:
            keep = score >= floor[i]
        score, other = score[keep], other[keep]
        order = np.lexsort((other, -score))[:k]
        out.append((score[order], other[order]))
    return out


class Bucket:
    """Vectors of similar length, longest first, with a sorted list of the unit vectors' values for each coordinate asked."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, norm: np.ndarray):
        self.ids, self.mat, self.norm = ids, mat, norm
        self.unit = mat / np.where(norm > 0, norm, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def list_of(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of a coordinate in order, and the rows that have them; sorted once."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = self.unit[order, f], order
        return self.lists[f]

    def feasible(self, direction: np.ndarray, cosine: float, eps: float) -> tuple[int, list[tuple[int, float, float, int, int]]]:
        """The shortest range of a list, and for each focus coordinate of a direction the interval in which vectors at this
        cosine or more have it: (coordinate, low, high, first, end), shortest first."""
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS].tolist()
        spread, out = np.arccos(cosine), []
        for f in focus:
            angle = np.arccos(np.clip(direction[f], -1, 1))
            low, high = np.cos(min(np.pi, angle + spread)) - eps, np.cos(max(0.0, angle - spread)) + eps
            values = self.list_of(f)[0]
            out.append((f, low, high, int(np.searchsorted(values, low, "left")), int(np.searchsorted(values, high, "right"))))
        out.sort(key=lambda x: x[4] - x[3])
        return out[0][4] - out[0][3], out


def search_block(q_ids, q, q_norm, floor, bucket: Bucket, k):
    """Exact k best of one bucket for each query, as (query, id, score) arrays.

    ``floor`` is a score that k vectors are known to reach. From it comes the local cosine threshold of this bucket,
    floor / (query length x longest length here): over 1 prunes the bucket; else the cheaper of two candidate lists is
    verified, the length prefix or the shortest feasible range of the query's largest coordinates, cut by the others.
    """
    eps, ids, mat, norm = 1e-9, bucket.ids, bucket.mat, bucket.norm
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((floor > 0) & (q_norm > 0) & (norm[0] > 0), floor / (q_norm * norm[0]), np.where(floor > 0, 2.0, -1.0))
        need = np.where(floor > 0, floor / q_norm * (1 - eps), 0.0)
    alive = np.flatnonzero(local <= 1 + eps)
    if not len(alive):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    prefix = np.searchsorted(-norm, -need[alive], side="right")
    by_length, rows = [], []
    for i, n in zip(alive, prefix, strict=True):
        t = min(1.0, local[i])
        if t > 0.5:
            shortest, ranges = bucket.feasible(q[i] / q_norm[i], t, eps)
            if shortest < n / 2:
                f, _, _, first, end = ranges[0]
                found = bucket.list_of(f)[1][first:end]
                found = found[found < n]
                for f, low, high, _, _ in ranges[1:]:
                    x = bucket.unit[found, f]
                    found = found[(x >= low) & (x <= high)]
                if len(found):
                    (score, other) = _best(q_ids[[i]], _products(q[[i]], mat[found]), ids[found], k, floor[[i]])[0]
                    rows += [(q_ids[i], o, s) for o, s in zip(other, score, strict=True)]
                continue
        by_length.append((n, i))
    by_length.sort()
    for at in range(0, len(by_length), 128):
        part = by_length[at : at + 128]
        n, who = part[-1][0], np.array([i for _, i in part])
        if n:
            for i, (score, other) in zip(who, _best(q_ids[who], _products(q[who], mat[:n]), ids[:n], k, floor[who]), strict=True):
                rows += [(q_ids[i], o, s) for o, s in zip(other, score, strict=True)]
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.array(rows, dtype=np.int64).T)


def last_block(floor: np.ndarray, q_norm: np.ndarray, ends: np.ndarray, tops: np.ndarray) -> int:
    """The last of the blocks, numbered by falling length, that some query of a block can find a vector in; -1 if none.

    ``tops``: lengths that no vector in a block after ``ends`` (the entry before) up to its own exceeds, in order.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(floor > 0, np.where(q_norm > 0, floor / q_norm * (1 - 1e-9), np.inf), 0.0).min()
    at = int(np.searchsorted(-tops, -need, side="right")) - 1
    return int(ends[at]) if at >= 0 else -1


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query row's k best other rows by inner product of floor(scale * component).

    Returns ``query_id long, rank int, vec_id long, score long``; ties go to the smaller id. Rows whose vector is null or
    holds null or non-finite components, or whose id is null, take no part; a row is "other" if its id differs. Repeated
    rows each count as a candidate; repeated queries count once. Shorter vectors are read as padded with zeros, empty ones
    as zero vectors. Products beyond a long are held at its ends. Without vectors the result is empty.

    Vectors are dealt by length (then id, so that copies spread) to blocks of about BLOCK_ROWS rows, numbered by falling
    length. One block, of bounded size, seeds every query's threshold, and with it a block of queries goes only to the
    blocks that are long enough, and these only to where queries need them. On the driver are STEPS lengths, and a row of
    16 bytes for each QUERY_ROWS * QUERY_BLOCKS_PER_GROUP queries.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("_v"), is_query.alias("_q"))
    rows = rows.where(F.col("id").isNotNull() & usable("_v")).select("id", F.transform("_v", lambda x: F.floor(x * scale).cast("double")).alias("vec"), "_q")
    rows = rows.withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, dim, queries = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.count_if("_q")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n or not queries:
        return empty
    dealt = rows.repartitionByRange(max(1, -(-n // BLOCK_ROWS)), F.col("norm").desc(), F.col("id")).select("id", "vec")
    blocks = scratch.keep(dealt.mapInPandas(_pack(dim, None), BLOCK), "blocks")
    asked = rows.where("_q").dropDuplicates(["id"]).repartitionByRange(max(1, -(-queries // (8 * QUERY_ROWS))), F.col("norm").desc(), F.col("id")).select("id", "vec")
    asked = asked.mapInPandas(_pack(dim, QUERY_ROWS), BLOCK)
    seed = blocks.orderBy(F.col("n") <= k, F.col("top").desc(), "block").limit(1).toPandas()  # one block
    last = blocks.agg(F.max("block")).first()[0]
    step = -(-(last + 1) // STEPS)
    steps = blocks.groupBy(F.floor(F.col("block") / step).alias("s")).agg(F.max("block").alias("end"), F.max("top").alias("top")).orderBy("s").toPandas()  # at most STEPS rows
    ends, tops = steps["end"].to_numpy(), steps["top"].to_numpy()

    def with_floor(batches):
        s_ids, s_mat, _ = _open(next(seed.itertuples()))
        for pdf in batches:
            floors, lasts = [], []
            for r in pdf.itertuples():
                ids, mat, norm = _open(r)
                none = np.full(len(ids), -float(TOP))
                best = _best(ids, _products(mat, s_mat), s_ids, k, none)
                floor = np.array([float(s[-1]) if len(s) == k else -float(TOP) for s, _ in best])
                floors.append(floor.tobytes())
                lasts.append(last_block(floor, norm, ends, tops))
            yield pdf.assign(floor=floors, last=lasts)

    asked = scratch.keep(asked.mapInPandas(with_floor, BLOCK + ", floor binary, last int"), "queries")
    groups = -(-asked.count() // QUERY_BLOCKS_PER_GROUP)
    right = asked.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).drop("block").where("last >= 0")
    reach = right.groupBy("g").agg(F.max("last").alias("last"))
    left = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(F.broadcast(reach), "g").where("block <= last").drop("last")
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")

    def visit(_, bucket, queries_here):
        found = [[], [], []]
        for b in bucket.itertuples():
            here = Bucket(*_open(b))
            for r in queries_here.itertuples():
                q_ids, q, q_norm = _open(r)
                for to, x in zip(found, search_block(q_ids, q, q_norm, np.frombuffer(r.floor), here, k), strict=True):
                    to.append(x)
        a, b, c = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    found = left.groupBy("block", "g").cogroup(right.groupBy("block", "g")).applyInPandas(visit, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    """Every 50th vector's five best others over the whole ``embeddings`` table."""
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
