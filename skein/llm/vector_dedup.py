"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, table look-ups, exact rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Scratch, connected_components
from skein.llm.topk import usable

#: Bounds of what is fitted on the driver: vectors in the sample, coarse lists, codewords of a subspace.
SAMPLE, MAX_LISTS, WORDS, SUBSPACES = 32_768, 4096, 256, 8
MEMBERS, PROBES = 2048, 4096
#: A vector visits a list unless the border between it and its own list is further than this many standard deviations of
#: what a difference of the largest linked length, in a random direction, moves across that border.
SIGMAS = 4.0


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, unit: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centers))
        full = count > 0
        centers[full] = sums[full] / count[full, None]
        if unit:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half, out = (centers * centers).sum(1) / 2, np.empty(len(x), np.int64)
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = (x[at : at + 8192] @ centers.T - half).argmax(1)
    return out


class Index:
    """Coarse centers and residual codebooks. ``bounds``: columns of each subspace."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centers = _kmeans(sample, lists, 12, 1, True)
        residual = sample - self.centers[_nearest(sample, self.centers)]
        dim = sample.shape[1]
        self.bounds = [(i * dim // SUBSPACES, (i + 1) * dim // SUBSPACES) for i in range(SUBSPACES)]
        self.books = [_kmeans(residual[:, a:b], WORDS, 8, 2 + i, False) for i, (a, b) in enumerate(self.bounds)]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, left = np.empty((len(residual), SUBSPACES), np.uint8), np.zeros(len(residual))
        for i, (a, b) in enumerate(self.bounds):
            codes[:, i] = _nearest(residual[:, a:b], self.books[i])
            left += ((residual[:, a:b] - self.books[i][codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of exact residuals to coded ones, by table look-up."""
        out = np.zeros((len(residual), len(codes)), np.float32)
        for i, (a, b) in enumerate(self.bounds):
            r, book = residual[:, a:b], self.books[i]
            table = ((r * r).sum(1)[:, None] - 2 * r @ book.T + (book * book).sum(1)).astype(np.float32)
            out += table[:, codes[:, i]]
        return out


def _matrix(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["vec"]), "<f8").reshape(len(pdf), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors whose squares could leave the range of doubles are divided by their largest component; cosines stay."""
    most = np.abs(x).max(1)
    return x / np.where((most < 1e-100) | (most > 1e100), most, 1.0)[:, None]


def _assign(index: Index, dim: int, reach: float):
    """Rows (id, mult, vec array) to a member row of the own list and probe rows of the lists to visit.

    Of two lists only the smaller number visits the other, so no pair is met twice.
    """
    between = np.sqrt(np.maximum(0, 2 - 2 * index.centers @ index.centers.T))
    margin = SIGMAS * reach / np.sqrt(dim) * between

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                raw = np.zeros((len(part), dim))
                for i, v in enumerate(part["vec"]):
                    raw[i, : len(v)] = v
                raw = _scaled(raw)
                x = _unit(raw)
                near = x @ index.centers.T
                own = _nearest(x, index.centers)
                codes, left = index.encode(x - index.centers[own])
                rows, to = np.nonzero((near[np.arange(len(x)), own][:, None] - near <= margin[own]) & (np.arange(near.shape[1]) > own[:, None]))
                rows, to = np.r_[np.arange(len(x)), rows], np.r_[own, to]
                ids, mult, vec = part["id"].to_numpy(), part["mult"].to_numpy(), [v.tobytes() for v in raw]
                yield pd.DataFrame({"member": True, "list": own, "home": own, "id": ids, "mult": mult, "vec": vec, "code": [c.tobytes() for c in codes], "err": left})
                yield pd.DataFrame({"member": False, "list": to, "home": own[rows], "id": ids[rows], "mult": mult[rows], "vec": [vec[r] for r in rows], "code": None, "err": 0.0})

    return run


def compare_group(index: Index, dim: int, least: float, members: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    """Links between probes and members of one list: counts for each row, and a star for each linked set."""
    none = pd.DataFrame({"id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64")})
    if not len(members) or not len(probes):
        return none
    y, x = _matrix(members, dim), _matrix(probes, dim)
    y_ids, x_ids, home = members["id"].to_numpy(), probes["id"].to_numpy(), probes["home"].to_numpy()
    here = int(members["list"].iloc[0])
    codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), SUBSPACES)
    yy, xx = (y * y).sum(1), (x * x).sum(1)
    reach = np.sqrt(2 - 2 * least)
    bound = ((reach + members["err"].to_numpy() + 1e-4) ** 2).astype(np.float32)
    residual = _unit(x) - index.centers[here]
    hits = np.zeros((len(x), len(y)), bool)
    for at in range(0, len(x), 256):
        r = slice(at, at + 256)
        # |x - y| <= reach implies |x - coded y| <= reach + |y - coded y|: the tables drop no link.
        maybe = index.distances(residual[r], codes) <= bound
        maybe &= (home[r] != here)[:, None] | (x_ids[r][:, None] < y_ids[None, :])
        i, j = np.nonzero(maybe)
        for s in range(0, len(i), 32_768):
            p, q = i[s : s + 32_768] + at, j[s : s + 32_768]
            ok = np.einsum("ij,ij->i", x[p], y[q]) / np.sqrt(xx[p] * yy[q]) >= least
            hits[p[ok], q[ok]] = True
    xs, ys = np.flatnonzero(hits.any(1)), np.flatnonzero(hits.any(0))
    if not len(xs):
        return none
    hits = hits[np.ix_(xs, ys)]
    x_label, y_label = x_ids[xs], y_ids[ys]
    big = np.iinfo(np.int64).max
    while True:  # labels fall to the smallest id of each linked set
        new_y = np.minimum(y_label, np.array([x_label[h].min(initial=big) for h in hits.T]))
        new_x = np.minimum(x_label, np.array([new_y[h].min(initial=big) for h in hits]))
        if (new_x == x_label).all() and (new_y == y_label).all():
            break
        x_label, y_label = new_x, new_y
    n_x, n_y = hits @ members["mult"].to_numpy()[ys], hits.T @ probes["mult"].to_numpy()[xs]
    return pd.DataFrame({"id": np.r_[x_ids[xs], y_ids[ys]], "n": np.r_[n_x, n_y], "other": np.r_[x_label, y_label]})


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links of vectors with a cosine of at least ``least`` in double precision.

    Returns one row per input row: ``vec_id long, n_links long, component_id long, kept boolean``. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with a null id, link with nothing (component: own id; a null
    id is kept). Repeated vectors link with each other; shorter vectors are read as padded with zeros. A vec_id that repeats
    with other vectors has all their links: its rows share a component, each with the number of links of its own vector.
    Other columns are not read.

    Equal vectors collapse to one, counted by their number. Centers and codebooks are fitted on at most SAMPLE
    vectors; every vector is then assigned, coded and compared. Visits to other lists follow SIGMAS: this alone can lose a
    link (measured recall: README); tables and rerank lose none. Long lists are cut into chunks, and a group of chunks
    returns counts and a star for each linked set, never its pairs.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    may_link = F.coalesce(F.col("vec_id").isNotNull() & usable("vec") & F.exists("vec", lambda x: x != 0), F.lit(False))
    good = rows.where(may_link)
    # ``least`` is the smallest vec_id of the vector, ``id`` a number of its own
    reps = good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult")).withColumn("id", F.monotonically_increasing_id())
    reps = scratch.keep(reps, "reps")
    n, dim = reps.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    if n:
        lists = int(min(MAX_LISTS, max(1, np.sqrt(n))))
        drawn = reps.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).toPandas()["vec"]
        sample = np.zeros((len(drawn), dim))
        for i, v in enumerate(drawn):
            sample[i, : len(v)] = v
        index = Index(_unit(_scaled(sample)), lists)
        reach = float(np.sqrt(2 - 2 * least))
        schema = "member boolean, list long, home long, id long, mult long, vec binary, code binary, err double"
        dealt = scratch.keep(reps.mapInPandas(_assign(index, dim, reach), schema), "dealt")
        size = {(r[0], r[1]): r[2] for r in dealt.groupBy("list", "member").count().collect()}  # at most 2 x MAX_LISTS rows
        sizes = [(i, -(-size.get((i, True), 0) // MEMBERS), -(-size.get((i, False), 0) // PROBES)) for i in range(lists) if size.get((i, True), 0)]
        sized = lambda df: df.join(F.broadcast(spark.createDataFrame(sizes, "list long, m int, p int")), "list")  # noqa: E731  at most MAX_LISTS rows
        salt = lambda of: F.pmod(F.xxhash64("id", F.lit(7)), F.col(of)).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        members = sized(dealt).where("member and p > 0").withColumn("chunk", salt("m")).withColumn("turn", each("p"))
        probes = sized(scratch.again(dealt, "dealt")).where("not member").withColumn("turn", salt("p")).withColumn("chunk", each("m"))
        by = ["list", "chunk", "turn"]
        got = members.groupBy(by).cogroup(probes.groupBy(by)).applyInPandas(lambda a, b: compare_group(index, dim, least, a, b), "id long, n long, other long")
        got = scratch.keep(got, "links")
        scratch.drop("dealt")
    else:
        got = spark.createDataFrame([], "id long, n long, other long")
    edges, own = got.select("id", "other"), scratch.again(reps, "reps")
    several = good.select("vec_id", F.xxhash64("vec").alias("h")).groupBy("vec_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("vec_id")
    if not several.isEmpty():  # vectors of one vec_id are tied
        tied = scratch.keep(good.join(several, "vec_id", "left_semi").join(own.select("vec", "id"), "vec").select("vec_id", "id").distinct(), "tied")
        edges = edges.unionByName(tied.join(tied.groupBy("vec_id").agg(F.min("id").alias("other")), "vec_id").select("id", "other"))
    components = scratch.keep(connected_components(edges, scratch, "id", "other").withColumnRenamed("node", "id"), "components")
    names = components.join(own.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("c"))
    links = got.groupBy("id").agg(F.sum("n").alias("n"))
    classes = reps.join(links, "id", "left").join(components.join(names, "component").select("id", "c"), "id", "left")
    classes = classes.where("n is not null or c is not null or mult > 1")
    classes = scratch.keep(classes.select("vec", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("c", "least").alias("c")), "classes")
    out = ["vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")]
    none = rows.where(~may_link).select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("c"))
    found = good.join(classes, "vec", "left").select("vec_id", "n_links", "c").unionByName(none).select(*out)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """Cosine 0.95 over the whole ``embeddings`` table."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
   WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
c AS (SELECT n, min(c) AS component_id FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""
