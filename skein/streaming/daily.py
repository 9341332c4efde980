"""Threads kept up to date as days of articles arrive.

The graph is global, as components span keys, so its state is in tables and each batch is one step. Every step writes
folders named by its number and reads only those of lower numbers: a batch that is run again after a failure overwrites its
own folders and sees the same state as before.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from skein.operators import community, entity_graph, evaluation, pairs, threads
from skein.plans.articles import SELECTION, Settings, with_positions
from skein.sources.files import append_metrics

DAY = 86_400.0
SNAPSHOT = 100


class DailyThreads:
    """Articles ``doc_id, emb, story_id, ts, sec`` in time order, day by day, under the folder ``path``.

    New articles meet those of the past within the reach of the decay, over a fixed span of ``span_days``; their edges join
    the pruned forest, which is pruned again as a whole. An edge that was cut never comes back. ``entities(doc_id, entity)``
    is needed with ``p.ent``.
    """

    def __init__(self, path: str, p: Settings, span_days: float = 120.0, entities: DataFrame | None = None):
        self.path, self.p, self.span, self.entities = path, p, span_days * DAY, entities

    def _read(self, spark: SparkSession, name: str, below: int) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{name}").where(F.col("epoch") < below)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _last(self, spark: SparkSession, below: int) -> int | None:
        found = self._read(spark, "nodes", below)
        return None if found is None else found.agg(F.max("epoch")).first()[0]

    def _put(self, df: DataFrame, name: str, epoch: int) -> DataFrame:
        path = f"{self.path}/{name}/epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)

    def step(self, batch: DataFrame, epoch: int) -> None:
        """Takes the articles of one batch into the state; a batch without articles changes nothing."""
        spark, p = batch.sparkSession, self.p
        past, last = self._read(spark, "articles", epoch), self._last(spark, epoch)
        n = 0 if past is None else past.count()
        columns = ["doc_id", "emb", "story_id", "ts", "sec", "doc_pos"]
        new = with_positions(batch.select(*columns[:-1]), "ts", "doc_id").withColumn("doc_pos", F.col("doc_pos") + n)
        new = self._put(new.select(*columns), "articles", epoch)
        first = new.agg(F.min("sec")).first()[0]
        if first is None:
            return
        reach = self.span * math.log(1 / (1 - p.w)) / p.alpha * (1 + 1e-9) if p.td and p.alpha > 0 and 0 < p.w < 1 else math.inf
        near = new
        if past is not None:
            near = new.unionByName((past if reach == math.inf else past.where(F.col("sec") >= first - reach)).select(*columns))
        edges = pairs.similar_pairs(near.withColumn("part_id", F.lit(0)), p, span=self.span, sources=new, forest=not p.ent)
        if p.ent:
            graph = self.entities.join(new.select("doc_id") if past is None else past.select("doc_id").unionByName(new.select("doc_id")), "doc_id", "left_semi")
            edges = entity_graph.entity_weighted(edges, graph, p)
        else:
            edges = edges.withColumn("weight", F.col("distance"))
        edges = edges.select("src", "dst", "src_pos", "dst_pos", "weight")
        before = None
        if last is not None:
            at = lambda name: spark.read.parquet(f"{self.path}/{name}/epoch={last}")
            edges, before = at("forest").unionByName(edges), at("nodes").select("node", F.struct(F.col("place").alias("s"), F.lit(-1).cast("long").alias("o"), F.lit(-1).alias("e")).alias("seen"))
        edges = self._put(edges, "edges", epoch)
        seen, forest = community.prune(edges, p, before)
        kept = edges.join(forest.select(F.col("parent").alias("src"), F.col("node").alias("dst")), ["src", "dst"], "left_semi")
        self._put(kept.select(*edges.columns), "forest", epoch)
        # nodes seen earlier come first: their place is below that of any node of this step
        rank = with_positions(seen.withColumn("old", F.coalesce(F.col("seen.o") < 0, F.lit(False))), "seen", "node")
        self._put(rank.select("node", (F.col("doc_pos") - F.lit(1 << 40)).alias("place")), "nodes", epoch)
        self._drop(spark, "edges", epoch)
        if last is not None and last % SNAPSHOT:
            for name in ("forest", "nodes"):
                # the state before the last stays until the next step, as this one may be run again
                self._drop(spark, name, last - 1)

    def _drop(self, spark: SparkSession, name: str, epoch: int) -> None:
        if epoch < 0 or (name != "edges" and epoch % SNAPSHOT == 0):
            return
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/epoch={epoch}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def members(self, spark: SparkSession) -> DataFrame:
        """``node, thread_id`` as of the last step."""
        last = self._last(spark, 1 << 62)
        at = lambda name: spark.read.parquet(f"{self.path}/{name}/epoch={last}")
        return community.forest_roots(at("nodes"), at("forest").select(F.col("dst").alias("node"), F.col("src").alias("parent"))).withColumnRenamed("root", "thread_id")

    def articles(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/articles")

    def ordered(self, spark: SparkSession) -> DataFrame:
        return threads.ordered(self.members(spark), self.articles(spark))

    def evaluate(self, spark: SparkSession, day: str) -> None:
        """Puts the record of the documents seen so far into the log under ``metrics``, in place of an earlier one of this
        last step: a step that is run again is logged once."""
        ranges = dataclasses.replace(self.p, **SELECTION)
        append_metrics(evaluation.evaluate(self.ordered(spark), self.articles(spark), ranges).withColumn("day", F.lit(day)), f"{self.path}/metrics/epoch={self._last(spark, 1 << 62)}", mode="overwrite")

    def run(self, articles: DataFrame, history_days: int = 30, step_days: int = 1, evaluate: bool = True) -> None:
        """History in one step, then every window of ``step_days`` once; an evaluation after history, after each 7 days (or
        each longer step) and at the end. Only the days' bounds are on the driver."""
        spark = articles.sparkSession
        low, high = articles.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).first()
        if low is None:
            return
        total, start, epoch, since = (high - low).days + 1, 0, 0, 0
        while start < total:
            size = history_days if epoch == 0 else step_days
            day = F.date_add(F.lit(low), start).cast("timestamp"), F.date_add(F.lit(low), start + size).cast("timestamp")
            self.step(articles.where((F.col("ts") >= day[0]) & (F.col("ts") < day[1])), epoch)
            since += 0 if epoch == 0 else step_days
            start += size
            if evaluate and (epoch == 0 or since >= max(7, step_days) or start >= total):
                self.evaluate(spark, str(low) + f"+{start}")
                since = 0
            epoch += 1

    def follow(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Starts a stream whose micro-batches are steps; ``trigger`` is that of the writer, available files by default."""
        return stream.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
