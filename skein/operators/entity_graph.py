"""Entity weights of document pairs: shared entities, else the path between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from skein.functions.kernels import final_weight, path_factor, shared_factor
from skein.plans.articles import Settings, with_positions
from skein.session import cut_lineage

#: Pairs that a task measures at a time.
BATCH = 1 << 18


def bipartite(entities: DataFrame) -> DataFrame:
    """Distinct ``doc_id, entity`` edges; an entity's question doesn't matter."""
    return entities.select("doc_id", "entity").distinct()


class _Graph:
    """The entities of each document as numbers, ascending, and for paths the entities beside each entity.

    A task holds all of it: about 16 bytes for each row of the graph, and 8 for each pair of entities that a document has.
    """

    def __init__(self, graph: DataFrame, neighbours: bool):
        graph = cut_lineage(graph.select("doc_id", "entity").where("doc_id is not null and entity is not null").distinct())
        numbers = with_positions(graph.select("entity").distinct(), "entity").select("entity", F.col("doc_pos").cast("int").alias("e"))
        rows = cut_lineage(graph.join(numbers, "entity").select("doc_id", "e"))
        found = rows.toPandas()
        doc, e = found["doc_id"].to_numpy(dtype=np.int64), found["e"].to_numpy(dtype=np.int64)
        order = np.lexsort((e, doc))
        self.docs, counts = np.unique(doc[order], return_counts=True)
        self.at, self.own = np.append(0, np.cumsum(counts)), e[order].astype(np.int32)
        self.n = int(e.max()) + 1 if len(e) else 0
        if neighbours:
            # an entity is also beside itself
            near = rows.join(rows.withColumnRenamed("e", "to"), "doc_id").select("e", "to").distinct().toPandas()
            order = np.lexsort((near["to"], near["e"]))
            self.to = near["to"].to_numpy(dtype=np.int32)[order]
            self.start = np.searchsorted(near["e"].to_numpy()[order], np.arange(self.n))

    def _entities(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row number in ``docs`` and the entity, for each of theirs."""
        k = np.searchsorted(self.docs, docs)
        known = k < len(self.docs)
        known[known] = self.docs[k[known]] == docs[known]
        k = np.where(known, k, 0)
        size = np.where(known, self.at[k + 1] - self.at[k], 0) if len(self.docs) else np.zeros(len(docs), dtype=np.int64)
        rows = np.repeat(np.arange(len(docs)), size)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        return rows, self.own[self.at[k[rows]] + within].astype(np.int64) if len(rows) else np.zeros(0, dtype=np.int64)

    def shared(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        (i, a), (j, b) = self._entities(src), self._entities(dst)
        mine, theirs = i * max(self.n, 1) + a, j * max(self.n, 1) + b
        return np.bincount(i[np.isin(mine, theirs, assume_unique=True)], minlength=len(src))

    def hops(self, src: np.ndarray, dst: np.ndarray, most: int) -> np.ndarray:
        """From document to document, 0 beyond ``most``: entities spread from 64 sources at once, a bit for each."""
        out, (origins, of) = np.zeros(len(src), dtype=np.int32), np.unique(src, return_inverse=True)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(0, len(origins) + 64, 64))
        for k in range(0, len(origins), 64):
            pairs = order[ends[k // 64] : ends[k // 64 + 1]]
            bit, e = self._entities(origins[k : k + 64])
            reached = np.zeros(self.n, dtype=np.uint64)
            np.bitwise_or.at(reached, e, np.uint64(1) << bit.astype(np.uint64))
            for h in range(1, most + 1):
                i, e = self._entities(dst[pairs])
                met = (reached[e] >> (of[pairs[i]] - k).astype(np.uint64)) & np.uint64(1)
                hit = np.bincount(i[met > 0], minlength=len(pairs)) > 0
                out[pairs[hit]] = h
                pairs = pairs[~hit]
                if h == most or not len(pairs):
                    break
                reached = np.bitwise_or.reduceat(reached[self.to], self.start)
        return out


def _measured(pairs: DataFrame, graph: DataFrame, shared: bool, most: int | None) -> DataFrame:
    """The pairs with ``shared``, and with ``edges`` of those that share none, within ``most - 1`` documents' steps."""
    sent = pairs.sparkSession.sparkContext.broadcast(_Graph(graph, most is not None))
    schema = StructType(list(pairs.schema.fields))
    schema = schema.add("shared", LongType()) if shared else schema
    schema = schema.add("edges", IntegerType()) if most is not None else schema

    def measure(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        src, dst = rows.column("src").to_numpy(), rows.column("dst").to_numpy()
        n = sent.value.shared(src, dst) if shared else np.zeros(len(src), dtype=np.int64)
        if shared:
            rows = rows.append_column("shared", pa.array(n.astype(np.int64)))
        if most is not None:
            edges, none = np.zeros(len(src), dtype=np.int32), n == 0
            edges[none] = 2 * sent.value.hops(src[none], dst[none], most - 1)
            rows = rows.append_column("edges", pa.array(edges, mask=edges == 0))
        yield from rows.combine_chunks().to_batches(BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= BATCH:
                yield from measure(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from measure(pa.Table.from_batches(held))

    return pairs.mapInArrow(run, schema)


def shared_counts(pairs: DataFrame, graph: DataFrame) -> DataFrame:
    """``src, dst, shared`` of the given pairs only, counted where the pairs are."""
    return _measured(pairs.select("src", "dst"), graph, True, None)


def path_lengths(pairs: DataFrame, graph: DataFrame, most: int) -> DataFrame:
    """``src, dst, edges``: shortest path of each pair in the entity graph, null beyond ``most - 1`` document hops.

    A path of ``most`` hops weighs as much as none, so it isn't sought.
    """
    return _measured(pairs.select("src", "dst"), graph, False, most)


def entity_weighted(pairs: DataFrame, entities: DataFrame, p: Settings) -> DataFrame:
    """The pairs with ``weight``: by shared entities, or for pairs without any by the path. Thresholds apply before."""
    rows = _measured(pairs, bipartite(entities), True, p.meb)
    factor = F.when(F.col("shared") > 0, shared_factor(F.col("shared"), p.gamma, p.mce)).otherwise(path_factor(F.col("edges"), p.gamma, p.meb))
    return rows.withColumn("weight", final_weight(F.col("distance"), factor))
