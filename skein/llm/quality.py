"""Quality classifier: supervised subword embeddings, averaged per document, softmax output, fitted by numpy SGD."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import rows_by_bytes, tidy, with_texts

#: Bound of the labelled rows that are fitted on, drawn by hash of the id, and of one row's features in the sample.
SAMPLE = 4096
BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 8, 6, 0.5
CHARS = (3, 4)
#: Words that a scorer keeps and the bytes of the longest that it keeps; characters whose n-grams are hashed at once; bytes
#: of texts that are split into words at once. Each worker holds so much beside what the JVM has of an executor's memory.
_CACHE_WORDS, _CACHE_BYTES, _WINDOW, _SLICE = 100_000, 64, 1 << 16, 1 << 19
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit hashes."""
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(48)).astype(np.int64) % BUCKETS


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams of code points, one for each of their starts."""
    h = np.full(max(0, len(points) - n + 1), n, np.uint64)
    for k in range(n):
        h = h * _STEP + points[k : k + len(h)]
    return _buckets(h)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def word_parts(words: list[bytes]):
    """(first word, buckets, word of each) for parts of the words' features: each word itself and all its character n-grams,
    with marked ends. Text without spaces is one long word, whose n-grams come in several parts."""
    texts = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = 0
    while at < len(texts):
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at : at + _WINDOW]), _WINDOW, side="right")))
        yield at, _buckets(np.fromiter(map(xxhash.xxh64_intdigest, words[at:end]), np.uint64, end - at)), np.arange(end - at)
        if end == at + 1:
            for n in CHARS:  # by where n-grams begin, so that few are held at once
                for start in range(0, max(0, int(size[at]) - n + 1), _WINDOW):
                    found = _grams(_points(texts[at][start : start + _WINDOW + n - 1]), n)
                    yield at, found, np.zeros(len(found), np.int64)
        else:
            points, of = _points("".join(texts[at:end])), np.repeat(np.arange(end - at), size[at:end])
            for n in CHARS:
                inside = of[: len(points) - n + 1] == of[n - 1 :]
                yield at, _grams(points, n)[inside], of[: len(points) - n + 1][inside]
        at = end


def pair_features(h: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the words' 64-bit hashes. A word that repeats backs off to one shared bucket."""
    x = h[:-1] * _STEP + h[1:]
    out = ((x ^ (x >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int64)
    out[h[:-1] == h[1:]] = 0
    return out


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    times, out = Counter(words), np.zeros(BUCKETS)
    count = np.fromiter(times.values(), np.float64, len(times))
    for at, ids, of in word_parts(list(times)):
        out += np.bincount(ids, count[at + of], BUCKETS)
    out += np.bincount(pair_features(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))), minlength=BUCKETS)
    ids = np.flatnonzero(out)
    return ids, out[ids].astype(np.float32)


@dataclass
class SubwordClassifier:
    """Bucket vectors, averaged over a document's features, and a two-class softmax."""

    vectors: np.ndarray = field(default_factory=lambda: np.random.default_rng(3).uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 2)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> SubwordClassifier:
        """Stochastic gradient descent, one document a step, classes weighted alike."""
        share = np.bincount(labels, minlength=2) / max(1, len(labels))
        if not len(labels):
            return self
        if share.min() == 0:
            self.bias[labels[0]] = 4.0
            return self
        cost, rng, total, step = 0.5 / share, np.random.default_rng(4), EPOCHS * len(labels), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(labels)):
                rate, step = RATE * (1 - step / total), step + 1
                ids, counts = rows[i][0].astype(np.int64), rows[i][1].astype(np.float64)
                if not len(ids):
                    continue
                part = (counts / counts.sum())[:, None]
                mean = (self.vectors[ids] * part).sum(0)
                z = mean @ self.weights + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                p *= cost[labels[i]]
                back = self.weights @ p
                self.weights -= rate * np.outer(mean, p)
                self.bias -= rate * 0.1 * p
                # Averaging divides the step of each of many features; scaled back by their number's root.
                self.vectors[ids] -= rate * np.sqrt(len(ids)) * part * back[None, :]
        return self

    def contributions(self) -> tuple[np.ndarray, float]:
        """The softmax of two classes needs only the difference of logits, and that is a mean over features."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])


class Scorer:
    """Scores of whole texts. What a word adds is kept for the next time; the new words of a batch are hashed together."""

    def __init__(self, each: np.ndarray, bias: float):
        self.each, self.bias = each, bias
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.total, self.count, self.hash, self.used = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.uint64), 0

    def _learn(self, words: list[bytes]) -> None:
        first, end = self.used, self.used + len(words)
        if end > len(self.total):
            self.total, self.count, self.hash = (np.concatenate([x[:first], np.zeros(2 * end - first, x.dtype)]) for x in (self.total, self.count, self.hash))
        self.hash[first:end] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.total[first:end], self.count[first:end] = 0, 0
        for at, ids, of in word_parts(words):
            sums, n = np.bincount(of, self.each[ids]), np.bincount(of)
            self.total[first + at : first + at + len(sums)] += sums
            self.count[first + at : first + at + len(n)] += n
        self.place.update(zip(words, range(first, end), strict=True))
        self.used = end

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.used > _CACHE_WORDS:
            self._clear()
        split = [t.split() for t in texts]
        new = list(set().union(*split).difference(self.place))
        self._learn(new)
        get, logits = self.place.__getitem__, np.empty(len(texts))
        for i, words in enumerate(split):
            at = np.fromiter(map(get, words), np.int64, len(words))
            total, n = float(self.total[at].sum()), int(self.count[at].sum())
            if len(words) > 1:
                total += float(self.each[pair_features(self.hash[at])].sum())
                n += len(words) - 1
            logits[i] = total / max(1, n) + self.bias
        for w in new:
            if len(w) > _CACHE_BYTES:
                del self.place[w]
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))

    def score(self, text: bytes) -> float:
        return float(self.scores([text])[0])


def fit_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE) -> SubwordClassifier:
    """A classifier fitted on at most ``sample`` labelled documents for whose doc_id ``may_learn`` holds.

    Rows with a null or other label than 0 and 1, or without a document, are passed over; a document with both labels counts
    as 1; of repeated rows of a doc_id the one whose text has the least hash is taken. Only features travel to the driver, of
    at most ``sample`` rows.
    """
    drawn = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & may_learn).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = with_texts(docs, "doc_id").join(F.broadcast(drawn), "doc_id")  # at most ``sample`` rows
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("h", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for batch in rows_by_bytes(batches, _SLICE):
            texts = batch.column(1).to_pylist()
            got = [document_features(t) for t in texts]
            columns = [[xxhash.xxh128_digest(t) for t in texts], [i.astype("<u2").tobytes() for i, _ in got], [c.astype("<f4").tobytes() for _, c in got]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], schema=schema)

    rows = texts.select("doc_id", "_t", "quality").mapInArrow(tidy(run), "doc_id long, quality int, h binary, ids binary, counts binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "ids", "counts")).alias("r")).select("doc_id", "r.quality", "r.ids", "r.counts").toArrow()
    rows = rows.take(pc.sort_indices(rows["doc_id"]))
    # Read where they lie: as wide numbers they take three times the memory.
    feats = [(np.frombuffer(i.as_buffer(), "<u2"), np.frombuffer(c.as_buffer(), "<f4")) for i, c in zip(rows["ids"], rows["counts"], strict=True)]
    return SubwordClassifier().fit(feats, rows["quality"].to_numpy().astype(np.int64))


def score_quality(docs: DataFrame, model: SubwordClassifier, threshold: float = 0.7) -> DataFrame:
    """``doc_id long, score double, predicted int`` of every document, from its whole text alone.

    Null and empty texts get the score of the bias; repeated rows are scored each; a null doc_id stays null. Other columns
    are not read.
    """
    each, bias = model.contributions()
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        scorer = Scorer(each, bias)  # of this task: what it keeps goes with it
        for batch in rows_by_bytes(batches, _SLICE):
            scores = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64())], schema=schema)

    scored = with_texts(docs, "doc_id").mapInArrow(tidy(run), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: SubwordClassifier, threshold: float = 0.7) -> DataFrame:
    """The rows, all columns, whose text scores at least ``threshold``; one pass, no join. A null text counts as empty."""
    each, bias = model.contributions()

    def run(batches):
        scorer = Scorer(each, bias)  # of this task: what it keeps goes with it
        for batch in rows_by_bytes(batches, _SLICE, text="text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array(scorer.scores([(t or "").encode() for t in texts]) >= threshold, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def learnable() -> Column:
    """Rows that labels may be learned from; the others are held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole ``documents`` table by a classifier fitted on ``labels.quality``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnable())
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", "predicted")
