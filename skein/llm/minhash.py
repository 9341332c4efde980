"""Near-duplicate documents by MinHash signatures and an inverted join on signature coordinates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Scratch, connected_components, rows_by_bytes, tidy, with_texts

COORDINATES = 32
#: Retained above this many equal coordinates. At similarity 0.8 fewer than 16 of 32 agree for about 3 pairs in 100,000.
LEAST_EQUAL = 16
#: A pair with LEAST_EQUAL equal coordinates has one among the first 17: only these are posted, the rest is skipped.
PREFIX = COORDINATES - LEAST_EQUAL + 1
#: Rows of a posting list that are compared with each other at once, and of the longest list that isn't split by a second
#: coordinate before.
CHUNK, LONGEST = 1024, 4096
#: Cells of a set's histogram. What two sets share is at most what the smaller counts of their cells sum up to.
CELLS, MOST = 512, 255
#: Bits of the filter that says whose text is needed again: 8 MB, whatever the number of documents.
FILTER_BITS = 26
_R = np.random.default_rng(20_240_501)
_MUL = _R.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles of a text, repeats included. Words part at ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    one = xxhash.xxh64_intdigest
    h = np.fromiter((one(w) for w in words), dtype=np.uint64, count=len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = out * _STEP + h[i : len(h) - n + 1 + i]
    return _mix(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.empty(COORDINATES, np.uint32)
    for at in range(0, COORDINATES, 8):
        out[at : at + 8] = ((hashes[None, :] * _MUL[at : at + 8, None] + _ADD[at : at + 8, None]) >> np.uint64(32)).min(axis=1)
    return out


def histogram(hashes: np.ndarray) -> np.ndarray:
    """How many of the distinct hashes fall into each cell; MOST stands for that many or more."""
    return np.minimum(np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=CELLS), MOST).astype(np.uint8)


def may_link(size_a: np.ndarray, size_b: np.ndarray, cells_a: np.ndarray, cells_b: np.ndarray, percent: int) -> np.ndarray:
    """False only where sets of these sizes and histograms can't be similar enough."""
    smaller = np.minimum(size_a, size_b)
    shared = np.minimum(cells_a, cells_b).sum(1, dtype=np.int64)
    shared = np.where(((cells_a == MOST) & (cells_b == MOST)).any(1), smaller, np.minimum(shared, smaller))
    return 100 * shared >= percent * (size_a + size_b - shared)


def _sketch(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        for batch in rows_by_bytes(batches):
            ids, n, fps, sigs = batch.column(0), [], [], []
            for t in batch.column(1):
                found = np.unique(shingle_hashes(t.as_py(), k))
                n.append(len(found))
                fps.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return run


def _sets(k: int, needed: np.ndarray):
    """Sets of the documents whose bit the filter has; few others slip through."""
    schema = pa.schema([("fp", pa.binary()), ("items", pa.list_(pa.int64())), ("cells", pa.binary())])

    def run(batches):
        for batch in batches:
            bit = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((needed[bit >> 6] >> (bit & 63)) & 1 == 1))
            yield from of(batch) if batch.num_rows else ()

    def of(batch):
        for batch in rows_by_bytes([batch], 1 << 20):
            items = [x for t in batch.column(0) if len(x := np.unique(shingle_hashes(t.as_py(), k)))]
            fps = [xxhash.xxh128_digest(x.tobytes()) for x in items]
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array([x.view(np.int64) for x in items], pa.list_(pa.int64())), pa.array([histogram(x).tobytes() for x in items], pa.binary())], schema=schema)

    return run


def _equal(batches):
    """Drops pairs whose whole signatures agree in fewer coordinates than asked."""
    for pdf in batches:
        if len(pdf):
            a, b = (np.frombuffer(b"".join(pdf[c]), "<u4").reshape(len(pdf), COORDINATES) for c in ("sig_a", "sig_b"))
            yield pdf.loc[(a == b).sum(1) >= LEAST_EQUAL, ["a", "b", "fp_a", "fp_b"]]


def _pairs_in_lists(every: bool, percent: int):
    """Candidate pairs of different components within posting lists, each pair in one list only.

    Rows come sorted by (g, part): the rows of a list, or of two chunks of a long one. A pair belongs to the list of its first
    equal coordinate ``c1`` and, where lists were split once more, of the next equal one ``c2``. Pairs whose sizes differ too
    much are out. ``every``: all pairs that the histograms let pass; else the best partner of each row.
    """

    def in_group(ids, comp, sig, size, cells, side, c1, c2):
        a = np.arange(len(ids)) if side is None else np.flatnonzero(side == 0)
        b = a if side is None else np.flatnonzero(side == 1)
        got_a, got_b, got_n = [], [], []
        for at in range(0, len(a), 128):
            rows = a[at : at + 128]
            cols = b[b > rows[0]] if side is None else b
            same = np.zeros((len(rows), len(cols)), np.int8)
            for c in range(COORDINATES):
                same += sig[rows, c][:, None] == sig[cols, c][None, :]
            i, j = np.nonzero(same >= LEAST_EQUAL)
            n, i, j = same[i, j], rows[i], cols[j]
            ok = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            if side is None:
                ok &= i < j
            i, j, n = i[ok], j[ok], n[ok]
            ok = c1[i] == c1[j]
            equal = sig[i] == sig[j]
            ok &= equal.argmax(1) == c1[i]
            deep = c2[i] >= 0
            if deep.any():
                equal[np.arange(len(i)), np.minimum(c1[i], COORDINATES - 1)] = False
                ok &= ~deep | (c2[i] == c2[j]) & (equal.argmax(1) == c2[i])
            i, j, n = i[ok], j[ok], n[ok]
            if every and len(i):
                part = [(i[s : s + 8192], j[s : s + 8192]) for s in range(0, len(i), 8192)]
                ok = np.concatenate([may_link(size[x], size[y], cells[x], cells[y], percent) for x, y in part])
                i, j, n = i[ok], j[ok], n[ok]
            got_a.append(i)
            got_b.append(j)
            got_n.append(n)
        x, y, n = (np.concatenate(g) if g else np.empty(0, np.int64) for g in (got_a, got_b, got_n))
        if not every and len(x):  # the best of each row, as either end
            keep = np.zeros(len(x), bool)
            for of in (x, y):
                order = np.lexsort((-n.astype(np.int64), of))
                keep[order[np.r_[True, of[order][1:] != of[order][:-1]]]] = True
            x, y = x[keep], y[keep]
        return ids[x], ids[y]

    def out(pdf, cuts):
        ids, comp, size, side, c1, c2 = (pdf[c].to_numpy() for c in ("id", "comp", "size", "side", "c1", "c2"))
        sig = np.frombuffer(b"".join(pdf["sig"]), "<u4").reshape(len(pdf), COORDINATES)
        cells = np.frombuffer(b"".join(pdf["cells"]), np.uint8).reshape(len(pdf), CELLS) if every else None
        a, b = [], []
        for g in np.flatnonzero(np.diff(cuts) > 1):
            s = slice(cuts[g], cuts[g + 1])
            if (sides := side[s]).min() < 0 or (sides == 0).any() and (sides == 1).any():
                x, y = in_group(ids[s], comp[s], sig[s], size[s], cells[s] if every else None, None if sides.min() < 0 else sides, c1[s], c2[s])
                a.append(x)
                b.append(y)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            g, part = pdf["g"].to_numpy(), pdf["part"].to_numpy()
            cut = np.flatnonzero((g[1:] != g[:-1]) | (part[1:] != part[:-1])) + 1
            if len(cut):
                yield out(pdf.iloc[: cut[-1]], np.r_[0, cut])
                pdf = pdf.iloc[cut[-1] :].reset_index(drop=True)
            held = pdf
        if held is not None and len(held):
            yield out(held, np.array([0, len(held)]))

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of k-word shingles have a Jaccard similarity of at least percent / 100.

    Returns one row per input row: ``doc_id long, n_shingles long, component_id long, kept boolean``. A text of fewer than k
    words has its whole word sequence as one shingle; null and empty texts have none and link with nothing. Equal sets link.
    Repeated rows link with their copies; a doc_id that repeats with other texts has the links of all of them, and all its
    rows share its component. A null doc_id links with nothing, has a null component and is kept. Other columns are not read.

    Equal sets collapse to one first, under a number of its own. Signatures are posted under each (coordinate, value) of the
    prefix; every list is joined with its smallest member (a star, never all pairs), and pairs with enough equal coordinates
    are confirmed on the full sets. Lists that then still span several components are compared in chunks, very long ones
    after a split by a second coordinate, and never the largest component of a list with itself: first each row's best
    partner elsewhere, then, between what is still apart, all pairs that sizes and histograms don't rule out. So a link is
    lost only where signatures disagree.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    sketch = scratch.keep(with_texts(docs, "doc_id").mapInArrow(tidy(_sketch(k)), "doc_id long, n_shingles long, fp binary, sig binary"), "sketch")
    usable = F.col("doc_id").isNotNull() & F.col("fp").isNotNull()
    known = sketch.where(usable)
    reps = known.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.min("sig").alias("sig"), F.max("n_shingles").alias("size"), F.count("*").alias("copies"))
    reps = scratch.keep(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    coords = F.expr(f"transform(sequence(0, {PREFIX - 1}), i -> shiftleft(cast(i as long), 32) | cast(conv(hex(substring(sig, i * 4 + 1, 4)), 16, 10) as long))")
    posts = reps.select("id", F.explode(coords).alias("key"))
    lists = scratch.keep(posts.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("center")).where("n > 1"), "lists")
    posts = scratch.keep(posts.join(lists, "key").select("key", "id", "n", "center"), "posts")

    stars = posts.where("id != center").groupBy(F.col("center").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("met"))
    end = lambda x: scratch.again(reps, "reps").select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("fp").alias(f"fp_{x}"))
    stars = stars.join(end("a"), "a").join(end("b"), "b").select("a", "b", "sig_a", "sig_b", "fp_a", "fp_b")
    stars = scratch.keep(stars.mapInPandas(tidy(_equal), _PAIR), "star-pairs")
    links = _confirmed(scratch, stars, _shingle_sets(scratch, docs, reps, stars, k, "star-sets"), percent, "stars")
    scratch.drop("star-sets", "star-pairs")
    several = known.select("doc_id", F.xxhash64("fp").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("doc_id")
    if not several.isEmpty():  # texts of one doc_id are tied
        tied = known.join(several, "doc_id", "left_semi").select("doc_id", "fp").distinct().join(reps.select("fp", "id"), "fp")
        tied = scratch.keep(tied.select("doc_id", "id"), "tied")
        links = links.unionByName(tied.join(tied.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a != b"))
    components = scratch.keep(connected_components(links, scratch, tag="cc0"), "components-0")
    best = scratch.keep(_with_fp(scratch, reps, _apart(scratch, posts, reps, components, None, percent, "best")), "best-pairs")
    if not best.isEmpty():
        sets = _shingle_sets(scratch, docs, reps, best, k, "sets")
        components = _merged(scratch, components, _confirmed(scratch, best, sets, percent, "more"), "1")
        rest = scratch.keep(_with_fp(scratch, reps, _apart(scratch, posts, reps, components, sets, percent, "rest")), "rest-pairs")
        components = _merged(scratch, components, _confirmed(scratch, rest, sets, percent, "rest"), "2")
        scratch.drop("sets", "posts")
    names = components.join(reps.select(F.col("id").alias("node"), "doc", "fp"), "node")
    least = names.groupBy("component").agg(F.min("doc").alias("c"))
    classes = names.join(least, "component").select("fp", "c")
    classes = scratch.keep(classes.unionByName(reps.where("copies > 1").join(components.select(F.col("node").alias("id")), "id", "left_anti").select("fp", F.col("doc").alias("c"))), "classes")
    out = known.select("doc_id", "n_shingles", "fp").join(classes, "fp", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    out = out.unionByName(_without_words(sketch.where(~usable), known, classes))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _merged(scratch: Scratch, components: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """Components after further links. Only the components that these join are walked, not all nodes once more."""
    end = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    between = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = scratch.keep(connected_components(between, scratch, tag=f"cc{tag}"), f"moved-{tag}")
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = components.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    single = moved.join(components.select("node"), "node", "left_anti")
    return scratch.keep(old.unionByName(single), f"components-{tag}")


_PAIR = "a long, b long, fp_a binary, fp_b binary"


def _without_words(rows: DataFrame, known: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows that link with nothing. One whose doc_id has a text as well, in another row, shares that row's component."""
    ids = rows.where("doc_id is not null").select("doc_id").distinct()
    others = known.join(ids, "doc_id", "left_semi").select("doc_id", "fp").join(classes, "fp").groupBy("doc_id").agg(F.min("c").alias("c"))
    return rows.join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def _with_fp(scratch: Scratch, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the fingerprints of both ends."""
    end = lambda x: scratch.again(reps, "reps").select(F.col("id").alias(x), F.col("fp").alias(f"fp_{x}"))
    return pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "fp_a", "fp_b")


def _apart(scratch: Scratch, posts: DataFrame, reps: DataFrame, components: DataFrame, sets: DataFrame | None, percent: int, tag: str) -> DataFrame:
    """Pairs of posting lists that span several components; with ``sets``, of those that have one and by their histograms."""
    reps = reps.select("id", "sig", "size", "fp")
    if sets is not None:
        reps = reps.join(sets.select("fp", "cells"), "fp")
        posts = posts.join(scratch.keep(reps.select("id"), f"{tag}-ids"), "id", "left_semi")
    row = posts.join(components.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    row = scratch.keep(row, f"{tag}-row")

    def span(df, by):
        """Lists of several components: their rows, and the component that has most of them."""
        each = df.groupBy(by, "comp").agg(F.count("*").alias("k"))
        of = each.groupBy(by).agg(F.sum("k").alias("n"), F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("top"))
        return scratch.keep(of.where("comps > 1").select(by, "n", F.col("top.comp").alias("major"), F.col("top.k").alias("n_major")), f"{tag}-{by}")

    row = row.join(span(row, "key"), "key").join(reps.drop("fp"), "id").withColumn("c1", F.shiftright("key", 32).cast("int"))
    row = scratch.keep(row, f"{tag}-open")
    short = row.where(F.col("n") <= LONGEST).withColumn("c2", F.lit(-1)).withColumn("g", F.col("key"))
    # Of a pair's LEAST_EQUAL equal coordinates the second lies within the prefix and one more, after the first.
    value = F.substring("sig", F.col("c2") * 4 + 1, F.lit(4))
    split = row.where(F.col("n") > LONGEST).drop("n", "major", "n_major").withColumn("c2", F.explode(F.expr(f"sequence(c1 + 1, {PREFIX})"))).withColumn("g", F.xxhash64("key", "c2", value))
    split = split.join(span(split.select("g", "comp"), "g"), "g")
    row = short.unionByName(split)
    # The first m0 chunks hold the largest component, the others the rest; a list that fits one chunk is one.
    whole, chunks = F.col("n") <= CHUNK, lambda of: F.ceil(of / CHUNK).cast("int")
    row = row.withColumn("m0", F.when(whole, F.lit(0)).otherwise(chunks(F.col("n_major")))).withColumn("m1", F.when(whole, F.lit(1)).otherwise(chunks(F.col("n") - F.col("n_major"))))
    dealt, in_major = F.xxhash64("id", "g"), ~whole & (F.col("comp") == F.col("major"))
    row = row.withColumn("c", F.when(in_major, F.pmod(dealt, F.col("m0"))).otherwise(F.col("m0") + F.pmod(dealt, F.col("m1"))).cast("int")).withColumn("m", F.col("m0") + F.col("m1"))
    # part: one for each unordered pair of chunks; side: which chunk of the pair, -1 within one chunk.
    others = F.sequence(F.when(in_major, F.col("m0")).otherwise(F.lit(0)), F.col("m") - 1)
    to = F.transform(others, lambda o: F.struct((F.least(o, F.col("c")).cast("long") * F.col("m") + F.greatest(o, F.col("c"))).alias("part"), F.when(o == F.col("c"), -1).when(F.col("c") < o, 0).otherwise(1).alias("side")))
    cols = ["g", F.col("to.part").alias("part"), "id", "comp", F.col("to.side").alias("side"), "c1", "c2", "sig", "size", *(["cells"] if sets is not None else [])]
    row = row.withColumn("to", F.explode(to)).select(*cols).repartition("g", "part").sortWithinPartitions("g", "part", "id")
    return row.mapInPandas(tidy(_pairs_in_lists(sets is not None, percent)), "a long, b long")


def _shingle_sets(scratch: Scratch, docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, tag: str) -> DataFrame:
    """Full sets and histograms of the texts in pairs. Texts aren't shuffled: a bit filter of fixed size, made of the needed
    ids, goes to where they are read."""
    bit = lambda of: F.shiftrightunsigned(F.xxhash64(of), 64 - FILTER_BITS)
    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    need = ends.join(reps.select(F.col("id").alias("a"), "doc"), "a").select(bit(F.col("doc")).alias("bit"))
    words = need.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    needed = np.zeros(1 << FILTER_BITS - 6, np.int64)
    needed[words["w"].to_numpy()] = words["bits"].to_numpy()
    texts = with_texts(docs.where("doc_id is not null"), "doc_id").select("_t", bit(F.col("doc_id").cast("long")).alias("bit"))
    sets = scratch.keep(texts.mapInArrow(tidy(_sets(k, needed)), "fp binary, items array<long>, cells binary"), tag)
    rows, own = sets.agg(F.count("*"), F.count_distinct("fp")).first()
    return sets if rows == own else scratch.keep(sets.dropDuplicates(["fp"]), f"{tag}-once")


def _confirmed(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    end = lambda x, name: sets.select(F.col("fp").alias(f"fp_{x}"), F.col("items").alias(name))
    both = pairs.join(end("b", "t"), "fp_b").join(end("a", "s"), "fp_a")
    both = both.select("a", "b", F.size("s").alias("x"), F.size("t").alias("y"), F.size(F.array_intersect("s", "t")).alias("z"))
    return scratch.keep(both.where(f"100L * z >= {percent}L * (x + y - z)").select("a", "b"), tag)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.8, over the whole ``documents`` table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
