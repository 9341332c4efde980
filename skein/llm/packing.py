"""Packing of tokenised documents into sequences: best-fit decreasing, certified by dual-feasible-function bounds."""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Scratch, rows_by_bytes, tidy, with_texts

CAPACITY, END_ID = 4096, 1
#: Pieces that one task packs.
ITEMS = 100_000
#: Words that a task keeps, and the characters of the longest that it keeps; bytes of texts that are encoded at once.
_CACHE_WORDS, _CACHE_CHARS, _SLICE = 300_000, 64, 1 << 20
#: Latin letters and signs that lower-case to one character which is among them too.
_LATIN = "".join(c for c in map(chr, range(0xA1, 0x250)) if len(c.lower()) == 1 and 0xA1 <= ord(c.lower()) < 0x250)
#: Texts of these characters alone are split here; any other text goes to the tokenizer whole. None of them changes under
#: NFC, each lower-cases to one of them, and white space among them is ASCII.
_OTHER = re.compile(f"[^\t\n\x0b\x0c\r -~{re.escape(_LATIN)}‐-‧€]|<\\|")
#: The vocabulary's own word pattern, for lower-cased texts of those characters.
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\\sa-z0-9ª²³µ¹º¼-¾À-ÖØ-öø-ɏ]+")


class WordEncoder:
    """Ids of whole texts, by a tokenizer whose words end in an end-of-word piece; words are encoded once and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def forget(self) -> None:
        """No words: workers outlive their task, and later stages need the memory."""
        self.kept, self.older = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.kept) > _CACHE_WORDS:  # words that come back move on from the older generation
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        split = [None if _OTHER.search(t) else _WORD.findall(t.lower()) for t in texts]
        new = []
        for w in set().union(*filter(None, split)).difference(kept):
            if (ids := older.get(w)) is None:
                new.append(w)
            else:
                kept[w] = ids
        unsure = set()
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or len(ids) != cuts[-1]:  # words of another vocabulary don't end so: their texts go whole
                unsure.update(part)
                continue
            raw = ids.tobytes()
            for w, a, b in zip(part, np.r_[0, cuts[:-1]].tolist(), cuts.tolist(), strict=True):
                kept[w] = raw[4 * a : 4 * b]
        get = kept.__getitem__
        out = [self.whole(t) if words is None or not unsure.isdisjoint(words) else b"".join(map(get, words)) for t, words in zip(texts, split, strict=True)]
        for w in new:
            if len(w) > _CACHE_CHARS:
                kept.pop(w, None)
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, which reads its vocabulary once."""
    return WordEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECE = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str | None):
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        words, uid, size = encoder(path or default_vocabulary()), TaskContext.get().partitionId() << 36, 4 * CAPACITY
        try:
            for batch in rows_by_bytes(batches, _SLICE):
                rows = []
                for doc, ids in zip(batch.column(0).to_pylist(), words.encode([t.as_py().decode() for t in batch.column(1)]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), size)):
                        rows.append((doc, uid, k, at // 4, len(ids[at : at + size]) // 4, zlib.crc32(ids[at : at + size])))
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        finally:
            words.forget()

    return run


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that any packing of these sizes needs, by the best dual-feasible function of a threshold.

    For a threshold a, sizes over capacity - a fill a bin each, sizes over half need one each, and what the sizes from a to
    half the capacity sum to beyond the room left in those needs more. A threshold of 0 includes the bound by volume.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    n, total = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * np.arange(capacity + 1))]  # below a size
    half = capacity // 2
    a = np.arange(half + 1)
    whole, large = n[-1] - n[capacity - a + 1], n[capacity - a + 1] - n[half + 1]
    volume, small = total[capacity - a + 1] - total[half + 1], total[half + 1] - total[a]
    return int((whole + large + np.maximum(0, -((large * capacity - volume - small) // capacity))).max())


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the bins' fill. Ties of size keep their order."""
    where, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    mask = 0  # a bit for each room that some bin has
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += s
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return where, offset, np.array(fill, dtype=np.int64)


_PACKED = _PIECE + ", sequence_id long, offset long, exchange boolean"


def _pack_group(turn: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["g"].iloc[0])
        pdf = pdf.sort_values(["uid"], ignore_index=True)
        sizes = pdf["length"].to_numpy()
        where, offset, fill = best_fit_decreasing(sizes)
        open_bins = fill < CAPACITY
        if len(fill) == lower_bound(sizes):  # certified: only its least filled bin may still help others
            open_bins &= np.arange(len(fill)) == fill.argmin()
        seq = (turn << 52) | (group << 26)
        return pdf.drop(columns="g").assign(sequence_id=seq + where, offset=offset, exchange=open_bins[where])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Packs every document into sequences of at most CAPACITY tokens, as few as it can.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A document is its ids and
    END_ID; only longer ones than CAPACITY are cut. Null and empty texts are END_ID alone; a null doc_id stays null; repeated
    rows are packed each. Without documents the result is empty. Other columns are not read. ``vocabulary``: a path that
    every executor has; by default that of the installed public tokenizers.

    Pieces are dealt at random to groups of about ITEMS, and each is packed by best-fit decreasing. A group whose number of
    bins equals its lower bound is certified. The others exchange what lies in bins that aren't full, also with each
    certified group's least filled bin, and are packed again until a round saves no bin or none can be saved by volume.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    todo = scratch.keep(with_texts(docs, "doc_id").mapInArrow(tidy(_cut(vocabulary)), _PIECE), "pieces")
    done, old = [], None
    for turn in itertools.count():
        n = todo.count()
        groups = max(1, -(-n // ITEMS))
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
        new = scratch.keep(dealt.groupBy("g").applyInPandas(_pack_group(turn), _PACKED), f"packed-{turn}")
        bins = new.agg(F.count_distinct("sequence_id")).first()[0]
        if old is not None and bins >= old[1]:
            done.append(old[0])
            break
        done.append(new.where("not exchange"))
        left = new.where("exchange")
        old = left, *left.agg(F.count_distinct("sequence_id"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if old[1] <= max(1, -(-old[2] // CAPACITY)):  # none can be saved
            done.append(left)
            break
        todo = left.drop("sequence_id", "offset", "exchange")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("uid", "exchange")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table in sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
