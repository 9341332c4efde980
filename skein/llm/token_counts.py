"""Token counts under a unigram vocabulary: Aho-Corasick matches and a Viterbi pass that carries score and piece count."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import rows_by_bytes, tidy, with_texts

SPACE = "▁"
#: Below the lowest score by this much lies the score of a character that no piece covers.
UNKNOWN_PENALTY = 10.0
_CACHE_WORDS = 400_000
_NONE = float("-inf")


def unigram_vocabulary(path: str | None = None) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) of every id of a sentencepiece file, and the id of its unknown piece. Scores are the file's own."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())], sp.unk_id()


class UnigramCounter:
    """Number of pieces of the best segmentation, as a unigram tokenizer with byte fallback makes it.

    A word is a space mark and what follows up to the next one. Between equal scores the piece that starts first wins, as only
    a strictly better score replaces a path. Where no one-character piece starts, an unknown character may; unknown
    characters in a row are one token, or as many as they have bytes if the vocabulary has the bytes' pieces.
    """

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        pieces = {p for p, _ in vocabulary}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in pieces} if byte_fallback else set()
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one word.

        The automaton reports matches by their end, of one end the longest first, so a match finds its start's best path
        complete and of equal scores the earliest start stays.
        """
        n = len(word)
        best, count, singles = [0.0] + [_NONE] * n, [0] * (n + 1), 0
        for end, (length, score) in self.automaton.iter(word):
            end += 1
            score += best[end - length]
            if score > best[end]:
                best[end], count[end] = score, count[end - length] + 1
            if length == 1:
                singles += 1
        return (count[n], best[n]) if singles == n else self.word_with_unknown(word)

    def word_with_unknown(self, word: str) -> tuple[int, float]:
        """The same for a word with characters that no one-character piece covers."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n + 1)]
        single = bytearray(n)
        for end, (length, score) in self.automaton.iter(word):
            ends[end + 1].append((end + 1 - length, score))
            if length == 1:
                single[end] = 1
        # best[i]: score of the best path to i; count[i]: its pieces, without the run of unknown characters since run[i].
        best, count, run = [0.0] + [None] * n, [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            found = ends[i]
            if not single[i - 1]:
                found.append((i - 1, None))
            top = at = None
            for start, score in sorted(found, key=lambda x: x[0]):
                if best[start] is not None and (top is None or best[start] + (self.unknown if score is None else score) > top):
                    top, at, known = best[start] + (self.unknown if score is None else score), start, score is not None
            if top is None:
                continue
            best[i] = top
            if known:
                count[i], run[i] = count[at] + self._run(word, run[at], at) + 1, i
            else:
                count[i], run[i] = count[at], run[at]
        return count[n] + self._run(word, run[n], n), best[n] or 0.0

    def _run(self, word: str, start: int, end: int) -> int:
        """Tokens of the unknown characters from start to end."""
        if start == end:
            return 0
        raw = word[start:end].encode()
        return len(raw) if self.bytes.issuperset(raw) else 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if text[0] == " ":
            del words[0]
        if len(self.kept) > _CACHE_WORDS:  # words that come back move on from the older generation
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        for w in set(words).difference(kept):
            got = older.get(w)
            kept[w] = self.word(SPACE + w)[0] if got is None else got
        return sum(map(kept.__getitem__, words))


@functools.cache
def counter(path: str | None) -> UnigramCounter:
    """One counter for each Python worker, so that a task finds the words of those before it."""
    return UnigramCounter(unigram_vocabulary(path)[0])


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id long, n_tokens long`` of every whole text.

    Null and empty texts have none; repeated rows are counted each; a null doc_id stays null; other columns are not read.
    ``vocabulary``: path of a sentencepiece file that every executor has; by default that of the public tokenizers. The text
    is taken as it is: a space mark goes before it unless it begins with a space, and marks stand for spaces.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        for batch in rows_by_bytes(batches):
            counts = [counter(vocabulary).count(t.as_py().decode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64())], schema=schema)

    return with_texts(docs, "doc_id").mapInArrow(tidy(run), "doc_id long, n_tokens long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of the whole ``documents`` table."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
