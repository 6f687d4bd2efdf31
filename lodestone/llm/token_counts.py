"""Token counts (operator 5): a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming over end positions carries the best score
and the number of pieces, and no back pointers. The rules are those of the unigram model of the library tokenizers with byte
fallback, under a pre-tokeniser that puts ▁ for each blank and before the text and cuts before each ▁: of equal scores the
path whose last piece starts first wins; a character without a piece of its own costs the least score less 10 and counts as
its bytes.

Where all scores are whole numbers, so that their sums are exact in any order, a word is cut further wherever two neighbouring
characters are neighbours in no piece: no piece can span such a place. Words of other vocabularies are searched whole, and
scores added from left to right, as the library adds them.

Defined results: null and empty texts have no pieces and the score 0; rows that repeat stay; rows without doc_id are kept;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

BLANK, PENALTY = "▁", 10.0
#: Words and parts that a Python worker remembers.
KEPT = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) by id, and the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], unknown: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.exact = all(score == int(score) for _, score in pieces)
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_piece, self.longest = pieces[unknown][0], max(len(p) for p, _ in pieces)
        self.unknown_score = min(s for _, s in pieces) - PENALTY
        self.pairs = {p[i : i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        self.parts: dict[str, tuple[int, float]] = {}
        self.words: dict[str, tuple[int, float]] = {}

    def search(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path through the text."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(text):
            ends[end + 1].append(match)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best, pieces, single = None, 0, False
            for length, own in ends[end]:  # longest first: earlier starts win ties
                s = score[end - length] + own
                if best is None or s > best:
                    best, pieces = s, count[end - length] + 1
                single = single or length == 1
            if not single:
                s = score[end - 1] + self.unknown_score
                if best is None or s > best:
                    best, pieces = s, count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            score[end], count[end] = best, pieces
        return count[n], score[n]

    def search_runs(self, text: str) -> tuple[int, float]:
        """As search(), for a text that spells the unknown piece: that joins neighbouring unknown characters, and a run of both counts as one piece if it is a piece, else as its bytes."""
        n = len(text)
        best: list[tuple[float, int, bool]] = [(0.0, 0, False)] * (n + 1)
        for end in range(1, n + 1):
            found = None
            for start in range(max(0, end - self.longest), end):
                score = self.automaton.get(text[start:end], (0, None))[1]
                unknown = text[start:end] == self.unknown_piece
                if score is None and start == end - 1:
                    score, unknown = self.unknown_score, True
                if score is not None and (found is None or best[start][0] + score > found[0]):
                    found = (best[start][0] + score, start, unknown)
            best[end] = found
        pieces, end, run = 0, n, ""
        while end:
            _, start, unknown = best[end]
            if unknown:
                run = text[start:end] + run
            if run and (not unknown or not start):
                pieces += 1 if run in self.automaton else len(run.encode("utf-8", "surrogatepass"))
                run = ""
            pieces += not unknown
            end = start
        return pieces, best[n][0]

    def word(self, word: str) -> tuple[int, float]:
        """A word with its ▁, cut where no piece can span."""
        if self.unknown_piece in word:
            return self.search_runs(word)
        if not self.exact:
            return self.search(word)
        cuts = [i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self.pairs]
        pieces, score = 0, 0.0
        for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True):
            part = word[a:b]
            found = self.parts.get(part)
            if found is None:
                found = self.search(part)
                if len(part) < 64:
                    if len(self.parts) >= KEPT:
                        self.parts = {}
                    self.parts[part] = found
            pieces, score = pieces + found[0], score + found[1]
        return pieces, score

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        spelt = text.replace(" ", BLANK)
        words = (spelt if spelt.startswith(BLANK) else BLANK + spelt).split(BLANK)[1:]
        pieces, score, known = 0, 0.0, self.words
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.word(BLANK + w)
                if len(w) < 32:
                    if len(known) >= KEPT:
                        known.clear()
                    known[w] = found
            pieces += found[0]
            score += found[1]
        return pieces, score


@lru_cache(2)
def counter_for(path: str) -> Counter:
    """One counter for all tasks of a Python worker."""
    return Counter(*vocabulary(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation)."""
    path = path or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(path)
        for batch in batches:
            found = [counter.text(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_tokens long, score double")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
