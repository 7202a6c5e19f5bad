"""Token counts under a unigram model: forward scores once per shared prefix of a trie of distinct pre-tokens.

A pre-token is a blank-separated word with the vocabulary's word mark in front. Its count is the number of pieces on its
best segmentation: the highest sum of piece scores, of equals the one with fewer pieces. The forward score of a letter
position depends on the letters before it only, so words with a common prefix share it: a batch's distinct pre-tokens are put
in a trie (sorted, walked depth first; the open branch is the column of scores in hand) and each trie node is scored
once. Words' counts are stored at their terminal nodes, and documents add them up.

A letter that is no piece by itself counts as its UTF-8 bytes, one piece each. Scores come from the order of the vocabulary
by Zipf's law: -ln(rank + 1) for the piece of that rank, BYTE_SCORE for a byte.

Edge cases: null, empty and blank texts have 0 tokens; repeated rows each get their row; very long words cost one step
per letter and piece length; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm.common import documents, ship, texts, tidied

MARK = "▁"
BYTE_SCORE = -20.0
#: Entries of a worker's table of counted words; it is emptied when full.
CACHE = 300_000


class PieceTrie:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.counts: dict[str, int] = {}

    def add(self, words: set[str]) -> None:
        """Score the trie of ``words`` (with mark) and store the count of each at its terminal node."""
        scores, longest = self.scores, self.longest
        best, pieces = [0.0], [0]  # of the open branch's nodes, by depth
        before = ""
        for word in sorted(words):
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del best[depth + 1 :], pieces[depth + 1 :]
            for i in range(depth + 1, len(word) + 1):
                letter = word[i - 1]
                size = 0 if letter in scores else len(letter.encode())
                top, n = (best[i - 1] + size * BYTE_SCORE, pieces[i - 1] + size) if size else (-math.inf, 0)
                for j in range(max(0, i - longest), i):
                    s = scores.get(word[j:i])
                    if s is not None:
                        s += best[j]
                        if s > top or (s == top and pieces[j] + 1 < n):
                            top, n = s, pieces[j] + 1
                best.append(top)
                pieces.append(n)
            self.counts[word[1:]] = pieces[len(word)]
            before = word

    def count(self, text: str) -> int:
        words = text.split()
        got = list(map(self.counts.get, words))
        if None in got:
            if len(self.counts) > CACHE:
                self.counts.clear()
            self.add({MARK + w for w in words if w not in self.counts})
            got = map(self.counts.__getitem__, words)
        return sum(got)

    def prepare(self, batch: list[str]) -> None:
        """Put the batch's new pre-tokens in one trie, so that prefixes are shared across its documents."""
        new = set()
        for text in batch:
            new.update(text.split())
        if len(self.counts) + len(new) > CACHE:
            self.counts.clear()
        self.add({MARK + w for w in new if w not in self.counts})


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    return {p: -math.log(rank + 1) for rank, p in reversed(list(enumerate(pieces)))}


@lru_cache(maxsize=2)
def piece_trie(path: str) -> PieceTrie:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return PieceTrie(zipf_scores([model.id_to_piece(i) for i in usual]))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens per row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches):
        trie = piece_trie(vocabulary)
        for batch in batches:
            got = batch.column(1).to_pylist()
            trie.prepare(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.split()) for t in got], pa.int64()), pa.array([trie.count(t) for t in got], pa.int64())], ["doc_id", "n_words", "n_tokens"]
            )

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run, lambda: piece_trie(vocabulary).counts.clear()), "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
