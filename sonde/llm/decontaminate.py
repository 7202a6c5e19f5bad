"""Benchmark decontamination: a BM25 inverted index of test items with block-max WAND, queried with every passage.

Words are blank-separated, lower-cased and stripped of marks. A passage is a window of twice the longest item's words,
every such length of words, so any run of an item's words lies whole in one. Term weights of an item are divided by its
threshold, the score that any passage with OVERLAP of the item's five-word shingles is sure to reach; so one bound, 1,
holds for all items and the search loses nothing that verification would accept. Searching takes three steps, each of
which only leaves out what cannot reach the bound: block maxima over the document's words; scores of the surviving blocks'
items over the document's words; block-max WAND over each passage for the items left. Every (passage, item) found is
verified: OVERLAP of the item's shingles in the passage, and at least PART of its question's (first half) and of its
answer's (second half).

The index goes to the executors in blocks of at most BLOCK_ITEMS items and BLOCK_CHARS letters, one pass each.

Edge cases: null and empty texts match nothing, nor do items without words; an item of fewer than five words is one shingle;
repeated rows and items are matched each, rows without doc_id too; items without item_id are left out; very long texts are taken whole; empty tables give no rows; further columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm.common import ship, table, texts, tidied

K1, B = 1.2, 0.75
SIZE = 5
OVERLAP, PART = 0.8, 0.5
#: Items in a posting block.
BLOCK = 32
#: The bound of what one pass broadcasts.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
#: Entries of a worker's table of chunks; it is emptied when full.
CACHE = 200_000
SLACK = 1e-9
EDGE = ".,;:!?\"'()[]{}<>|*#$%&~^+=/\\-_`"


def words_of(text: str) -> list[str]:
    return [w for c in text.lower().split() if (w := c.strip(EDGE))]


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    if not words:
        return []
    return list(dict.fromkeys(tuple(words[i : i + SIZE]) for i in range(max(1, len(words) - SIZE + 1))))


class Item:
    def __init__(self, item_id: int, text: str):
        self.item_id, self.words = item_id, words_of(text)
        self.shingles = shingles(self.words)
        half = (len(self.shingles) + 1) // 2
        self.question, self.answer = self.shingles[:half], self.shingles[half:] or self.shingles[:half]

    def verify(self, found: set[tuple[str, ...]]) -> tuple[float, float, float] | None:
        share = lambda part: sum(s in found for s in part) / len(part)
        out = share(self.shingles), share(self.question), share(self.answer)
        return out if out[0] >= OVERLAP and out[1] >= PART and out[2] >= PART else None


class Statistics:
    """Number of items, their mean length and the document frequency of each word, over all blocks."""

    def __init__(self, blocks: list[list[tuple[int, str]]]):
        self.df: Counter[str] = Counter()
        n = total = 0
        for block in blocks:
            for _, text in block:
                if words := words_of(text):
                    n += 1
                    total += len(words)
                    self.df.update(set(words))
        self.n = max(1, n)
        self.mean = total / self.n


class BlockMaxIndex:
    def __init__(self, items: list[tuple[int, str]], over: Statistics | None = None):
        self.items = [x for x in (Item(i, t) for i, t in items) if x.words]
        tf = [Counter(x.words) for x in self.items]
        over = over or Statistics([items])
        n, mean, df = over.n, over.mean, over.df
        self.terms = {t: i for i, t in enumerate(sorted({t for c in tf for t in c}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.longest = max((len(x.words) for x in self.items), default=1)
        for at, (x, c) in enumerate(zip(self.items, tf, strict=True)):
            norm = K1 * (1 - B + B * len(x.words) / mean)
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * k * (K1 + 1) / (k + norm) for t, k in c.items()}
            lost = math.floor((1 - OVERLAP) * len(x.shingles) + 1e-9)  # shingles that may be missing, so words that may be
            bound = sum(weight.values()) - sum(sorted(weight.values(), reverse=True)[:lost])
            bound = max(bound, min(weight.values()) / 2)
            for t, w in weight.items():
                postings[self.terms[t]].append((at, w / bound))
        self.ptr = np.cumsum([0, *map(len, postings)])
        self.item = np.array([i for p in postings for i, _ in p], np.int64)
        self.value = np.array([v for p in postings for _, v in p])
        blocks: list[dict[int, float]] = []
        for p in postings:
            top: dict[int, float] = {}
            for i, v in p:
                top[i // BLOCK] = max(top.get(i // BLOCK, 0.0), v)
            blocks.append(top)
        self.blocks = blocks
        self.block_ptr = np.cumsum([0, *map(len, blocks)])
        self.block = np.array([b for top in blocks for b in top], np.int64)
        self.block_max = np.array([v for top in blocks for v in top.values()])
        self.term_max = np.array([max(top.values()) for top in blocks])
        self.n_blocks = len(self.items) // BLOCK + 1

    @staticmethod
    def gather(ptr: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Places of the postings of these terms."""
        start, size = ptr[terms], ptr[terms + 1] - ptr[terms]
        return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())

    def above(self, terms: np.ndarray) -> np.ndarray:
        """Items whose score for these distinct terms reaches the bound."""
        if self.term_max[terms].sum() < 1 - SLACK:
            return np.empty(0, np.int64)
        at = self.gather(self.block_ptr, terms)
        live = np.bincount(self.block[at], self.block_max[at], self.n_blocks) >= 1 - SLACK
        if not live.any():
            return np.empty(0, np.int64)
        at = self.gather(self.ptr, terms)
        at = at[live[self.item[at] // BLOCK]]
        return np.flatnonzero(np.bincount(self.item[at], self.value[at], len(self.items)) >= 1 - SLACK)

    def wand(self, terms: list[int], only: list[int]) -> list[tuple[int, float]]:
        """(item, score) of each item of ``only`` that reaches the bound, by block-max WAND over the terms' postings."""
        allowed = set(only)
        cursors = []
        for t in terms:
            a, b = self.ptr[t], self.ptr[t + 1]
            docs = [(i, v) for i, v in zip(self.item[a:b].tolist(), self.value[a:b].tolist(), strict=True) if i in allowed]
            if docs:
                cursors.append([0, docs, float(self.term_max[t]), self.blocks[t]])
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[1][c[0]][0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += c[2]
                if total >= 1 - SLACK:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][1][cursors[pivot][0]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]][0] == item:
                pivot += 1
            if sum(c[3].get(item // BLOCK, 0.0) for c in cursors[: pivot + 1]) < 1 - SLACK:
                # no item of this block can do, up to where another list comes in
                to = (item // BLOCK + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][1][cursors[pivot + 1][0]][0])
                self.skip(cursors[: pivot + 1], max(to, item + 1))
            elif cursors[0][1][cursors[0][0]][0] == item:
                score = sum(c[1][c[0]][1] for c in cursors[: pivot + 1])
                if score >= 1 - SLACK:
                    out.append((item, score))
                self.skip(cursors[: pivot + 1], item + 1)
            else:
                self.skip(cursors[:pivot], item)
            cursors = [c for c in cursors if c[0] < len(c[1])]
        return out

    @staticmethod
    def skip(cursors: list, to: int) -> None:
        for c in cursors:
            while c[0] < len(c[1]) and c[1][c[0]][0] < to:
                c[0] += 1


class Searcher:
    """An index and a table from blank-separated chunks to its terms, for one worker's task."""

    def __init__(self, index: BlockMaxIndex):
        self.index, self.cache = index, {}

    def search(self, text: str) -> list[tuple[int, float, float, float, float]]:
        """(item_id, score, overlap, question overlap, answer overlap) of each item verified in the text, best passage first."""
        index, cache = self.index, self.cache
        chunks = text.split()
        got = list(map(cache.get, chunks))
        if None in got:
            if len(cache) > CACHE:
                cache.clear()
            for i, t in enumerate(got):
                if t is None:
                    w = chunks[i].lower().strip(EDGE)
                    got[i] = cache[chunks[i]] = index.terms.get(w, -1) if w else -2
        ids = np.fromiter(got, np.int64, len(got))
        items = index.above(np.unique(ids[ids >= 0]))
        if not len(items):
            return []
        words = words_of(text)
        ids = ids[ids != -2]
        best: dict[int, tuple[float, float, float, float]] = {}
        step = max(index.longest, SIZE)
        for start in range(0, max(1, len(words) - step), step):
            terms = np.unique(ids[start : start + 2 * step])
            terms = terms[terms >= 0]
            if index.term_max[terms].sum() < 1 - SLACK:
                continue
            found = index.wand(terms.tolist(), items.tolist())
            if found:
                there = set(shingles(words[start : start + 2 * step]))
                if len(words) < SIZE:
                    there.add(tuple(words))
                for item, score in found:
                    x = index.items[item]
                    if len(x.words) < SIZE:  # a short item is one shingle of its own length
                        n = len(x.words)
                        there |= {tuple(words[i : i + n]) for i in range(start, min(start + 2 * step, len(words)) - n + 1)}
                    share = x.verify(there)
                    if share and (item not in best or (share[0], score) > (best[item][1], best[item][0])):
                        best[item] = (score, *share)
        return [(index.items[i].item_id, *v) for i, v in sorted(best.items())]


def index_blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks within BLOCK_ITEMS and BLOCK_CHARS, streamed to the driver one after another."""
    blocks: list[list[tuple[int, str]]] = [[]]
    chars = 0
    rows = items.where("item_id is not null and text is not null and text <> ''").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        if blocks[-1] and (len(blocks[-1]) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            blocks.append([])
            chars = 0
        blocks[-1].append((item_id, text))
        chars += len(text)
    return blocks


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score (1: the item's threshold), overlap, question_overlap, answer_overlap: what ``docs`` hold of ``items``."""
    ship(docs.sparkSession)
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    rows = texts(docs).select(F.col("doc_id").cast("long"), "text")

    def search(block):
        index = BlockMaxIndex(block, over)

        def run(batches):
            searcher = Searcher(index)
            for b in batches:
                out = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in searcher.search(t)]
                kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        return rows.mapInArrow(tidied(run), schema)

    blocks = index_blocks(items)
    over = Statistics(blocks)
    parts = [search(b) for b in blocks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns; one pass per index block."""
    ship(docs.sparkSession)
    names = docs.columns

    def keep(rows, block):
        index = BlockMaxIndex(block, over)

        def run(batches):
            searcher = Searcher(index)
            for b in batches:
                yield b.filter(pa.array([not searcher.search(t or "") for t in b.column(names.index("text")).to_pylist()], pa.bool_()))

        return rows.mapInArrow(tidied(run), docs.schema)

    blocks = index_blocks(items)
    over = Statistics(blocks)
    for block in blocks:
        docs = keep(docs, block)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
