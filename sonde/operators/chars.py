"""TF-IDF over the character n-grams of whole texts by scans: no document's n-grams are ever written down.

An n-gram is a 64-bit number: its letters in 12 bits each, shorter ones being prefixes of longer, so of a text only the longest
n-grams are sorted and the others are counted from them. N-grams with a letter beyond U+0FFE are 63-bit hashes instead.

The first scan counts in how many documents each n-gram is; that table, one row an n-gram, is staged. The second counts a
document's n-grams again, looks up their frequencies and yields its vector, as rows, as totals, or as scores of queries. Only
n-grams of two documents or more are looked up: one that is not among them is in its own document alone. The table is read in
slices of SLICE rows for each PIECE of postings; a worker keeps it between pieces only if it is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.operators.scan import CHUNK, DIGITS, Best, Scores, arrow_rows, asked_blocks
from sonde.sources.staging import staged, staged_at
from sonde.sources.workers import tidied

BITS, LONGEST = 12, 5
LETTERS = (1 << BITS) - 1
#: Postings that are counted or weighted at a time; rows of the table of frequencies that are held.
PIECE, SLICE = 2_000_000, 2_000_000
#: Texts of an Arrow batch.
ROWS = 256
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def wide(c: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams at all places, by length, and their places; those with letters beyond LETTERS by hash, below zero."""
    out, places = [], []
    for size in range(low, min(high, len(c)) + 1):
        n = len(c) - size + 1
        packed, hashed, large = np.zeros(n, np.int64), np.full(n, size, np.uint64), np.zeros(n, bool)
        for j in range(size):
            letter = c[j : j + n]
            packed = packed << BITS | letter
            hashed = hashed * STEP + letter.astype(np.uint64)
            large |= letter > LETTERS
        hashed = (hashed ^ hashed >> np.uint64(32)) * MIX
        hashed = (hashed ^ hashed >> np.uint64(29)) | np.uint64(1 << 63)
        out.append(np.where(large, hashed.view(np.int64), packed))
        places.append(np.arange(n))
    return (np.concatenate(out), np.concatenate(places)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def count(texts: str | list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, or of several together, and how often each occurs."""
    if not isinstance(texts, str):
        if len(texts) == 1:
            return count(texts[0], low, high)
        each = [count(t, low, high) for t in texts]
        grams, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([n for _, n in each]), len(grams)).astype(np.int64)
    letters = codes(texts)
    n = len(letters)
    if n < low:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.zeros(n + high - 1, np.int64)  # filled up with zeros, which are no letters
    np.add(letters, 1, out=c[:n])
    if int(letters.max()) >= LETTERS:
        return np.unique(wide(c[:n], low, high)[0], return_counts=True)
    grams = c[:n].copy()
    for j in range(1, high):
        grams <<= BITS
        grams |= c[j : n + j]
    grams.sort()
    found, many, tf = [], [], None
    new = np.empty(n, bool)
    for size in range(high, low - 1, -1):
        if size < high:
            grams = grams >> BITS
        new[0] = True
        np.not_equal(grams[1:], grams[:-1], out=new[1 : len(grams)])
        first = np.flatnonzero(new[: len(grams)])
        tf = np.diff(first, append=len(grams)) if tf is None else np.add.reduceat(tf, first)
        grams = grams[first]
        # those that reach past the end of the text
        whole = np.flatnonzero(grams & LETTERS)
        found.append(grams[whole]), many.append(tf[whole])
    return np.concatenate(found), np.concatenate(many)


def spelled(grams: np.ndarray, texts: str | list[str], low: int, high: int) -> list[str]:
    """The n-grams as strings; ``texts`` they are from, for those that are hashes."""
    out = np.empty(len(grams), object)
    for size in range(low, high + 1):
        mine = np.flatnonzero((grams >= 1 << BITS * (size - 1)) & (grams < 1 << BITS * size))
        letters = np.stack([(grams[mine] >> BITS * j & LETTERS) - 1 for j in range(size - 1, -1, -1)], axis=1)
        text = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        out[mine] = [text[a : a + size] for a in range(0, len(text), size)]
    hashes = np.flatnonzero(grams < 0)
    if len(hashes):
        names = {}
        for t in [texts] if isinstance(texts, str) else texts:
            c = codes(t).astype(np.int64) + 1
            for size in range(low, high + 1):
                key, place = wide(c, size, size)
                names |= {k: t[p : p + size] for k, p in zip(key.tolist(), place.tolist(), strict=True) if k < 0}
        out[hashes] = [names[k] for k in grams[hashes].tolist()]
    return out.tolist()


class Table:
    """Places of distinct sorted keys: a slot for each by hash, the later of two in one slot; the other ones by search."""

    def __init__(self, keys: np.ndarray, order: np.ndarray | None = None):
        self.keys, every = keys, np.arange(len(keys)) if order is None else order
        self.shift = np.uint64(64 - max(8, len(keys).bit_length() + 1))
        self.slot = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.slot[self.place(keys[every])] = every
        self.lost = np.flatnonzero(self.slot[self.place(keys)] != np.arange(len(keys)))
        self.lost_keys = keys[self.lost]

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * MIX >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it is not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        out = self.slot[self.place(keys)]
        other = np.flatnonzero(self.keys[out] != keys)
        out[other] = -1
        if len(other) and len(self.lost):
            at = np.minimum(np.searchsorted(self.lost_keys, keys[other]), len(self.lost) - 1)
            hit = self.lost_keys[at] == keys[other]
            out[other[hit]] = self.lost[at[hit]]
        return out


class Weights:
    """idf of n-grams, and which of the asked they are (-1: none), from the staged table's files."""

    def __init__(self, urls: list[str], n: int, asked: np.ndarray | None):
        self.urls, self.n, self.asked = urls, n, None if asked is None else Table(asked)
        self.held: list[tuple[Table, np.ndarray, np.ndarray | None]] | None = None

    def idf(self, df: np.ndarray | int) -> np.ndarray:
        return np.log((1 + self.n) / (1 + df)) + 1

    def slices(self) -> Iterator[tuple[Table, np.ndarray, np.ndarray | None]]:
        if self.held is not None:
            yield from self.held
            return
        seen = 0
        for url in self.urls:
            store, path = pafs.FileSystem.from_uri(url)
            with store.open_input_file(path) as f:
                for b in pa.parquet.ParquetFile(f).iter_batches(SLICE):
                    grams, df = b.column(0).to_numpy(), b.column(1).to_numpy()
                    part = Table(grams, np.argsort(df, kind="stable")), self.idf(df), None if self.asked is None else self.asked.find(grams)
                    seen += 1
                    yield part
        if seen <= 1:
            self.held = [part] if seen else []

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        idf = np.full(len(grams), self.idf(1))
        asked = None if self.asked is None else np.full(len(grams), -1, np.int32)
        known = np.zeros(len(grams), bool)
        for table, weight, term in self.slices():
            inside = np.flatnonzero((grams >= table.keys[0]) & (grams <= table.keys[-1])) if len(table.keys) else np.empty(0, np.int64)
            at = table.find(grams[inside])
            hit = np.flatnonzero(at >= 0)
            at, inside = at[hit], inside[hit]
            idf[inside], known[inside] = weight[at], True
            if term is not None:
                asked[inside] = term[at]
        if self.asked is not None:
            alone = np.flatnonzero(~known)
            asked[alone] = self.asked.find(grams[alone])
        return idf, asked


def frequencies(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Staged: gram, df of ``rows`` (key, text or texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def close() -> pa.RecordBatch:
            grams, df = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(df)], ["gram", "df"])

        for b in batches:
            for t in b.column(1).to_pylist():
                held.append(count(t, low, high)[0])
                many += len(held[-1])
                if many >= 2 * PIECE:
                    yield close()
                    many = 0
        if held:
            yield close()

    with arrow_rows(rows.sparkSession, ROWS):
        return staged(rows.mapInArrow(tidied(run), "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")), "frequencies")


def repeated(table: DataFrame) -> list[str]:
    """Where the n-grams of two documents or more are, with their frequencies: files in ascending order of n-grams."""
    many = table.where("df > 1")
    parts = max(1, -(-many.count() // SLICE))
    out, path = staged_at(many.repartitionByRange(parts, "gram").sortWithinPartitions("gram"), "repeated")
    return sorted(out.inputFiles())


def vectors(batches: Iterator[pa.RecordBatch], low: int, high: int, weights: Weights) -> Iterator[tuple]:
    """keys, texts, ptr, n-grams, weights, asked of a piece's documents that have any n-grams."""
    for b in batches:
        keys, texts, place, held, many = b.column(0), b.column(1).to_pylist(), [], [], 0
        for i, t in enumerate(texts):
            found = count(t, low, high)
            if len(found[0]):
                place.append(i), held.append(found)
                many += len(found[0])
            if place and (many >= PIECE or i == len(texts) - 1):
                ptr = np.cumsum([0, *(len(g) for g, _ in held)])
                grams = np.concatenate([g for g, _ in held])
                idf, asked = weights.of(grams)
                weight = np.concatenate([n for _, n in held]) * idf
                norm = np.sqrt(np.add.reduceat(weight * weight, ptr[:-1]))
                weight /= np.repeat(norm, np.diff(ptr))
                yield keys.take(pa.array(place)), [texts[p] for p in place], ptr, grams, weight, asked
                place, held, many = [], [], 0


def weight_rows(rows: DataFrame, low: int, high: int, urls: list[str], n: int) -> DataFrame:
    """key, term, weight; nothing is staged."""
    key, kind = rows.columns[0], rows.schema[0].dataType.simpleString()

    def run(batches):
        for keys, texts, ptr, grams, weight, _ in vectors(batches, low, high, Weights(urls, n, None)):
            for i, t in enumerate(texts):
                mine = slice(ptr[i], ptr[i + 1])
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.full(ptr[i + 1] - ptr[i], i))), pa.array(spelled(grams[mine], t, low, high), pa.string()), pa.array(weight[mine])], [key, "term", "weight"])

    return rows.mapInArrow(tidied(run), f"`{key}` {kind}, term string, weight double")


def total_rows(rows: DataFrame, low: int, high: int, urls: list[str], n: int) -> DataFrame:
    """Staged: key, n, total, most of each document's weights."""
    key, kind = rows.columns[0], rows.schema[0].dataType.simpleString()

    def run(batches):
        for keys, _, ptr, _, weight, _ in vectors(batches, low, high, Weights(urls, n, None)):
            columns = [keys, pa.array(np.diff(ptr)), pa.array(np.add.reduceat(weight, ptr[:-1])), pa.array(np.maximum.reduceat(weight, ptr[:-1]))]
            yield pa.RecordBatch.from_arrays(columns, [key, "n", "total", "most"])

    with arrow_rows(rows.sparkSession, ROWS):
        return staged(rows.mapInArrow(tidied(run), f"`{key}` {kind}, n long, total double, most double"), "totals")


def score_rows(rows: DataFrame, low: int, high: int, urls: list[str], n: int, asked: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray], n_queries: int, k: int | None) -> DataFrame:
    """Staged: asked, key, similarity; of each task the k best of each query, or all without k. ``asked``: sorted n-grams."""
    spark, kind = rows.sparkSession, rows.schema[0].dataType.simpleString()
    sent = spark.sparkContext.broadcast((asked, *postings))

    def run(batches):
        asked, query, term, weight = sent.value
        scores, best, key_type = Scores(query, term, weight, len(asked), n_queries), Best(n_queries, k or 1), None
        names = ["asked", "key", "similarity"]
        for keys, _, ptr, _, value, word in vectors(batches, low, high, Weights(urls, n, asked)):
            key_type, names_of = keys.type, keys.to_numpy(zero_copy_only=False)
            doc, mine = np.repeat(np.arange(len(keys)), np.diff(ptr)), np.flatnonzero(word >= 0)
            doc, word, value = doc[mine], word[mine], value[mine]
            ends = np.searchsorted(doc, np.arange(0, len(keys) + CHUNK, CHUNK))
            for a, (first, last) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                got = scores.of(min(CHUNK, len(keys) - a * CHUNK), doc[first:last] - a * CHUNK, word[first:last], value[first:last])
                d, q = np.nonzero(got > best.floor(k))
                if k is None:
                    yield pa.RecordBatch.from_arrays([pa.array(q), keys.take(pa.array(d + a * CHUNK)), pa.array(got[d, q])], names)
                elif len(d):
                    best.add(q, names_of[d + a * CHUNK], got[d, q])
        if k is not None and len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.key, key_type), pa.array(best.score)], names)

    with arrow_rows(spark, ROWS):
        return staged(rows.mapInArrow(tidied(run), f"asked long, key {kind}, similarity double"), "found")


def search(rows: DataFrame, low: int, high: int, table: DataFrame, urls: list[str], n: int, asked: DataFrame, k: int | None) -> list[DataFrame]:
    """asked, key, similarity, in parts: of each query's (asked, term, tf) at least the k best of ``rows`` (key, text or texts)."""
    spark, found = rows.sparkSession, []
    for numbers, some in asked_blocks(asked):
        terms = some["term"].combine_chunks().dictionary_encode()
        grams = np.array([int(wide(codes(t).astype(np.int64) + 1, len(t), len(t))[0][0]) for t in terms.dictionary.to_pylist()], np.int64)
        have = table.join(spark.createDataFrame(pa.table({"gram": np.unique(grams)})), "gram").toArrow().sort_by("gram")
        known, df = have["gram"].to_numpy(), have["df"].to_numpy()
        term = Table(known).find(grams)[terms.indices.to_numpy()]
        query, tf = np.searchsorted(numbers, some["asked"].to_numpy()), some["tf"].to_numpy()
        mine = np.flatnonzero(term >= 0)
        if not len(mine):
            continue
        query, term, weight = query[mine], term[mine].astype(np.int64), tf[mine] * (np.log((1 + n) / (1 + df[term[mine]])) + 1)
        weight /= np.sqrt(np.bincount(query, weight * weight, len(numbers)))[query]
        part = score_rows(rows, low, high, urls, n, known, (query, term, weight), len(numbers), k)
        at = F.element_at(F.lit(numbers.tolist()), (F.col("asked") + 1).cast("int"))
        found.append(part.select(at.alias("asked"), "key", "similarity"))
    return found
