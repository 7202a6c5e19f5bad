"""Quality classifier: ordinal cumulative-link regression on graded ratings, over hashed text.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector w for all grades and ordered thresholds theta. x holds 1 for each
distinct hashed word of the whole text, and for how large a share of the words has a shape (capitals, runs of marks,
table bars, repeats). The expected grade is the sum of P(grade > k); documents are selected by the tail P(grade >= top).

Grades come from ``labels``: 0 toxic, 1 neither toxic nor good, 2 good. The model is fitted on the driver on at most ``sample``
labelled rows, those with the lowest hash of doc_id, by a fixed number of full-gradient steps from zero, so it is a function
of its rows. Words in fewer than ``least`` of them, and
features that no score test tells from chance, keep weight 0.

Edge cases: null and empty texts have shape features only; rows without a usable label are not fitted on, but scored; with
fewer than two grades among the labels nothing is fitted and every document is kept; repeated rows are scored each; empty
tables give no rows; further columns are ignored. Very long texts are taken whole. Ties: rows on the sample's border go by hash, doc_id
and grade, a document whose chance is the cut itself is kept.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm.common import ship, table, texts, tidied

BITS = 18
#: Most labelled rows to fit on.
SAMPLE = 8000
LEAST = 4
STEPS = 300
#: Standard deviations by which a feature's grades must differ.
CLEAR = 5.0
#: Keep a document whose chance of the top grade is at least this.
TAIL = 0.5
MARKS = "!?#$%&*|<>=~^+_/\\@"
#: Entries of a worker's table of chunks; it is emptied when full.
CACHE = 200_000


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) >> 32 - BITS


class Features:
    def __init__(self):
        self.cache: dict[str, tuple[int, int]] = {}

    def look(self, chunk: str) -> tuple[int, int]:
        """The chunk's word as a hash bucket, and its shapes as bits."""
        word = chunk.strip(".,;:\"'()[]{}" + MARKS)
        shape = (len(word) > 1 and word.isupper()) | (chunk != word and any(m in chunk for m in "!#$%&*")) << 1 | ("|" in chunk) << 2 | any(c.isdigit() for c in chunk) << 3
        return bucket(word.lower()), int(shape)

    def of(self, text: str) -> list[int]:
        chunks, cache = text.split(), self.cache
        if len(cache) > CACHE:
            cache.clear()
        distinct = set(chunks)
        for c in distinct:
            if c not in cache:
                cache[c] = self.look(c)
        words = {cache[c][0] for c in distinct}
        shapes = [0] * 16
        for c in chunks:
            shapes[cache[c][1]] += 1
        n = max(1, len(chunks))
        for bit, name in enumerate(("capitals", "marks", "bars", "digits")):
            share = sum(k for s, k in enumerate(shapes) if s >> bit & 1) / n
            words.add(bucket(f"\0{name} {math.ceil(share * 8)}"))
        words.add(bucket(f"\0repeats {round(8 * (1 - len(distinct) / n))}"))
        return sorted(words)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class CumulativeLink:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int, least: int = LEAST, steps: int = STEPS, l2: float = 1e-4, rate: float = 0.05, clear_by: float = CLEAR) -> CumulativeLink:
        weights = np.zeros(1 << BITS)
        gaps = np.zeros(n_grades - 1)  # theta_0, then logs of the steps up: the order holds by construction
        if len(set(grades.tolist())) < 2:
            return cls(weights.astype(np.float32), np.linspace(-40, -30, n_grades - 1))
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        index = np.concatenate(rows)
        used = np.bincount(index, minlength=1 << BITS) >= least
        owner, index = owner[used[index]], index[used[index]]
        names, index = np.unique(index, return_inverse=True)
        share = np.bincount(grades, minlength=n_grades) / len(grades)
        below = np.clip(np.cumsum(share)[:-1], 0.01, 0.99)
        theta = np.log(below / (1 - below))
        gaps[0], gaps[1:] = theta[0], np.log(np.maximum(np.diff(theta), 0.1))
        # score tests, one per threshold: only features whose documents' grades differ from the rest by more than chance are fitted
        clear = np.zeros(len(names), bool)
        for k in range(n_grades - 1):
            residual = (grades > k) - (grades > k).mean()
            z = np.bincount(index, residual[owner], len(names)) / np.sqrt(np.bincount(index, minlength=len(names)) * max((residual**2).mean(), 1e-9))
            clear |= np.abs(z) >= clear_by
        owner, index, names = owner[clear[index]], (np.cumsum(clear) - 1)[index[clear[index]]], names[clear]
        balance = np.full(len(rows), 1 / len(rows))
        w = np.zeros(len(names))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(gaps), np.zeros_like(gaps)]
        for step in range(1, steps + 1):
            theta = np.concatenate([[-np.inf], gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))]), [np.inf]])
            z = np.bincount(owner, w[index], len(rows))
            upper, lower = sigmoid(theta[grades + 1] - z), sigmoid(theta[grades] - z)
            p = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
            gz = balance * (up - low)
            gw = np.bincount(index, gz[owner], len(names)) + l2 * w
            gt = np.array([-(balance * up)[grades == k].sum() + (balance * low)[grades == k + 1].sum() for k in range(n_grades - 1)])
            gg = np.concatenate([[gt.sum()], [np.exp(gaps[k]) * gt[k:].sum() for k in range(1, n_grades - 1)]])
            for x, g, m, v in ((w, gw, state[0], state[1]), (gaps, gg, state[2], state[3])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights[names] = w
        return cls(weights.astype(np.float32), gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))]))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a row per score."""
        return 1 - sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])


def grade(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic is not null and quality is not null").select(
        "doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade")
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CumulativeLink:
    """Fit on at most ``sample`` labelled rows of ``docs``; that bound is also the bound of what is broadcast and collected."""
    ship(docs.sparkSession)
    rated = grade(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    def run(batches):
        features = Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features.of(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["grade", "features"])

    got = texts(docs).join(F.broadcast(rated), "doc_id").select("grade", "text").mapInArrow(tidied(run), "grade int, features array<int>").toArrow()
    rows = got.column("features").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (got.column("grade")[i].as_py(), rows[i]))
    return CumulativeLink.fit([np.array(rows[i], np.int64) for i in order], np.array([got.column("grade")[i].as_py() for i in order], np.int64), 3)


def score(docs: DataFrame, model: CumulativeLink, tail: float = TAIL) -> DataFrame:
    """``docs`` with expected_grade, p_top and keep."""
    ship(docs.sparkSession)
    schema = docs.select("doc_id").withColumns({"expected_grade": F.lit(0.0), "p_top": F.lit(0.0), "keep": F.lit(True)}).schema

    def run(batches):
        features = Features()
        for b in batches:
            z = np.array([model.weights[features.of(t)].sum(dtype=np.float64) for t in b.column(1).to_pylist()])
            above = model.above(z)
            top = above[:, -1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(1)), pa.array(top), pa.array(top >= tail)], ["doc_id", "expected_grade", "p_top", "keep"])

    return texts(docs).mapInArrow(tidied(run), schema)


def select(docs: DataFrame, model: CumulativeLink, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with their own columns."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches):
        features = Features()
        for b in batches:
            z = np.array([model.weights[features.of(t or "")].sum(dtype=np.float64) for t in b.column(names.index("text")).to_pylist()])
            yield b.filter(pa.array(model.above(z)[:, -1] >= tail))

    return docs.mapInArrow(tidied(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
