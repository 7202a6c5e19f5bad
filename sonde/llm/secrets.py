"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is what an assignment gives to a secret-like name, quoted or not, from 8 letters on, or any other run of 16 or more
key letters with a digit in it or a secret-like word before it. The
forest (CART trees on bootstrap samples, a random subset of features at each split) sees the candidate's length, its
changes between letter kinds, how much of it dictionary words cover, whether it lies in a path or an address, and the words
around it. It is trained on labelled findings, by default those of ``labelled_findings``: keys, tokens and passwords in
assignments and headers against hashes of commits, ids, paths, encoded pictures, version numbers and long plain words.

Edge cases: null and empty texts have no candidates; very long texts are scanned whole, very long runs are one candidate; repeated rows are scanned each; empty
tables give no rows; further columns are kept by ``redact`` and ignored by ``scan``; a null source is an empty one.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm.common import ship, table, tidied

CANDIDATE = re.compile(r"""[A-Za-z0-9+/_=.\-]{16,}""")
#: A value ends at a quote, a blank, a tag or the next assignment of a list. Without an assignment it has 16 letters or more.
VALUE = r"""(?:[^"'`\s<,;&]|<(?![/a-z])|[,;&](?![\w.-]+[:=]))"""
ASSIGNED = re.compile(
    r"""(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|authorization|bearer|credentials?)"""
    rf"""(?:["']?\s*(?:=>|:=|={{1,3}}|:)\s*(?:(?:bearer|basic)\s+)?["'`]?(?={VALUE}{{8}})|\s+(?:is\s+)?["'`]?(?={VALUE}{{16}}))({VALUE}+)"""
)
SECRET_WORDS = {"token", "key", "secret", "password", "passwd", "pwd", "auth", "authorization", "bearer", "api", "apikey", "credential", "credentials", "private", "access"}
PLAIN_WORDS = {"commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "id", "version", "revision", "href", "src", "url", "file", "path", "build", "etag", "example", "sample", "placeholder"}
CUT = 0.5
MASK = "[SECRET]"
TREES, DEPTH, FINDINGS, SEED = 30, 9, 3000, 7
NAMES = ("length", "changes", "digits", "capitals", "entropy", "coverage", "path", "address", "hex", "secret_near", "plain_near", "assigned", "quoted", "plain_source")


@lru_cache(maxsize=2)
def dictionary(vocabulary: str | None) -> frozenset[str]:
    """Dictionary words of four letters or more: the plain words of a tokenizer's vocabulary."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    import json

    with open(vocabulary, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    return frozenset(w for t in words if (w := t.lstrip("Ġ").lower()).isalpha() and w.isascii() and len(w) >= 4)


def coverage(text: str, words: frozenset[str]) -> float:
    """The share of letters in dictionary words, longest first from the left."""
    low, i, hit = text.lower(), 0, 0
    while i < len(low):
        for n in range(min(14, len(low) - i), 3, -1):
            if low[i : i + n] in words:
                hit += n
                i += n
                break
        else:
            i += 1
    return hit / max(1, len(low))


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def near_words(before: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", before.lower().replace("_", " "))[-4:]


def describe(text: str, start: int, end: int, source: str, words: frozenset[str]) -> list[float]:
    """The features of the candidate text[start:end]."""
    run = text[start:end]
    kinds = [kind(c) for c in run]
    n = len(run)
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    near = near_words(before)
    later = re.findall(r"[a-z0-9]+", after.lower())[:2]
    counts = [k / n for k in Counter(run).values()]
    return [
        float(len(run)),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count(2) / n,
        kinds.count(1) / n,
        -sum(p * math.log2(p) for p in counts),
        coverage(run, words),
        float(run.count("/") >= 2 or "." in run[-5:] or before.endswith(("/", "\\"))),
        float("://" in before[-30:] + run or "www." in run),
        float(all(c in string.hexdigits + "-" for c in run)),
        float(sum(w in SECRET_WORDS for w in near)),
        float(sum(w in PLAIN_WORDS for w in near + later)),
        float(bool(re.search(r"[:=]\s*[\"'`]?$", before))),
        float(before.endswith(('"', "'", "`"))),
        float(bool(re.search(r"test|example|sample|fixture|docs?/", source))),
    ]


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left child, right child, share of true findings."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        tries = max(1, round(math.sqrt(x.shape[1])))
        out = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []

            def grow(at: np.ndarray, left: int) -> int:
                me, p = len(nodes), float(y[at].mean())
                nodes.append([-1, 0.0, -1, -1, p])
                if left and 0 < p < 1 and len(at) >= 4:
                    best = (np.inf, -1, 0.0)
                    for f in rng.choice(x.shape[1], tries, replace=False):
                        order = np.argsort(x[at, f], kind="stable")
                        v, ones = x[at, f][order], np.cumsum(y[at][order])
                        cut = np.flatnonzero(v[1:] > v[:-1])
                        if len(cut):
                            a, n, total = cut + 1.0, len(at), ones[-1]
                            la, lb = ones[cut] / a, (total - ones[cut]) / (n - a)
                            gini = a * la * (1 - la) + (n - a) * lb * (1 - lb)
                            i = int(np.argmin(gini))
                            if gini[i] < best[0]:
                                best = (gini[i], int(f), float(v[cut[i]] + v[cut[i] + 1]) / 2)
                    if best[1] >= 0:
                        low = x[at, best[1]] <= best[2]
                        nodes[me][:2] = best[1:]
                        nodes[me][2] = grow(at[low], left - 1)
                        nodes[me][3] = grow(at[~low], left - 1)
                return me

            grow(rows, depth)
            a = np.array(nodes)
            out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return cls(out)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def labelled_findings(n: int = FINDINGS, seed: int = SEED, words: frozenset[str] | None = None) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, source, label): findings as a reviewer would have labelled them, half of them secrets."""
    rng = random.Random(seed)
    vocabulary = sorted(words if words is not None else dictionary(None))
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    word = lambda: rng.choice(vocabulary)
    filler = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "qu", "ion", "la", "sch")) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        if i % 2:
            lead = rng.choice(("token = ", "secret: ", "api_key=", "password = ", "Authorization: Bearer ", "private key ", "access_token: ", "auth ", "API key is ", "SECRET_KEY="))
            key = rng.choice(
                (
                    lambda: pick("0123456789abcdef", rng.choice((32, 40, 64))),
                    lambda: pick(string.ascii_letters + string.digits, rng.randint(20, 60)),
                    lambda: pick(string.ascii_letters + string.digits + "+/", rng.randint(30, 64)) + "=",
                    lambda: rng.choice(("sk_live_", "ghp_", "AKIA", "xoxb-")) + pick(string.ascii_letters + string.digits, rng.randint(16, 40)),
                    lambda: pick(string.ascii_letters + string.digits + "_-", rng.randint(16, 30)),
                    lambda: pick(string.ascii_letters, rng.randint(16, 40)),
                    lambda: pick(string.ascii_letters + string.digits + "!@#$%^*?", rng.randint(65, 120)),
                )
            )()
            if rng.random() < 0.2:
                lead = rng.choice(("password = ", "password: ", "passwd=", "pwd: ", "secret = "))
                marked = lambda: pick("!@#$%^*_-", rng.randint(0, 2))
                key = rng.choice((lambda: pick(string.ascii_letters + string.digits + "!@#$%^*", rng.randint(9, 15)), lambda: word()[:8] + marked() + pick(string.digits, rng.randint(1, 4)) + marked() + pick(string.ascii_letters, rng.randint(2, 4))))()
        else:
            lead, key = rng.choice(
                (
                    lambda: (rng.choice(("commit ", "sha1: ", "checksum = ", "digest sha256:", "revision ", "md5 ")), pick("0123456789abcdef", rng.choice((32, 40, 64)))),
                    lambda: (rng.choice(("uuid: ", "id = ", "request id ", "")), "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))),
                    lambda: ("", "/".join(word() for _ in range(rng.randint(3, 6))) + rng.choice((".py", ".html", "", "/v2", ".png"))),
                    lambda: (rng.choice(("https://", "href=\"http://", "src=\"")), "www." + word() + ".com/" + "/".join(word() for _ in range(3)) + pick(string.digits, 3)),
                    lambda: (rng.choice(("", "key ", "token = ")), "-".join(word() for _ in range(rng.randint(3, 5))) + pick(string.digits, 2)),
                    lambda: (rng.choice(("", "call ", "id ", "number ")), pick(string.digits, rng.randint(16, 22))),
                    lambda: (rng.choice(("", "version ", "build ")), ".".join(pick(string.digits, rng.randint(1, 5)) for _ in range(7))),
                    lambda: ("", filler() + filler() + filler() + filler() + pick(string.digits, 2) + "@mail" + ".example.com"),
                    lambda: (rng.choice(("token = ", "api_key = ", "password: ")), rng.choice(("your_api_key_here_1", "XXXXXXXXXXXXXXXXXXX0", "example_token_000000", "changeme_changeme_1"))),
                    lambda: ("", pick("-=_.", rng.randint(16, 40)) + "1"),
                    lambda: (rng.choice(("token: ", "key = ", "password: ", "secret: ", "auth = ")), rng.choice(("", "", word() + "_", word() + "-", word() + ".")) + word() + word()),
                )
            )()
        quote = rng.choice(('"', "'", "")) if lead else ""
        before = " ".join(filler() for _ in range(rng.randint(0, 6))) + " " + (lead.upper() if rng.random() < 0.1 else lead) + quote
        if rng.random() < 0.08:
            key = key.upper()
        text = before + key + quote + " " + filler()
        source = rng.choice(("", "", "", "src/app", "docs/guide", "tests/fixture")) if i % 2 == 0 else rng.choice(("", "", "", "", "src/app", "config"))
        out.append((text, len(before), len(before) + len(key), source, i % 2))
    return out


def train(findings: list[tuple[str, int, int, str, int]], words: frozenset[str]) -> Forest:
    x = np.array([describe(t, a, b, s, words) for t, a, b, s, _ in findings])
    return Forest.fit(x, np.array([f[4] for f in findings], float))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans in order, none over another: assigned values first, runs in what lies between them."""
    assigned: list[tuple[int, int]] = []
    low = text.lower()
    if any(w in low for w in ("pass", "secret", "token", "key", "pwd", "auth", "credential", "bearer")):
        for m in ASSIGNED.finditer(text):
            a, b = m.span(1)
            if text[b : b + 1] not in ('"', "'", "`"):  # what ends a clause is no part of an unquoted value
                b = a + len(m[1].rstrip(".,;:)]}"))
            if b - a >= 8:
                assigned.append((a, b))
    out: list[tuple[int, int]] = []
    at = 0
    for a, b in [*assigned, (len(text), len(text))]:
        for m in CANDIDATE.finditer(text, at, a):
            if any(c.isdigit() for c in m[0]) or not SECRET_WORDS.isdisjoint(near_words(text[max(0, m.start() - 48) : m.start()])):
                out.append(m.span())
        if b > a:
            out.append((a, b))
        at = b
    return out


class Scanner:
    def __init__(self, forest: Forest, vocabulary: str | None = None, cut: float = CUT):
        self.forest, self.vocabulary, self.cut = forest, vocabulary, cut

    def scan(self, batch: list[str], sources: list[str]) -> list[list[tuple[int, int, float]]]:
        """(start, end, chance) of each candidate of each text."""
        words = dictionary(self.vocabulary)
        spans = [candidates(t) for t in batch]
        x = [describe(t, a, b, s, words) for t, s, found in zip(batch, sources, spans, strict=True) for a, b in found]
        chance = iter(self.forest.predict(np.array(x)).tolist() if x else [])
        return [[(a, b, next(chance)) for a, b in found] for found in spans]


def scanner(vocabulary: str | None = None) -> Scanner:
    words = dictionary(vocabulary)
    return Scanner(train(labelled_findings(words=words), words), vocabulary)


def scan(docs: DataFrame, model: Scanner) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start, end, chance of each secret) per row of ``docs``."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = model.scan(b.column(1).to_pylist(), b.column(2).to_pylist())
            kept = [[{"start": a, "end": e, "chance": p} for a, e, p in f if p >= model.cut] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([len(f) for f in kept], pa.int64()), pa.array(kept, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())])))],
                ["doc_id", "n_candidates", "n_secrets", "spans"],
            )

    source = F.coalesce("source", F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), source.alias("source"))
    return rows.mapInArrow(tidied(run), "doc_id long, n_candidates long, n_secrets long, spans array<struct<start: long, end: long, chance: double>>")


def redact(docs: DataFrame, model: Scanner) -> DataFrame:
    """``docs`` with each secret in text replaced by MASK (and n_chars, where there is one, counted again)."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for b in batches:
            got = b.column(names.index("text")).to_pylist()
            sources = [s or "" for s in b.column(names.index("source")).to_pylist()] if "source" in names else [""] * len(got)
            for i, found in enumerate(model.scan([t or "" for t in got], sources)):
                for a, e, p in reversed(found):
                    if p >= model.cut:
                        got[i] = got[i][:a] + MASK + got[i][e:]
            columns = list(b.columns)
            columns[names.index("text")] = pa.array(got, b.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    out = docs.mapInArrow(tidied(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), scanner())
