"""BPE encoding and decoding with a merge automaton.

The merges are compiled into a deterministic automaton over tokens, one *merge gadget* per rule, in rank order. It
starts with one state in which every base symbol loops. The gadget of the k-th rule (u, v) -> uv

* copies the state that u leads to, without its v-arc, and lets u lead to the copy (u directly before v is no longer
  a tokenisation), and
* gives every state with a u-arc a uv-arc to where that v-arc led.

All arcs with one label lead to one state, so ``target[token]`` is the whole transition function but for the question
which arcs a state has. A state is stored as (parent, cut label, rule number), i.e. as the copies that made it. An arc t
is missing exactly if one of the cuts in its chain hit a token on t's left spine while that token was still the newest on
it; a cut in the chain of x's state is a rule whose left side lies on x's right spine. ``step`` decides this with the rule
table and memoises the answer: encoding is a walk through that transition table.

A word's tokenisation is the only accepted path that spells it, and so is that of each of its prefixes: the arc that ends
at letter i follows from the arcs before it, and is kept in a table by prefix that all words share (the letter-by-letter
automaton, made as far as texts need it). Encoding walks that table and reads the path back. Decoding emits the arcs'
labels.

Edge cases: null and empty texts give no ids and an empty decoded text; very long words are walked in linear time; rows
are independent, so ties and repeated rows keep their own results; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sonde.llm.common import documents, ship, texts, tidied

INF = 1 << 60
#: Up to this character the library and Python agree on letters, digits, case and composition.
LATIN = "\u024f"
#: Entries a table of a worker may hold before it is emptied; all are emptied when a task ends.
CACHE = 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.ids, self.end, n = vocab, end, max(vocab.values()) + 1
        self.labels = [""] * n
        for text, i in vocab.items():
            self.labels[i] = text
        self.left, self.right = [-1] * n, [-1] * n  # the parts of a merged token
        self.born = [-1] * n  # the rule that made a token; base symbols are there from the start
        self.rule: dict[tuple[int, int], int] = {}
        self.parent, self.cut, self.made = [-1], [-1], [-1]  # states; 0 is the start
        self.target = [0] * n
        self.dead: set[int] = set()
        self.table: dict[int, bool] = {}
        self.prefixes: dict[str, int] = {}
        self.width = n
        for k, (a, b) in enumerate(merges):
            self.gadget(k, vocab[a], vocab[b], vocab[a + b])
        self.longest = max(map(len, vocab), default=1)
        self.table.clear()  # answers given while rules were still missing

    def gadget(self, k: int, u: int, v: int, uv: int) -> None:
        if u in self.dead or v in self.dead or not self.allows(u, v):
            self.dead.add(uv)  # no arc to bridge: the rule can never fire
            return
        to = self.target[v]
        self.parent.append(self.target[u])
        self.cut.append(v)
        self.made.append(k)
        self.target[u] = len(self.parent) - 1
        self.target[uv] = to
        self.left[uv], self.right[uv], self.born[uv] = u, v, k
        self.rule[u, v] = k

    def allows(self, x: int, t: int) -> bool:
        """Whether the state that x leads to has a t-arc."""
        left, right, born, rule = self.left, self.right, self.born, self.rule
        t_end = INF
        while t >= 0:
            y, y_end = x, INF
            while y >= 0:
                k = rule.get((y, t))
                # the cut of t after y: made after both existed, before y was merged on, not after t was
                if k is not None and born[y] < k < y_end and born[t] < k <= t_end:
                    return False
                y_end, y = born[y], right[y]
            t_end, t = born[t], left[t]
        return True

    def step(self, x: int, t: int) -> bool:
        key = x * self.width + t
        out = self.table.get(key)
        if out is None:
            if len(self.table) > 4 * CACHE:
                self.table.clear()
            out = self.table[key] = self.allows(x, t)
        return out

    def last(self, word: str, i: int) -> int:
        """The only arc that can end at letter i of ``word``, whatever follows; the table of prefixes holds it."""
        prefix = word[:i]
        out = self.prefixes.get(prefix)
        if out is None:
            ids, dead = self.ids, self.dead
            out = -1
            for j in range(max(0, i - self.longest), i):
                t = ids.get(prefix[j:], -1)
                if t >= 0 and t not in dead and (not j or ((x := self.last(word, j)) >= 0 and self.step(x, t))):
                    out = t
                    break
            self.prefixes[prefix] = out
        return out

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-split word (byte-level characters)."""
        ids, dead, n, end = self.ids, self.dead, len(word), self.end
        t = ids.get(word + end, -1)
        if t >= 0 and t not in dead:
            return [t]
        if len(self.prefixes) > CACHE:
            self.prefixes.clear()
        if n > 60:
            return self.encode_long(word)
        for j in range(max(0, n - self.longest), n):
            t = ids.get(word[j:] + end, -1)
            if t >= 0 and t not in dead and (not j or ((x := self.last(word, j)) >= 0 and self.step(x, t))):
                break
        else:
            raise ValueError(f"no tokenisation of {word!r}")
        path = [t]
        while j > 0:
            t = self.last(word, j)
            path.append(t)
            j -= len(self.labels[t])
        return path[::-1]

    def encode_long(self, word: str) -> list[int]:
        """As ``encode``, with the prefixes' arcs in a list of the word's own."""
        ids, dead, n = self.ids, self.dead, len(word)
        arc = [-1] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                t = ids.get(word[j:i] + self.end * (i == n), -1)
                if t >= 0 and t not in dead and (not j or (arc[j] >= 0 and self.step(arc[j], t))):
                    arc[i] = t
                    break
        path, i = [], n
        while i > 0:
            if arc[i] < 0:
                raise ValueError(f"no tokenisation of {word[:60]!r}")
            path.append(arc[i])
            i -= len(self.labels[arc[i]]) - len(self.end) * (i == n)
        return path[::-1]

    def decode(self, ids: list[int]) -> list[str]:
        return [self.labels[i] for i in ids]


class WordBpe:
    """A tokenizer file with NFC, blank folding, lower case, a split pattern, byte-level letters and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.machine = MergeAutomaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            if i >= len(self.machine.labels):
                self.machine.labels += [""] * (i + 1 - len(self.machine.labels))
            self.machine.labels[i] = text
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_alphabet()
        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.of_word: dict[str, tuple[bytes, str]] = {}

    def piece(self, text: str) -> tuple[bytes, str]:
        """Ids and labels of a text without special tokens."""
        if text and max(text) > LATIN:  # the library's Unicode tables decide what is a letter
            return self.foreign(text)
        text = unicodedata.normalize("NFC", text).lower()
        got = []
        for w in self.words.findall(text):
            out = self.of_word.get(w)
            if out is None:
                if len(self.of_word) >= CACHE:
                    self.of_word.clear()
                ids = self.machine.encode("".join(map(self.letters.__getitem__, w.encode())) if not (w.isascii() and w.isprintable()) else w)
                out = self.of_word[w] = (struct.pack(f"<{len(ids)}I", *ids), " ".join(self.machine.decode(ids)))
            got.append(out)
        return b"".join(x for x, _ in got), " ".join(x for _, x in got)

    def foreign(self, text: str) -> tuple[bytes, str]:
        tool = self.library
        words = [w for w, _ in tool.pre_tokenizer.pre_tokenize_str(tool.normalizer.normalize_str(text))]
        ids = [i for w in words for i in self.machine.encode(w)]
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(self.machine.decode(ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Little-endian 32-bit ids, and the decoded text."""
        if "<|" in text and self.at_special.search(text):
            parts = []
            for x in self.at_special.split(text):
                if x in self.special:
                    parts.append((struct.pack("<I", self.special[x]), x))
                elif x:
                    parts.append(self.encode(x))
            return b"".join(a for a, _ in parts), " ".join(b for _, b in parts if b)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks to Python, letters to the pattern
            return self.piece(text)
        chunks, cache = text.split(), self.cache  # the pattern never matches across blanks
        got = list(map(cache.get, chunks))
        if None in got:
            if len(cache) >= CACHE:
                cache.clear()
            for i, out in enumerate(got):
                if out is None:
                    out = cache.get(chunks[i])
                    got[i] = out if out is not None else cache.setdefault(chunks[i], self.piece(chunks[i]))
        return b"".join([a for a, _ in got]), " ".join([b for _, b in got])


    def forget(self) -> None:
        """Empty the tables of words met so far."""
        for table in (self.cache, self.of_word, self.machine.prefixes, self.machine.table):
            table.clear()


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per worker process: tasks reuse it."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``; ``with_ids`` adds ids (array<int>) and decoded."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        import numpy as np

        bpe = word_bpe(tokenizer)
        for batch in batches:
            ids, labels = zip(*map(bpe.encode, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            columns = [
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in labels], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(labels, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run, lambda: word_bpe(tokenizer).forget()), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
