"""Token-ID output: one compressed file per shard, holding a wavelet matrix of the shard's ids.

A wavelet matrix keeps bit l (highest first) of all ids in plane l, in the order of the plane before, zeros before ones. With the
ones before a place (rank) and the place of a one (select) it answers ``access``, ``count`` and ``find`` without the ids.

File: MAGIC, a length-prefixed JSON head, the documents' ids and lengths (a zstd frame), the directory, then the blocks. A plane is
cut in blocks of BLOCK bits, each a zstd frame of its own with its bits and the ones before each STEP of them; the directory
has, by plane and block, where its frame ends and the plane's ones before it. So ``TokenFile`` reads the directory, and for a
query the one or two blocks a plane that rank and select need, of which it keeps a few.

Documents are dealt to shards by ascending doc_id ranges of about SHARD_BYTES of text, and a shard's ids to files of FILE_IDS, or
one document, each. Files in order hold the corpus in doc_id order. A file is written under a name of its own and then
moved to its place: a task that runs again leaves the same files.

Edge cases: null and empty texts are the end id alone; equal doc_ids share a shard, ordered by text, also across its files; a null
doc_id comes first; an empty table gives no files and no rows; a very long text is a file of its own; further columns are
ignored. Memory: a file's ids at a time.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonde.llm.bpe import LATIN, byte_alphabet
from sonde.llm.common import documents, new_path, ship, staged, tidied

MAGIC = b"SNDWM002"
#: Bits of a plane block, and between two counts of ones inside it (which fit 16 bits).
BLOCK, STEP = 1 << 16, 512
#: Text that one shard, i.e. one task, has about; and ids after which a shard begins another file.
SHARD_BYTES, FILE_IDS = 16 << 20, 4 << 20
END_ID = 0
#: Entries of a worker's tables of chunks and of pieces; one is emptied when it is full; tasks of one worker share them.
CACHE = 500_000
#: The letter that stands for a blank in byte-level vocabularies.
BLANK = byte_alphabet()[32]
#: Plane blocks that an open file keeps.
OPEN_BLOCKS = 256
#: Numbers of files a shard may have, and shards whose sizes are summed together.
FILES, RUN = 1 << 20, 1024


class Encoder:
    """ids of whole texts as the tokenizers library gives them, with a table of blank-led chunks.

    The file's split pattern always breaks before a blank, and around a line's end, unless other blanks stand there, so a text
    without such places is its lines' chunks and the id of a line's end between lines. A new chunk's pieces go to the library's BPE
    model; chunks with letters beyond Latin, texts with blanks in a row and those with special tokens go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.merge = self.tool.model.tokenize
        self.special = [t.content for t in self.tool.get_added_tokens_decoder().values()]
        self.letters = {i: c for i, c in enumerate(byte_alphabet())}
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.packed = [struct.Struct(f"<{n}I").pack for n in range(32)]
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, letters: str) -> bytes:
        """ids of one piece of the pattern, given in the vocabulary's letters."""
        ids = self.pieces.get(letters)
        if ids is None:
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            got = [t.id for t in self.merge(letters)]
            ids = self.pieces[letters] = self.packed[len(got)](*got) if len(got) < 32 else np.array(got, "<u4").tobytes()
        return ids

    def chunk(self, c: str, blank: bool) -> bytes:
        """ids of a chunk, after a blank or not; a plain word, bare or with one mark behind it, needs no search by the pattern."""
        lead = BLANK if blank else ""
        plain = c.isascii()
        if not plain and max(c) > LATIN:
            return self.whole(" " + c if blank else c)
        if c.isalpha():
            return self.piece(lead + (c if plain else self.lettered(c)))
        if c[-1] in ".,;:!?" and c[:-1].isalpha():
            return self.piece(lead + (c[:-1] if plain else self.lettered(c[:-1]))) + self.piece(c[-1])
        return b"".join([self.piece(self.lettered(p)) for p in self.split.findall(" " + c if blank else c)])

    def lettered(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.letters)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        cache = self.chunks
        chunks = text.replace("\n", " \n").split(" ")
        got = list(map(cache.get, chunks))
        if None in got:
            if len(cache) > CACHE:
                cache.clear()
            for i, ids in enumerate(got):
                if ids is None and i:
                    c = chunks[i]
                    if c[:1] == "\n":  # the end of a line, without a blank before it
                        if len(c) == 1 or c[1].isspace():
                            return self.whole(text)
                        got[i] = cache[c] = self.line_end + self.chunk(c[1:], False)
                    elif not c or c[0].isspace():  # blanks in a row
                        return self.whole(text)
                    else:
                        got[i] = cache[c] = self.chunk(c, True)
        got[0] = self.chunk(chunks[0], False) if chunks[0] else b""
        return b"".join(got)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def planes_of(ids: np.ndarray, levels: int) -> list[np.ndarray]:
    """The bit-planes of a wavelet matrix, packed."""
    out, now, other = [], ids.copy(), np.empty_like(ids)
    for level in range(levels - 1, -1, -1):
        one = (now & now.dtype.type(1 << level)).astype(bool)
        out.append(np.packbits(one, bitorder="little"))
        zeros = len(now) - int(np.count_nonzero(one))
        np.compress(~one, now, out=other[:zeros])
        np.compress(one, now, out=other[zeros:])
        now, other = other, now
    return out


def ones_by_step(plane: np.ndarray) -> np.ndarray:
    """Ones in each STEP bits of a packed plane."""
    whole = np.concatenate([plane, np.zeros(-len(plane) % (STEP // 8), np.uint8)])
    return np.bitwise_count(whole.view(np.uint64)).reshape(-1, STEP // 64).sum(1, dtype=np.int64)


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: int = 0) -> bytes:
    """The shard file of documents with these ids, one after another; the first ``nulls`` documents have no doc_id."""
    zstd = pa.Codec("zstd", compression_level=1)
    levels = max(1, int(ids.max(initial=0)).bit_length())
    width = np.uint32 if levels > 16 else np.uint16
    frames, ends, before, zeros, at = [], [], [], [], 0
    for plane in planes_of(ids.astype(width), levels):
        ones = ones_by_step(plane)
        ranks = np.concatenate([[0], np.cumsum(ones)])
        zeros.append(len(ids) - int(ranks[-1]))
        for a in range(0, len(ones), BLOCK // STEP):
            inside = (ranks[a : min(a + BLOCK // STEP, len(ones))] - ranks[a]).astype("<u2").tobytes()
            frames.append(zstd.compress(inside + plane[a * STEP // 8 : (a * STEP + BLOCK) // 8].tobytes(), asbytes=True))
            at += len(frames[-1])
            ends.append(at)
            before.append(int(ranks[a]))
    table = zstd.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes(), asbytes=True)
    directory = np.array([ends, before], "<i8").tobytes()
    head = json.dumps({"docs": len(doc_ids), "nulls": nulls, "ids": len(ids), "levels": levels, "zeros": zeros, "table": len(table)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, directory, *frames])


class TokenFile:
    """A shard file that is read as far as is asked for; ``read(at, size)`` gives its bytes."""

    def __init__(self, read: Callable[[int, int], bytes]):
        lead = read(0, len(MAGIC) + 4)
        if lead[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", lead, len(MAGIC))
        at = len(lead) + size
        head = json.loads(read(len(lead), size))
        self.read, self.zstd = read, pa.Codec("zstd")
        self.n_docs, self.nulls, self.n, self.levels, self.zeros = (head[k] for k in ("docs", "nulls", "ids", "levels", "zeros"))
        self.table = (at, head["table"])
        self.n_blocks = -(-self.n // BLOCK)
        at += head["table"]
        count = self.levels * self.n_blocks
        ends, self.before = np.frombuffer(read(at, 16 * count), "<i8").reshape(2, count)
        self.ends = np.concatenate([[0], ends]) + at + 16 * count
        self.open: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        return cls(lambda at, size: data[at : at + size])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """doc_id and number of ids of each document."""
        table = self.zstd.decompress(self.read(*self.table), 16 * self.n_docs, asbytes=True)
        return np.frombuffer(table, "<i8", self.n_docs), np.frombuffer(table, "<i8", self.n_docs, 8 * self.n_docs)

    def unpacked(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of block k of all planes' blocks: ones before each STEP, and the packed bits."""
        bits = min(BLOCK, self.n - k % self.n_blocks * BLOCK)
        steps = -(-bits // STEP)
        frame = self.read(int(self.ends[k]), int(self.ends[k + 1] - self.ends[k]))
        data = self.zstd.decompress(frame, 2 * steps + (bits + 7) // 8, asbytes=True)
        return np.frombuffer(data, "<u2", steps), np.frombuffer(data, np.uint8, (bits + 7) // 8, 2 * steps)

    def block(self, level: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        k = level * self.n_blocks + b
        if k in self.open:
            self.open.move_to_end(k)
        else:
            if len(self.open) >= OPEN_BLOCKS:
                self.open.popitem(last=False)
            self.open[k] = self.unpacked(k)
        return self.open[k]

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        ranks, bits = self.block(level, i // BLOCK)
        here = i % BLOCK
        out = int(self.before[level * self.n_blocks + i // BLOCK]) + int(ranks[here // STEP])
        out += int(np.bitwise_count(bits[here // STEP * STEP // 8 : here // 8]).sum())
        return out + (int(bits[here // 8] & ((1 << here % 8) - 1)).bit_count() if here % 8 else 0)

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        before = self.before[level * self.n_blocks : (level + 1) * self.n_blocks]
        before = before if bit else np.arange(self.n_blocks) * BLOCK - before
        b = int(np.searchsorted(before, k, side="right")) - 1
        k -= int(before[b])
        ranks, bits = self.block(level, b)
        inside = ranks.astype(np.int64) if bit else np.arange(len(ranks)) * STEP - ranks
        step = int(np.searchsorted(inside, k, side="right")) - 1
        part = np.unpackbits(bits[step * STEP // 8 : (step + 1) * STEP // 8], bitorder="little")
        return b * BLOCK + step * STEP + int(np.flatnonzero(part == bit)[k - int(inside[step])])

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for level in range(self.levels):
            _, bits = self.block(level, i // BLOCK)
            one = int(bits[i % BLOCK // 8]) >> i % 8 & 1
            ones = self.rank1(level, i)
            out = out << 1 | one
            i = self.zeros[level] + ones if one else i - ones
        return out

    def span(self, token: int, first: int, last: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self.rank1(level, first), self.rank1(level, last)
            first, last = (self.zeros[level] + a, self.zeros[level] + b) if token >> self.levels - 1 - level & 1 else (first - a, last - b)
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of ``token`` in [first, last)."""
        if token >> self.levels:
            return 0
        a, b = self.span(token, first, self.n if last is None else last)
        return b - a

    def find(self, token: int, k: int = 0) -> int:
        """Place of the k-th (from 0) occurrence, -1 if there is none."""
        a, b = self.span(token, 0, self.n) if not token >> self.levels else (0, 0)
        if k >= b - a:
            return -1
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> self.levels - 1 - level & 1
            i = self.select(level, bit, i - self.zeros[level] * bit)
        return i

    def all(self) -> np.ndarray:
        """Every id, by undoing the planes from the last to the first."""
        out = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for level in range(self.levels - 1, -1, -1):
            packed = np.concatenate([self.unpacked(level * self.n_blocks + b)[1] for b in range(self.n_blocks)]) if self.n else np.empty(0, np.uint8)
            one = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            up, zeros = np.empty_like(out), self.zeros[level]
            up[~one] = out[:zeros]
            up[one] = out[zeros:] | out.dtype.type(1 << self.levels - 1 - level)
            out = up
        return out


def open_store(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url)


def put(url: str, data: bytes) -> None:
    store, path = open_store(url)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def get(url: str) -> bytes:
    store, path = open_store(url)
    with store.open_input_stream(path) as f:
        return f.read()


def open_file(url: str) -> TokenFile:
    """The file in place: each read takes the bytes that it needs, no more."""
    store, path = open_store(url)
    f = store.open_input_file(path)

    def read(at: int, size: int) -> bytes:
        f.seek(at)
        return f.read(size)

    return TokenFile(read)


def write_files(docs: DataFrame, tokenizer: str, folder: str, shard_bytes: int = SHARD_BYTES, file_ids: int = FILE_IDS, end_id: int = END_ID) -> DataFrame:
    """Write the shard files of ``docs`` (doc_id, text) to ``folder``; returns shard (ascending with doc_id), path, n_docs, n_ids, one row per file."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("s")).head().s or 0
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    end = struct.pack("<I", end_id)

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        held, n_ids, files = ([], []), 0, 0

        def close():
            ids = np.frombuffer(b"".join(held[1]), "<u4")
            lengths = np.array([len(x) // 4 for x in held[1]], np.int64)
            url = f"{folder}/shard-{part:07d}-{files:05d}.wm"
            put(url, to_bytes(np.array([x or 0 for x in held[0]], np.int64), lengths, ids, held[0].count(None)))
            row = [[part * FILES + files], [url], [len(lengths)], [len(ids)]]
            held[0].clear(), held[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "n_docs", "n_ids"])

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), map(enc.encode, batch.column(1).to_pylist()), strict=True):
                if held[0] and n_ids + len(ids) // 4 >= file_ids:
                    yield close()
                    n_ids, files = 0, files + 1
                held[0].append(d)
                held[1].append(ids + end)
                n_ids += len(ids) // 4 + 1
        if held[0]:
            yield close()

    # ranges by a sample of doc_id: as many as the text has SHARD_BYTES, each in the order of doc_id
    dealt = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(tidied(run), "shard long, path string, n_docs long, n_ids long"), "token-files")


def starts(files: DataFrame) -> DataFrame:
    """shard, path and before, the ids in all files before; summed within runs of RUN shards, then over the runs."""
    run = F.floor(F.col("shard") / (FILES * RUN)).alias("run")
    sums = files.groupBy(run).agg(F.sum("n_ids").alias("ids"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("run", F.coalesce(F.sum("ids").over(earlier(Window.orderBy("run"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("run").orderBy("shard"))), F.lit(0))
    return files.withColumn("run", run).withColumn("inside", inside).join(base, "run").select("shard", "path", (F.col("base") + F.col("inside")).alias("before"))


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files that ``write_files`` lists."""
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile.of(get(path))
                doc_ids, lengths = file.documents()
                ids = file.all().astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                null = pa.array(np.arange(len(doc_ids)) < file.nulls)
                yield pa.RecordBatch.from_arrays(
                    [pa.compute.if_else(null, pa.scalar(None, pa.int64()), pa.array(doc_ids)), pa.array(before + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, files.count())
    return starts(files).select("path", "before").repartition(min(n, 4096)).mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "ids")))
