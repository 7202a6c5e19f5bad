"""Suffix-array dedup: remove every byte that a string of LENGTH bytes covers which also starts earlier in the corpus.

Suffix arrays are built by linear grouping. Phase 1 starts with suffixes grouped by first letter and takes the groups from
the highest down: a group's members share their Lyndon prefix u, each points to the nearest earlier suffix of a lower
group (previous smaller), and the suffixes pointed to, whose Lyndon prefixes grow by u, move to a new group just above their old
one, the more members point at one the higher. Phase 2 goes through the array from the lowest suffix up and emits, for each
suffix s, s-1 and its chain of previous smaller suffixes at the front of their groups. Nothing is renamed or recursed on.

Only text that can repeat is sorted. Every string of LENGTH bytes has one anchor, the leftmost least-hashed ANCHOR-byte string
in it; equal strings have equal anchors at equal places. So strings are dealt by anchor hash, anchors that occur once are left
out, starts whose bytes before or after the anchor no second member of the group has too, and each remaining group's distinct
stretches of text are sorted together; equal neighbours in its suffix array are the equal
strings, of which the one that starts first stays. Equal documents are set aside first: all of a later copy goes.
Groups over GROUP members are dealt out in parts; what is first in its part is compared across parts by a 128-bit
hash, aggregated per hash. Order is (doc_id, start); strings never cross documents.

Edge cases: null texts are empty; texts under LENGTH bytes lose nothing; overlaps count; rows that share doc_id and text
are one document and get equal rows, other rows with one doc_id are ordered by their text; a null doc_id is first; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, ShortType, StructField, StructType

from sonde.llm.common import documents, ship, staged, tidied

LENGTH, ANCHOR = 100, 32
#: Stretches sorted together at most; a larger anchor group is dealt out in parts.
GROUP = 256
#: Most ids that are broadcast as a filter of the texts; beyond, it is a shuffle join.
BROADCAST_IDS = 1_000_000


def suffix_array(text: bytes) -> list[int]:
    """The suffix array of ``text`` by linear grouping."""
    n = len(text)
    if n == 0:
        return []
    # the end marker at place n is the lowest suffix; groups are numbered by the slot their range starts at
    order = sorted(range(n), key=text.__getitem__)
    slots = [n, *order]  # places by group
    where = [0] * (n + 1)  # slot of each place
    start = [0] * (n + 1)  # slot where each place's group starts
    size = [0] * (n + 1)  # by group start
    size[0] = 1
    at = 1
    for k in range(1, n + 1):
        i = slots[k]
        where[i] = k
        if k > 1 and text[i] != text[slots[k - 1]]:
            at = k
        start[i] = at
        size[at] += 1
    before = [-2] * (n + 1)  # previous smaller; -1: none, -2: not known yet
    low = n + 1
    while low > 1:
        low = start[slots[low - 1]]  # the highest group not taken yet is the one that ends below the last
        members = slots[low : low + size[low]]
        hits: dict[int, int] = {}
        for i in sorted(members):
            j = i - 1
            while j >= 0 and start[j] >= low:
                j = before[j] if before[j] != -2 else j - 1
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, c in hits.items():
            by_count.setdefault(c, []).append(j)
        for c in sorted(by_count, reverse=True):  # those with the most go highest, so they move first
            moved: dict[int, int] = {}
            for j in by_count[c]:
                g = start[j]
                last = g + size[g] - 1
                if g not in moved:
                    moved[g] = 0
                other, k = slots[last - moved[g]], where[j]
                to = last - moved[g]
                slots[to], slots[k] = j, other
                where[j], where[other] = to, k
                moved[g] += 1
            for g, m in moved.items():
                new = g + size[g] - m
                if m < size[g]:
                    size[g] -= m
                    size[new] = m
                    for k in range(new, new + m):
                        start[slots[k]] = new
    out = [-1] * (n + 1)
    out[0] = n
    free = list(range(n + 2))  # next slot to fill, by group start
    placed = bytearray(n + 1)
    placed[n] = 1
    for k in range(n + 1):
        s = out[k] - 1
        while s >= 0 and not placed[s]:
            g = start[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = before[s]
    return out[1:]


def repeats(stretches: list[tuple[bytes, int]]) -> list[bytearray]:
    """For stretches (bytes, number of strings that start in it) in corpus order: by offset, 1 where an equal string starts earlier."""
    joined = b"\0".join(s for s, _ in stretches)
    valid, again = bytearray(len(joined)), bytearray(len(joined))
    base = []
    for s, n in stretches:
        at = base[-1][1] if base else 0
        valid[at : at + n] = b"\1" * n
        base.append((at, at + len(s) + 1))
    first, last = -1, None
    for i in suffix_array(joined):
        if valid[i]:
            here = joined[i : i + LENGTH]
            if here == last:  # a neighbour in the suffix array: the later of the two goes
                again[max(i, first)] = 1
                first = min(i, first)
            else:
                first, last = i, here
    return [again[at : at + n] for (at, _), (_, n) in zip(base, stretches, strict=True)]


def shared(sides: list[bytes]) -> list[int]:
    """By string, the length of the longest prefix that it has in common with another one of the list."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for a, b in pairwise(order):  # the longest is had with a neighbour in the sorted order
        x, y = sides[a], sides[b]
        n = min(len(x), len(y))
        differ = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
        n -= (differ.bit_length() + 7) // 8
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


def narrowed(group: list[tuple]) -> list[tuple]:
    """The group without the starts of strings that cannot repeat in it.

    Equal strings have their anchor at one place, so a string repeats only if some member has its bytes before the anchor
    and some member its bytes after it.
    """
    before = shared([g[3][: g[5]][::-1] for g in group])
    after = shared([g[3][g[5] + ANCHOR :] for g in group])
    out = []
    for (doc, first, parts, data, n, at), left, right in zip(group, before, after, strict=True):
        a, b = max(0, at - left), min(n, at + right - (LENGTH - ANCHOR) + 1)
        if a < b:
            out.append((doc, first + a, parts, data[a : b - 1 + LENGTH], b - a, at - a))
    return out


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last start of the strings of LENGTH bytes that have it, and place of each anchor of a text."""
    n = len(text)
    if n < LENGTH:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    h = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    size, power = 1, 0x9E3779B97F4A7C15
    while size < ANCHOR:
        h = h[:-size] * np.uint64(power) + h[size:]
        power = power * power % (1 << 64)
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    value, place = h, np.arange(len(h))
    size, whole = 1, LENGTH - ANCHOR + 1
    while size < whole:
        step = min(size, whole - size)
        left = value[:-step] <= value[step:]
        value = np.where(left, value[:-step], value[step:])
        place = np.where(left, place[:-step], place[step:])
        size += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return value[first].view(np.int64), first, last, place[first]


def filtered(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with these row numbers."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi")


def repeated(docs: DataFrame) -> DataFrame:
    """doc, spans: the (start, end) stretches to remove from each text of ``docs`` (doc: struct that orders them; text)."""
    ship(docs.sparkSession)
    key = docs.schema["doc"].dataType

    def find(batches):
        for b in batches:
            take, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found.append(anchors(t.encode()))
                take.append(np.full(len(found[-1][0]), i))
            if take:
                where = np.concatenate(take).astype(np.int64)
                h, lo, hi, place = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(where)), pa.array(h), pa.array(lo.astype(np.int32)), pa.array((hi - lo + 1).astype(np.int16)), pa.array((place - lo).astype(np.int16))], ["doc", "h", "first", "n", "at"])

    long_texts = docs.where(F.octet_length("text") >= LENGTH)
    schema = StructType([StructField("doc", key), StructField("h", LongType()), StructField("first", IntegerType()), StructField("n", ShortType()), StructField("at", ShortType())])
    found = staged(long_texts.select("doc", "text").mapInArrow(tidied(find), schema), "anchors")
    often = found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    parts = F.ceil(F.col("c") / GROUP).cast("int")
    flagged = found.join(often, "h").groupBy("doc").agg(F.collect_list(F.struct("h", "first", "n", "at", parts.alias("parts"))).alias("at"))
    flagged = staged(flagged, "flagged")

    def cut(batches):
        kinds = {"h": pa.int64(), "part": pa.int32(), "parts": pa.int32(), "first": pa.int32(), "n": pa.int32(), "at": pa.int32(), "bytes": pa.binary()}
        for b in batches:
            take, out = [], {k: [] for k in kinds}
            lists = b.column(2)
            sizes, flat = lists.value_lengths().to_pylist(), lists.flatten()
            rows = zip(*(flat.field(k).to_pylist() for k in ("h", "first", "n", "at", "parts")), strict=True)
            for i, (t, size) in enumerate(zip(b.column(1).to_pylist(), sizes, strict=True)):
                data = t.encode()
                for h, first, n, at, parts in islice(rows, size):
                    take.append(i)
                    stretch = data[first : first + n - 1 + LENGTH]
                    part = xxhash.xxh32_intdigest(stretch + first.to_bytes(8, "little")) % parts if parts > 1 else 0
                    for k, v in zip(kinds, (h, part, parts, first, n, at, stretch), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *[pa.array(out[k], t) for k, t in kinds.items()]], ["doc", *kinds])

    texts = filtered(long_texts.select("doc", "text"), flagged.select("doc")).join(flagged, "doc")
    whole = IntegerType()
    schema = StructType([StructField("doc", key), StructField("h", LongType()), *[StructField(k, whole) for k in ("part", "parts", "first", "n", "at")], StructField("bytes", BinaryType())])
    stretches = texts.select("doc", "text", "at").mapInArrow(tidied(cut), schema)

    def match(batches):
        held, at = [], None
        kinds = {"start": pa.int32(), "end": pa.int32(), "hi": pa.int64(), "lo": pa.int64()}

        def close(group):
            if group[0][2] == 1:  # a whole group: only what can repeat in it
                group = narrowed(group)
            distinct: dict[bytes, int] = {}
            own = []  # equal stretches are sorted once; all of the later ones goes
            for g in group:
                if g[3] in distinct:
                    yield g[0], g[1], g[1] + g[4] - 1 + LENGTH, None, None
                else:
                    distinct[g[3]] = 1
                    own.append(g)
            if len(own) < 2 and (not group or group[0][2] == 1):
                return
            for (doc, first, parts, data, n, _), marks in zip(own, repeats([(g[3], g[4]) for g in own]), strict=True):
                begin = None
                for k, again in enumerate(marks):
                    if again:
                        begin = k if begin is None else begin
                    else:
                        if begin is not None:
                            yield doc, first + begin, first + k - 1 + LENGTH, None, None
                            begin = None
                        if parts > 1:
                            d = np.frombuffer(xxhash.xxh3_128_digest(data[k : k + LENGTH]), "<i8")
                            yield doc, first + k, first + k + LENGTH, int(d[0]), int(d[1])
                if begin is not None:
                    yield doc, first + begin, first + n - 1 + LENGTH, None, None

        def pack(rows, kind):
            doc = pa.StructArray.from_arrays([pa.array([r[0][i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))
            return pa.RecordBatch.from_arrays([doc, *[pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(kinds.values())]], ["doc", *kinds])

        kind, rows = None, []
        for b in batches:
            kind = b.schema.field("doc").type
            docs_of = zip(*(f.to_pylist() for f in b.column("doc").flatten()), strict=True)
            for doc, h, part, first, parts, n, data, place in zip(docs_of, *(b.column(c).to_pylist() for c in ("h", "part", "first", "parts", "n", "bytes", "at")), strict=True):
                if at != (h, part):
                    if held:
                        rows += close(held)
                    held, at = [], (h, part)
                held.append((doc, first, parts, data, n, place))
            if len(rows) > 10_000:
                yield pack(rows, kind)
                rows = []
        if held:
            rows += close(held)
        if rows:
            yield pack(rows, kind)

    schema = StructType([StructField("doc", key), StructField("start", whole), StructField("end", whole), StructField("hi", LongType()), StructField("lo", LongType())])
    dealt = stretches.repartition("h", "part").sortWithinPartitions("h", "part", "doc", "first")
    spans = staged(dealt.mapInArrow(tidied(match), schema), "spans")

    # across the parts of large groups: the first of each string stays
    open_rows = spans.where("hi is not null")
    first = open_rows.groupBy("hi", "lo").agg(F.min(F.struct("doc", "start")).alias("m"), F.count("*").alias("c")).where("c > 1")
    late = open_rows.join(first, ["hi", "lo"]).where(F.struct("doc", "start") > F.col("m")).select("doc", "start", "end")
    every = spans.where("hi is null").select("doc", "start", "end").unionByName(late)
    return every.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    whole = F.sha2(F.encode("text", "UTF-8"), 256)
    # rows of one doc_id are told apart by the first 60 bits of their text's digest
    tag = F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("tag")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", whole).withColumn("doc", F.struct("doc_id", tag))
    marks = staged(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes"), F.col("doc").alias("me")), "marks")
    first = marks.groupBy("sha").agg(F.min("me").alias("doc"))
    keys = staged(marks.join(first, "sha").select("doc_id", "sha", "n_bytes", "me", "doc"), "keys")
    originals = rows.select("doc", "text")
    copies = keys.where("not (me <=> doc)").select(F.col("me").alias("doc")).distinct()
    copies = staged(copies, "copies")
    kept = originals.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc", "left_anti")
    twice = staged(marks.groupBy(F.col("me").alias("doc")).agg(F.count("*").alias("c")).where("c > 1").select("doc"), "twice")
    if twice.head(1):
        again = kept.join(twice, "doc", "left_semi").dropDuplicates(["doc"])
        kept = kept.join(twice, "doc", "left_anti").unionByName(again)
    spans = staged(repeated(kept), "removals")
    ids = spans.select("doc")

    def remove(batches):
        for b in batches:
            n, k, sha = [], [], []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data, at, left = t.encode(), 0, hashlib.sha256()
                runs = merged([(x["start"], x["end"]) for x in found])
                for a, e in runs:
                    left.update(data[at:a])
                    at = e
                left.update(data[at:])
                n.append(sum(e - a for a, e in runs)), k.append(len(runs)), sha.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string())], ["doc", "n_removed", "n_spans", "kept_sha256"])

    schema = spans.select("doc").withColumns({"n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept_sha256": F.lit("")}).schema
    cut = filtered(kept, ids).join(spans, "doc").select("doc", "text", "spans").mapInArrow(tidied(remove), schema).dropDuplicates(["doc"])
    out = keys.join(cut.withColumnRenamed("doc", "me"), "me", "left")
    copy = ~F.col("me").eqNullSafe(F.col("doc")) & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
