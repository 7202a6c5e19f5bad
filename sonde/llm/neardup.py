"""MinHash near-duplicates with tensored banding.

A document is the set of its distinct five-word shingles (64-bit hashes). It gets two collections of COLLECTION keys, each key
made of WIDTH minhashes; table (i, j) has the pair of the i-th key of the first and the j-th of the second collection, so
COLLECTION**2 tables of 2*WIDTH minhashes cost 2*COLLECTION*WIDTH minhash computations. A pair of similarity s is missed
with chance at most 2*(1 - s**WIDTH)**COLLECTION: 4e-7 at 0.85, 1e-5 at 0.8.

Plan: equal sets are one class, of which the least doc_id goes on. Keys that no second class has are dropped
first, since no table can then join on them; the tables hold only what is left. In each table's bucket every class is
paired with the bucket's least one and verified on full sets; the verified links' components are found. Then links between
different components of classes that buckets connect, which are all that could still matter, are looked for among the pairs
of such a cluster that are in different components, in blocks of two chunks of sets that never list a pair, and the components
found again. Pairs within a component are not listed: they change nothing. Full sets are made again for classes in pairs only.
Nothing is collected to the driver; aggregates have map-side parts, rows of hot keys are dealt out.

Edge cases: a text with fewer words than five is one shingle, of all its words; null texts and texts without words have the
empty set and no links; equal texts are linked; repeated doc_ids share a set row each and one component; a row without doc_id gets
the component of the texts equal to its own, if there are any, links nothing and is not ``kept`` (``keep_first`` keeps it: it is
no other row's copy by id); very long texts are taken whole; empty tables give no rows; further columns are ignored
(``keep_first`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonde.llm.common import documents, ship, spread_join, staged, texts, tidied
from sonde.llm.components import components

SIZE = 5
COLLECTION, WIDTH = 12, 2
#: Most classes whose ids are broadcast as a filter of the second pass; beyond, it is a shuffle join.
BROADCAST_IDS = 1_000_000
#: Sets, and shingles, of one cluster that are compared with as many others at a time (one set may have more shingles).
CHUNK, CHUNK_SHINGLES = 256, 500_000
#: Entries of a worker's table of words; it is emptied when full.
CACHE = 200_000
_rng = np.random.default_rng(20240607)
ODD = _rng.integers(0, 1 << 63, 2 * COLLECTION * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
POWER = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(SIZE)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Hashes of words, kept per worker task."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def words(self, text: str) -> np.ndarray:
        """Hashes of the words; A-Z are lower-cased, words end at blanks and control blanks only (bytes split just so)."""
        words, cache = text.encode().lower().split(), self.cache
        got = list(map(cache.get, words))
        if None in got:
            if len(cache) > CACHE:
                cache.clear()
            for i, h in enumerate(got):
                if h is None:
                    got[i] = cache[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return np.fromiter(got, np.uint64, len(got))

    def set(self, text: str) -> np.ndarray:
        """The sorted shingle hashes of a text."""
        h = self.words(text)
        n = len(h)
        if not n:
            return h
        if n < SIZE:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
        s = h[SIZE - 1 :].copy()
        for k in range(1, SIZE):
            s += h[SIZE - 1 - k : n - k] * POWER[k]
        return np.unique(mixed(s))


def keys(shingles: np.ndarray) -> np.ndarray:
    """The 2*COLLECTION keys of a set."""
    low = np.full(len(ODD), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        np.minimum(low, (ODD[:, None] * shingles[None, at : at + 4096]).min(axis=1), out=low)
    low = mixed(low).reshape(-1, WIDTH)
    out = low[:, 0].copy()
    for k in range(1, WIDTH):
        out = mixed(out * POWER[1] + low[:, k])
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, hi, lo (a 128-bit hash of the set; null: empty), keys."""
    ship(docs.sparkSession)

    def run(batches):
        shingler = Shingler()
        for b in batches:
            n, hi, lo, rows = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingler.set(t)
                n.append(len(s))
                if len(s):
                    h = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                    hi.append(int(h[0])), lo.append(int(h[1])), rows.append(keys(s))
                else:
                    hi.append(None), lo.append(None), rows.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "hi", "lo", "keys"])

    rows = texts(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(tidied(run), "doc_id long, n_shingles long, hi long, lo long, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, shingles of the documents in ``wanted`` (rep, distinct)."""
    ids = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep", "left_semi")

    def run(batches):
        shingler = Shingler()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingler.set(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["rep", "shingles"])

    return rows.mapInArrow(tidied(run), "rep long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) with 100 * intersection >= percent * union."""
    one = lambda side: sets.select(F.col("rep").alias(side), F.col("shingles").alias(f"of_{side}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b") - both).alias("any"))
    return joined.where(F.lit(100) * F.col("both") >= F.lit(percent) * F.col("any")).select("a", "b")


def block_links(reps: list[int], components: list[int], sides: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components among these sets, as many as join them; of pairs with both sides set only, where there are two.

    Each set is counted against all others by the postings of its shingles: exact, and no pair takes memory or a row.
    """
    n = np.array([len(x) for x in sets])
    names, word = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    by = np.argsort(word, kind="stable")
    posting = owner[by]
    ptr = np.searchsorted(word[by], np.arange(len(names) + 1))
    start = np.concatenate([[0], np.cumsum(n)])
    side, group = np.array(sides), {c: c for c in components}
    two = side.any() and not side.all()

    def root(c: int) -> int:
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    out = []
    for x in range(len(sets)):
        if two and side[x]:
            continue
        mine = word[start[x] : start[x + 1]]
        size = ptr[mine + 1] - ptr[mine]
        both = np.bincount(posting[np.repeat(ptr[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())], minlength=len(sets))
        near = 100 * both >= percent * (n[x] + n - both)
        for y in np.flatnonzero(near & (side != side[x]) if two else near).tolist():
            a, b = root(components[x]), root(components[y])
            if a != b:
                group[max(a, b)] = min(a, b)
                out.append((min(reps[x], reps[y]), max(reps[x], reps[y])))
    return out


def chunked(placed: DataFrame) -> DataFrame:
    """cluster, i, j, rep, component, side: the sets (cluster, component, rep, n) in blocks of two chunks i <= j; side: it is in j.

    A component with a chunk or more to itself has chunks of its own, the others of its cluster share theirs. A block of two
    chunks of one component is left out: its links join nothing. So a large component meets only what is not in it.
    """
    size = placed.groupBy("cluster", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    large = (F.col("sets") >= CHUNK) | (F.col("shingles") >= CHUNK_SHINGLES)
    owned = size.withColumn("owner", F.when(large, F.struct("component")))
    count = F.ceil(F.greatest(F.sum("sets") / CHUNK, F.sum("shingles") / CHUNK_SHINGLES)).cast("int")
    chunks = owned.groupBy("cluster", "owner").agg(count.alias("chunks")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    chunks = chunks.withColumn("at", F.row_number().over(Window.partitionBy("cluster").orderBy("owner", "c")))
    mine = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    sets = placed.join(owned.select("cluster", "component", "owner"), ["cluster", "component"])
    first = chunks.where("c = 0").select("cluster", "owner", "chunks", F.col("at").alias("base"))
    sets = sets.alias("s").join(first.alias("f"), (F.col("s.cluster") == F.col("f.cluster")) & F.col("s.owner").eqNullSafe(F.col("f.owner")))
    sets = sets.select("s.cluster", "s.owner", "rep", "component", (F.col("base") + mine).alias("at"))
    other = chunks.select("cluster", F.col("owner").alias("other_owner"), F.col("at").alias("other"))
    pairs = sets.join(other, "cluster").where(F.col("owner").isNull() | ~F.col("owner").eqNullSafe(F.col("other_owner")))
    return pairs.select("cluster", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "rep", "component", (F.col("at") > F.col("other")).alias("side"))


def cluster_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of one cluster: all pairs that could join some are compared, in blocks of two chunks."""
    rows = chunked(placed)

    def run(batches):
        at, held = None, ([], [], [], [])

        def close():
            found = block_links(*held, percent) if len(set(held[1])) > 1 else []
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            shingles = b.column(6)
            ends, flat = np.cumsum([0, *shingles.value_lengths().to_pylist()]), shingles.flatten().to_numpy(zero_copy_only=False)
            for k, (c, i, j, rep, component, side) in enumerate(zip(*(b.column(x).to_pylist() for x in range(6)), strict=True)):
                if at is not None and at != (c, i, j):
                    yield close()
                at = (c, i, j)
                for x, v in zip(held, (rep, component, side, flat[ends[k] : ends[k + 1]]), strict=True):
                    x.append(v)
        if at is not None:
            yield close()

    dealt = rows.join(sets, "rep").select("cluster", "i", "j", "rep", "component", "side", "shingles").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep")
    return dealt.mapInArrow(tidied(run), "a long, b long")


def cluster(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of ``docs``."""
    sketch = staged(sketches(docs), "sketches")
    full = sketch.where("hi is not null and doc_id is not null")
    classes = staged(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("c")), "classes")

    # keys that two classes share, per collection; then the tables among those
    single = classes.select("rep", "n", F.posexplode("keys").alias("place", "key"))
    shared = single.groupBy("place", "key").agg(F.count("*").alias("c")).where("c > 1")
    alive = spread_join(single, shared, ["place", "key"], 2 * COLLECTION * classes.count(), ["rep"]).where("c is not null").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("keys"))
    first, second = F.filter("keys", lambda k: k["place"] < COLLECTION), F.filter("keys", lambda k: k["place"] >= COLLECTION)
    tables = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["place"], x["key"], y["place"], y["key"]))))
    rows = staged(alive.select("rep", "n", F.explode(tables).alias("key")), "tables")
    low = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("low"), F.count("*").alias("c")).where("c > 1")
    met = spread_join(rows, low, ["key"], rows.count(), ["rep"]).where("c is not null")
    members = staged(met.select("key", "rep", "n", F.col("low.rep").alias("first"), F.col("low.n").alias("first_n")), "members")

    near = lambda x, y: F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)  # noqa: E731  else sizes alone rule a pair out
    stars = staged(members.where(F.col("rep") > F.col("first")).where(near(F.col("n"), F.col("first_n"))).select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    sets = staged(full_sets(docs, members.select("rep").distinct()), "sets")
    links = staged(verified(stars, sets, percent), "links")
    found = components(links)

    # what star pairs left open: links between components of one cluster, i.e. of classes that buckets connect
    clusters = components(members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    placed = clusters.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parted = placed.groupBy("cluster").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("cluster")
    open_rows = staged(placed.join(parted, "cluster").join(sets.select("rep", F.size("shingles").alias("n")), "rep").select("rep", "cluster", "component", "n"), "open")
    more = staged(cluster_links(open_rows, sets, percent), "links")
    if more.head(1):
        found = components(links.unionByName(more))

    of_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("hi", "lo", "c", F.coalesce("component", "rep").alias("component"))
    return spread_join(sketch.select("doc_id", "n_shingles", "hi", "lo"), of_class, ["hi", "lo"], sketch.count(), ["doc_id"]).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    return cluster(docs, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The row with the least doc_id of each component of ``docs``, with its own columns; of rows that share it, all; and rows without doc_id."""
    gone = cluster(docs, percent).where("doc_id <> component_id").select("doc_id").distinct()
    gone = staged(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 85)
