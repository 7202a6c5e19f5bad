"""The training-data operators against brute force, on rows with nulls, empties, ties, repeats, long texts and clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from sonde.llm import bpe, chat, components, decontaminate, neardup, quality, search, secrets, substrings, token_file, unigram  # noqa: E402

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 6))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    base = [prose(RNG.randint(1, 120)) for _ in range(40)]
    passage = prose(60)
    for i in range(12):  # near copies, copies, shared passages, repeats inside a text
        w = base[i].split()
        w[RNG.randrange(len(w))] = "changed"
        base.append(" ".join(w))
        base.append(base[i])
        base.append(prose(5) + " " + passage + " " + prose(7))
    base += ["", " \t\n", "one", "Été à la plage — ça va? 漢字 <|endoftext|>", passage + " " + passage, "x" * 3000, prose(4000), "a\x1cb  c", "THE THE the The the THE"]
    rows = [(i, t) for i, t in enumerate(base)]
    return rows + [(len(rows), None), rows[3], rows[3]]


ROWS = corpus()
SCHEMA = "doc_id long, text string, h long, key string, component long, n int, first string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, "f", None, None) for i, t in ROWS], SCHEMA).repartition(3)


def texts():
    return {i: t or "" for i, t in ROWS}


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("run", [
    lambda d: bpe.encode_documents(d, public_tokenizers.path("word_bpe_49k.json")), substrings.remove_repeats, lambda d: secrets.scan(d, secrets.Scanner(secrets.Forest([]))), lambda d: secrets.redact(d, secrets.Scanner(secrets.Forest([]))),
    lambda d: unigram.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")), lambda d: neardup.near_duplicates(d, 80), lambda d: neardup.keep_first(d, 80), lambda d: search.top_k(d, d),
])
def test_empty_tables(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_bpe_is_the_librarys(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    got = rows_of(bpe.encode_documents(docs, path, with_ids=True))
    assert len(got) == len(texts())
    for i, t in texts().items():
        ids = tool.encode(t, add_special_tokens=False).ids
        decoded = tool.decode(ids, skip_special_tokens=False)
        assert list(got[i].ids) == ids and got[i].decoded == decoded and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_merge_automaton_against_plain_merging():
    rng = random.Random(4)
    for _ in range(40):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(12):
            a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
            if a + b not in vocab and len(a + b) < 9:
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        machine = bpe.MergeAutomaton(vocab, merges)
        order = {m: k for k, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
            parts = list(word)
            while True:
                k, i = min(((order[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in order), default=(None, 0))
                if k is None:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert [machine.labels[t] for t in machine.encode(word)] == parts


def test_suffix_array():
    rng = random.Random(9)
    for _ in range(500):
        t = bytes(rng.choice(b"ab\0c"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 50)))
        assert substrings.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_narrowed_keeps_every_string_that_repeats_and_drops_what_cannot():
    rng, size = random.Random(5), substrings.LENGTH - substrings.ANCHOR
    for _ in range(200):
        sides = [bytes(rng.choice(b"ab") for _ in range(2 * size)) for _ in range(2)]
        group = []
        for doc in range(rng.randint(2, 5)):
            left, right = (bytearray(rng.choice(sides)[:size]) for _ in range(2))
            for side in (left, right):
                for _ in range(rng.randint(0, 2)):
                    side[rng.randrange(size)] = 99
            lead = rng.randint(0, size)  # bytes kept before and after the anchor: the stretch holds all their windows
            tail = rng.randint(size - lead, size)
            data = bytes(left[size - lead :]) + b"x" * substrings.ANCHOR + bytes(right[:tail])
            group.append(((doc, 0), 7, 1, data, len(data) - substrings.LENGTH + 1, lead))
        windows = lambda rows: [(doc, first + k, d[k : k + substrings.LENGTH]) for doc, first, _, d, n, _ in rows for k in range(n)]
        before, after = windows(group), windows(substrings.narrowed(group))
        assert set(after) <= set(before)
        seen = Counter(w for _, _, w in before)
        assert {x for x in before if seen[x[2]] > 1} <= set(after)
        if len(group) == 2:  # with one partner, nothing else is left
            assert all(seen[w] > 1 for _, _, w in after)
    assert substrings.shared([b"abc", b"abd", b"", b"abc"]) == [3, 2, 0, 3]


def test_substrings_against_brute_force(docs, monkeypatch):
    for group in (256, 3):  # 3: groups are dealt out in parts
        monkeypatch.setattr(substrings, "GROUP", group)
        got = rows_of(substrings.remove_repeats(docs))
        seen = set()
        for i, t in sorted(texts().items()):
            data = t.encode()
            gone = bytearray(len(data))
            for p in range(len(data) - 99):
                w = data[p : p + 100]
                if w in seen:
                    gone[p : p + 100] = b"\1" * 100
                seen.add(w)
            kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
            runs = sum(1 for p in range(len(gone)) if gone[p] and (not p or not gone[p - 1]))
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()), i


def test_substrings_without_doc_id_and_with_one_id_for_two_texts(spark):
    shared, other = "s" * 60 + prose(30, random.Random(1)), prose(40, random.Random(2))
    rows = [(None, shared), (5, other), (5, shared + "!"), (7, shared), (7, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(df).collect()), key=str)
    n = len(shared.encode())
    # no doc_id comes first and keeps its text; of the two with id 5 one has it again; both rows of 7 lose all
    assert got == sorted([(None, n, 0, 0), (5, len(other.encode()), 0, 0), (5, n + 1, n, 1), (7, n, n, 1), (7, n, n, 1)], key=str)


def shingle_sets():
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in texts().items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_brute_force(docs, percent):
    got = rows_of(neardup.near_duplicates(docs, percent))
    sets = shingle_sets()
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((of[a], of[b]))
                of = {k: x if v == y else v for k, v in of.items()}
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), of[i], of[i] == i)
    kept = neardup.keep_first(docs, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in of if of[i] == i}


@pytest.mark.parametrize(("chunk", "shingles"), [(1024, 10**9), (7, 10**9), (1024, 900)])
def test_near_duplicates_between_parted_components(spark, monkeypatch, chunk, shingles):
    """A chain of near copies whose ends are unlike, and unlinked neighbours in one cluster."""
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", shingles)
    rng = random.Random(2)
    w = [rng.choice(WORDS) + str(i) for i in range(200)]
    rows = []
    for i in range(30):
        w = w.copy()
        w[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    for i in range(30, 60):
        v = w.copy()
        for _ in range(9):
            v[rng.randrange(200)] = f"other{i}{rng.random()}"
        rows.append((i, " ".join(v)))
    got = rows_of(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((of[a], of[b]))
                of = {k: x if v == y else v for k, v in of.items()}
    assert {i: got[i].component_id for i in of} == of


def test_blocks_hold_each_pair_of_components_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 4)
    rng = random.Random(1)
    rows = [(c, (i if i % 3 else 3) + 100 * c if i < 18 else 100 * c, 1000 * c + i, rng.randint(1, 9)) for c in range(3) for i in range(30 * c + 2)]
    blocks = {}
    for r in neardup.chunked(spark.createDataFrame(rows, "cluster long, component long, rep long, n int")).collect():
        blocks.setdefault((r.cluster, r.i, r.j), []).append((r.rep, r.component, r.side))
    met = Counter()
    for (_, i, j), sets in blocks.items():
        met.update((a, b) for a, x, s in sets for b, y, t in sets if a < b and x != y and (i == j or s != t))
    assert met == {(a, b): 1 for c, x, a, _ in rows for d, y, b, _ in rows if c == d and a < b and x != y}


def test_near_duplicates_without_doc_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(3, text), (None, text), (None, "alone here"), (4, text + " more")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df, 80).collect()), key=str)
    assert got == [(3, 3, True), (4, 3, False), (None, 3, False), (None, None, False)]
    assert sorted((r.doc_id or 0) for r in neardup.keep_first(df, 80).collect()) == [0, 0, 3]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    of = {x: x for e in edges for x in e}
    for _ in of:
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    assert got == {k: v for k, v in of.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_token_files(docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    extra = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("no id"))
    files = token_file.write_files(docs.unionByName(extra), path, f"file://{tmp_path}/ids", shard_bytes=20_000, file_ids=2000)
    got = sorted(token_file.read_files(files).collect(), key=lambda r: r.start)
    want = sorted([(-1, "no id"), *((i, t or "") for i, t in ROWS)])
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.array(tool.encode(t, add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (None if i < 0 else i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert files.count() > 4
    none = token_file.write_files(docs.limit(0), path, f"file://{tmp_path}/none")
    assert none.count() == 0 and token_file.read_files(none).count() == 0


def test_chunks_are_encoded_as_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool, rng = Tokenizer.from_file(path), random.Random(7)
    parts = ["word", "Été", "don't", "it's,", "x.", "(y)", "3.14", "a\tb", "a\n\nb", "漢字", "é́", "ﬁ", "\x1c", "<|endoftext|>", "", "a_b", "ª.", "--", "\u00a0", "l'été;", "2nd", "Ⅳ"]
    texts = [rng.choice(("", " ", "\n")) + " ".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) + rng.choice(("", " ", "\n")) for _ in range(600)]
    enc = token_file.Encoder(path)
    for t in texts:
        assert enc.encode(t) == np.array(tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (1500, 9), (3000, 70_000), (200_000, 500)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        data, taken = token_file.to_bytes(np.array([1]), np.array([n]), ids), []
        assert (token_file.TokenFile.of(data).all() == ids).all()

        def read(at, size, data=data, taken=taken):
            taken.append(size)
            return data[at : at + size]

        file = token_file.TokenFile(read)
        if n == 200_000:  # one token: a block a plane for the bit, and no more of the file
            file.access(n // 2)
            assert sum(taken) < len(data) / 2
        for i in rng.integers(0, n, 30) if n else ():
            assert file.access(int(i)) == ids[i]
        for token in [*ids[:5].tolist(), top - 1, top + 70_000]:
            places = np.flatnonzero(ids == token)
            assert file.count(token) == len(places) and file.count(token, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
            some = [*range(min(3, len(places))), *range(max(0, len(places) - 2), len(places))]
            assert [file.find(token, k) for k in some] == [int(places[k]) for k in some] and file.find(token, len(places)) == -1
    doc_ids, lengths = token_file.TokenFile.of(token_file.to_bytes(np.array([0, 7]), np.array([2, 1]), np.array([5, 6, 5]), 1)).documents()
    assert doc_ids.tolist() == [0, 7] and lengths.tolist() == [2, 1]


def test_unigram_counts(docs):
    scores = unigram.zipf_scores(["▁a", "b", "ab", "▁ab", "c", "▁", "abc", "a"])
    trie = unigram.PieceTrie(scores)

    def best(word, i=0):
        if i == len(word):
            return 0.0, 0
        size = 0 if word[i] in scores else len(word[i].encode())
        s, n = best(word, i + 1) if size else (None, 0)
        options = [(s + size * unigram.BYTE_SCORE, -(n + size))] if size else []
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in scores:
                s, n = best(word, j)
                options.append((s + scores[word[i:j]], -(n + 1)))
        s, n = max(options)
        return s, -n

    rng = random.Random(6)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(200)}
    trie.prepare([" ".join(words)])
    for w in words:
        assert trie.count(w) == best("▁" + w)[1]
    got = rows_of(unigram.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")))
    assert all((got[i].n_tokens == 0) == (not t.split()) and got[i].n_words == len(t.split()) for i, t in texts().items())


def test_unigram_counts_of_documents(docs):
    """Whole texts with the real vocabulary, against a plain best path for each word."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = unigram.piece_trie(path).scores
    longest = max(map(len, scores))

    def pieces(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            options = [] if word[i - 1] in scores else [(best[i - 1][0] + size * unigram.BYTE_SCORE, -(-best[i - 1][1] + size))]
            options += [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(max(0, i - longest), i) if word[j:i] in scores]
            best.append(max(options))
        return -best[-1][1]

    count = {w: pieces("▁" + w) for t in texts().values() for w in set(t.split()) if len(w) < 200}
    got = rows_of(unigram.count_tokens(docs, path))
    checked = 0
    for i, t in texts().items():
        if all(w in count for w in t.split()):
            assert got[i].n_tokens == sum(count[w] for w in t.split())
            checked += 1
    assert checked >= len(texts()) - 1


def test_the_fit_is_a_maximum():
    """No change of a weight or a threshold makes the fitted data, with its penalty, likelier."""
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(8) < 0.4) for _ in range(400)]
    z = np.array([0.9 * (0 in r) - 1.1 * (1 in r) + 0.5 * (2 in r) for r in rows]) + rng.logistic(size=400)
    grades = np.digitize(z, [-0.5, 0.8])
    model = quality.CumulativeLink.fit(rows, grades, 3, least=1, steps=3000, rate=0.02, clear_by=0)

    def cost(weights, thresholds):
        theta = np.concatenate([[-np.inf], thresholds, [np.inf]])
        s = np.array([weights[r].sum() for r in rows])
        p = quality.sigmoid(theta[grades + 1] - s) - quality.sigmoid(theta[grades] - s)
        return -np.log(p).mean() + 1e-4 / 2 * (weights**2).sum()

    weights, thresholds = model.weights[:8].astype(float), model.thresholds
    at = cost(weights, thresholds)
    for k in range(8):
        for step in (0.05, -0.05):
            assert cost(weights + step * np.eye(8)[k], thresholds) > at - 1e-6
    for k in range(2):
        for step in (0.05, -0.05):
            assert cost(weights, thresholds + step * np.eye(2)[k]) > at - 1e-6
    assert abs(weights[0] - 0.9) < 0.5 and abs(weights[1] + 1.1) < 0.5


def test_quality_takes_whole_texts_and_fits_the_same_on_ties(spark):
    """The last word of a very long text counts; which of the rows on the sample's border are fitted on is fixed."""
    rng = random.Random(5)
    rows = [(i, " ".join([*(rng.choice(WORDS) for _ in range(20)), "vile" if i % 2 else "kind"])) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, prose(30_000) + " vile"), (901, prose(30_000) + " kind")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i, _ in rows] + [(i, 1 - i % 2, i % 2) for i, _ in rows[:50]], "doc_id long, quality int, toxic int")
    model, again = quality.fit(docs, labels, 120), quality.fit(docs.repartition(5), labels.repartition(3), 120)
    assert np.array_equal(model.weights, again.weights) and np.array_equal(model.thresholds, again.thresholds)
    got = rows_of(quality.score(docs, model, tail=0.5))
    assert not got[900].keep and got[901].keep
    tail = got[901].p_top
    assert rows_of(quality.score(docs, model, tail=tail))[901].keep  # on the cut: kept


def test_quality(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        kind = rng.choice((0, 1, 2))
        words = [rng.choice(WORDS) for _ in range(40)]
        if kind == 0:
            words[rng.randrange(40)] = "vile"
        text = " ".join(w + "%%%" if kind == 1 else w for w in words)
        rows.append((i, text, "s", 1))
        labels.append((i, int(kind == 2), int(kind == 0)))
    labels += [(None, 1, 0), (3, None, 0), (5, 1, None)]
    docs = spark.createDataFrame([*rows, (1000, None, None, None), (1001, "", "s", 0)], "doc_id long, text string, keep string, grade int")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, given.where("doc_id < 250 or doc_id is null"), 300)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = rows_of(quality.score(docs, model))
    held = [(got[i].keep, q == 1) for i, q, t in labels[250:400]]
    assert sum(a == b for a, b in held) / len(held) > 0.95 and len(got) == 402
    assert all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())
    kept = quality.select(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}
    plain = quality.fit(docs, given.limit(0))
    assert quality.select(docs, plain).count() == docs.count()
    assert quality.score(docs.limit(0), model).count() == 0


def test_secrets(docs, spark):
    model = secrets.scanner()
    words = secrets.dictionary(None)
    held = secrets.labelled_findings(1000, 123, words)
    p = model.forest.predict(np.array([secrets.describe(*f[:4], words) for f in held]))
    assert ((p >= 0.5) == np.array([f[4] for f in held])).mean() > 0.97
    key = hashlib.sha1(b"x").hexdigest()
    rows = [(0, f'here token = "{key}" is', "a", 5), (1, f"commit {key} was", None, None), (2, None, None, 0), (3, "plain words only", "b", 1), (4, f'token = "{key}" token = "{key[::-1]}"', "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = rows_of(secrets.scan(df, model))
    assert {i: r.n_secrets for i, r in got.items()} == {0: 1, 1: 0, 2: 0, 3: 0, 4: 2}
    text = {r.doc_id: r for r in secrets.redact(df, model).collect()}
    assert text[0].text == 'here token = "[SECRET]" is' and text[0].n_chars == len(text[0].text) and text[1].text == rows[1][1] and text[2].text is None
    assert text[4].text == 'token = "[SECRET]" token = "[SECRET]"'
    assert secrets.redact(docs, model).columns == docs.columns


def test_trees_split_where_it_is_best():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 30, (80, 1)).astype(float)
    y = ((x[:, 0] > 11) ^ (rng.random(80) < 0.2)).astype(float)
    feature, cut, left, right, share = secrets.Forest.fit(x, y, trees=1, depth=1, seed=3).trees[0]
    rows = np.random.default_rng(3).integers(0, 80, 80)
    v, t = x[rows, 0], y[rows]
    gini = lambda part: len(part) * part.mean() * (1 - part.mean()) if len(part) else 0
    cost = {c: gini(t[v <= c]) + gini(t[v > c]) for c in np.unique(v)[:-1]}
    assert feature[0] == 0 and cost[max(c for c in cost if c <= cut[0])] == pytest.approx(min(cost.values()))
    assert share[left[0]] == pytest.approx(t[v <= cut[0]].mean()) and share[right[0]] == pytest.approx(t[v > cut[0]].mean())


def test_secrets_of_documents(spark, sf):
    """On the given documents: every planted token is found, and what is kept is such a token."""
    rows = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/documents.parquet").select("doc_id", "text", "source")
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    planted = {(i, m.start(1), m.end(1)) for i, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    found = {(r.doc_id, s.start, s.end) for r in secrets.scan(rows, secrets.scanner()).collect() for s in r.spans}
    assert len(planted) > 5 and planted <= found
    assert len(planted) >= 0.9 * len(found)


def test_redacting_long_and_odd_texts(spark):
    key = hashlib.sha1(b"y").hexdigest()
    long = prose(20_000) + f' token = "{key}" ' + prose(20_000)
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, None, None), (2, "", None), (3, f'"{key}', "y")], "doc_id long, text string, spans string")
    got = [r.text for r in secrets.redact(df, secrets.scanner()).orderBy("doc_id").collect()]
    want = long.replace(key, secrets.MASK)
    assert got[0] is None and got[1:3] == [want, want] and got[3] == ""


def test_features_are_of_the_whole_candidate():
    words = secrets.dictionary(None)
    run = "a" * 600 + "9F8E7D6C" * 30 + ".py"
    got = dict(zip(secrets.NAMES, secrets.describe(run, 0, len(run), "", words), strict=True))
    assert got["digits"] == pytest.approx(120 / len(run)) and got["capitals"] == pytest.approx(120 / len(run)) and got["path"] == 1 and got["hex"] == 0


def test_secrets_end_to_end():
    model, words = secrets.scanner(), secrets.dictionary(None)
    found = lambda t, s="": [t[a:b] for a, b, p in model.scan([t], [s])[0] if p >= 0.5]
    for value in ("hunter2abc", "P@ssw0rd!2024", "QwErTyUiOpAsDfGhJkLz", "aB3!" * 20):
        for lead, end in (("password = ", ""), ("see password: ", " there"), ('token = "', '" is'), ("a/b/token=", "")):
            assert found(lead + value + end) == [value], lead + value
    assert found("/".join(["alpha", "beta", "gamma"] * 60) + "/key=9f8Ae7Xq2LmZ0pR5tYwK") == ["9f8Ae7Xq2LmZ0pR5tYwK"]
    assert not found("password: required") and not found("token: something") and not found("the key is internationalization")
    held = secrets.labelled_findings(1000, 123, words)
    hit = [any(x <= a and y >= b and p >= 0.5 for x, y, p in model.scan([t], [s])[0]) for t, a, b, s, label in held if label]
    assert sum(hit) > 0.97 * len(hit)


def test_decontamination_scores_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, prose(30 + k, rng)) for k in range(20)]
    rows = [(i, t) if i % 2 else (i, " ".join("odd" if k == 3 else w for k, w in enumerate(t.split()))) for i, t in items]
    df, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = []
    for block in (20_000, 7):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        got.append({(r.doc_id, r.item_id): r.score for r in decontaminate.matches(df, table).collect()})
    assert len(got[0]) == 20 and got[1] == {k: pytest.approx(v, abs=1e-9) for k, v in got[0].items()}


def test_decontamination_against_brute_force(docs, spark, monkeypatch):
    items = [(k, prose(25)) for k in range(60)] + [(60, "two words"), (61, ""), (62, None), (63, ROWS[5][1]), (63, ROWS[5][1])]
    rows = [(1000 + i, prose(80) + " " + items[i][1].upper() + ". " + prose(90)) for i in range(20)]
    half = [(1100 + i, prose(50) + " " + " ".join(items[i][1].split()[:12])) for i in range(20)]
    edited = [(1200 + i, " ".join(["odd" if k == 3 else w for k, w in enumerate(items[i][1].split())]) + " " + prose(30)) for i in range(20)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows + half + edited + [(2000, "so two words here it is"), (2001, "two words")], "doc_id long, text string"))
    table = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in {**texts(), **dict(rows + half + edited + [(2000, "so two words here it is"), (2001, "two words")])}.items():
        w = decontaminate.words_of(t)
        for k, x in items:
            item = decontaminate.Item(k, x or "")
            if item.words:
                n = min(5, len(item.words))
                if item.verify({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}):
                    want.add((d, k))
    for block in (20_000, 7):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
        got = decontaminate.matches(df, table).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        kept = decontaminate.clean(df, table)
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in df.collect()} - {d for d, _ in want}
    assert {1000 + i for i in range(20)} <= {d for d, _ in want} and not {1100 + i for i in range(20)} & {d for d, _ in want}
    assert decontaminate.matches(df, table.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), table).count() == 0


def test_decontamination_with_clashing_names_and_long_texts(spark):
    item = prose(40, random.Random(3))
    long = prose(20_000, random.Random(4)) + " " + item + " " + prose(20_000, random.Random(5))
    df = spark.createDataFrame([(1, long, 7, 0.5, 0.1), (1, long, 7, 0.5, 0.1), (None, item, 8, 0.5, 0.1), (2, prose(30, random.Random(6)), 9, 0.5, 0.1)], "doc_id long, text string, item_id long, score double, overlap double")
    items = spark.createDataFrame([(4, item, "x"), (None, item, "y")], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.matches(df, items).collect()), key=str)
    assert got == [(1, 4), (1, 4), (None, 4)]
    kept = decontaminate.clean(df, items)
    assert kept.columns == df.columns and [r.item_id for r in kept.collect()] == [9]


def test_wand_is_exact():
    rng = random.Random(1)
    index = decontaminate.BlockMaxIndex([(i, " ".join(rng.choice(WORDS[:80]) for _ in range(20))) for i in range(150)])
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.terms)), 40))
        dense = Counter()
        for t in terms:
            for i, v in zip(index.item[index.ptr[t] : index.ptr[t + 1]].tolist(), index.value[index.ptr[t] : index.ptr[t + 1]].tolist(), strict=True):
                dense[i] += v
        want = {i for i, s in dense.items() if s >= 1 - 1e-9}
        assert set(index.above(np.array(terms)).tolist()) == want == {i for i, _ in index.wand(terms, range(150))}


@pytest.mark.parametrize("head", [1024, 8])
def test_search_against_brute_force(docs, monkeypatch, head):
    """Repeated rows are documents of their own, rows without doc_id none; equal scores go by doc_id."""
    for name, value in (("SHARD", 16), ("BLOCK", 4), ("HEAD", head), ("QUERIES", 5), ("READ", 40), ("TASK_BLOCKS", 2)):
        monkeypatch.setattr(search, name, value)
    every = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    got = search.top_k(every, every.where("doc_id % 5 = 0 or doc_id is null"), 4).collect()
    rows = [(i, [w for c in (t or "").split() if (w := c.lower().strip(search.EDGE))]) for i, t in ROWS]
    df = Counter(w for _, x in rows for w in set(x))
    n, mean = len(rows), sum(len(x) for _, x in rows) / len(rows)
    for q in {i for i, _ in rows if i % 5 == 0}:
        asked = {w for i, x in rows if i == q for w in x}
        scores = []
        for d, x in rows:
            tf = Counter(x)
            s = sum(np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in asked if tf[w])
            if s:
                scores.append((-round(s, 6), d))
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(d, pytest.approx(-s, abs=2e-6)) for s, d in sorted(scores)[:4]] == [(d, s) for _, d, s in mine]
    assert {r["query_id"] for r in got} <= {i for i, _ in rows}


def test_groups_of_files_are_even(spark):
    files = spark.createDataFrame([(f"shard-{i}",) for i in range(32)], "path string")
    got = [r.paths for r in search.grouped(files, 2, "group", "paths").collect()]
    assert sorted(p for g in got for p in g) == sorted(f"shard-{i}" for i in range(32)) and {len(g) for g in got} == {2}


def test_bounds_hold_and_skip(monkeypatch):
    """No block of a document that belongs to the result is skipped, and some blocks are."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(search, "HEAD", 30)
    words = np.arange(1, 400)
    common = 1 / np.arange(1, 400)
    texts = [rng.choice(words, rng.integers(3, 60), p=common / common.sum()) * (1 + 400 * (i // 300)) for i in range(900)]
    data, names, _ = search.Shard.build(list(range(900)), texts)
    shard, weights = search.Shard(data, 30.0), rng.random(len(names)) + 0.1
    seen = []
    plain = search.Shard.score
    monkeypatch.setattr(search.Shard, "score", lambda self, take, *rest: (seen.append(take.sum()), plain(self, take, *rest))[1])
    asked = [np.unique(t) for t in texts[::9]]
    best = search.Best(len(asked), 5)
    shard.search(np.cumsum([0, *map(len, asked)]), np.concatenate(asked), weights[np.searchsorted(names, np.concatenate(asked))], best)
    for q, ws in enumerate(asked):
        at = np.searchsorted(names, ws)
        score = np.zeros(900)
        for a in at:
            place = slice(shard.ptr[a], shard.ptr[a + 1])
            score[shard.doc[place]] += weights[a] * shard.impact[place]
        score = np.round(score, search.DIGITS)
        order = np.lexsort((shard.doc_ids, -score))[:5]
        mine = best.query == q
        assert best.doc_id[mine].tolist() == shard.doc_ids[order][score[order] > 0].tolist() and np.allclose(best.score[mine], score[order][score[order] > 0], atol=2e-6)
    assert 0 < sum(seen) < 0.8 * len(asked) * shard.n_blocks


def test_chats(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST] &lt; &amp;#91;"), (1, 0, "user", None), (2, 0, "system", "s"), (2, 1, "user", "u\nv"), (2, 2, "assistant", "漢 <s>"), (2, 3, "assistant", "twice"),
        (3, 0, "to>ol<x", "t"), (3, None, None, "n"), (None, 0, "user", "?"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "assistant", ""),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, valid int")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for c in (1, 2, 3, 4, 5, None):
        mine = sorted(((-1 if t is None else t, role or "", text or "") for k, t, role, text in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [m[1:] for m in mine]
        assert got[c].loss_text == "".join(text for _, role, text in mine if role == "assistant")
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, None: True}
    assert chat.format_chats(df.limit(0)).count() == 0
    assert "Python" not in chat.format_chats(df)._jdf.queryExecution().toString()


def test_long_chats_and_a_conversation_of_the_probes_number(spark, tmp_path):
    long = "[INST] <s> & " * 40_000
    rows = [(-1, 0, "user", "first"), (-1, 1, "assistant", "second"), (9, 0, "user", long), (9, 1, "assistant", long)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    assert got[9].loss_chars == len(long) and got[9].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[-1].n_turns == 4 and not got[-1].valid  # the probe's turns join those that are there


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns named as the stages name their own; and no rows at all."""
    import corpus_pipeline

    rng = random.Random(12)
    good = [" ".join([*(rng.choice(WORDS) for _ in range(60)), "kind"]) for _ in range(120)]
    vile = [" ".join([*(rng.choice(WORDS) for _ in range(60)), "vile"]) for _ in range(120)]
    key = hashlib.sha1(b"z").hexdigest()
    rows = [(i, t, None, "s", len(t)) for i, t in enumerate(good + vile)]
    rows += [(500, good[7], "en", None, None), (501, None, "en", "s", None), (502, "", None, None, 0), (503, good[9] + f' token = "{key}" kind', "en", "s", 1), (504, "benchmark says " + good[11] + " kind", "en", "s", 1)]
    rows += [rows[3], rows[3], (None, good[5] + " kind other", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, component long, grade int, keep boolean, ids string"
    docs = spark.createDataFrame([(*r, "k", 1, 2, True, "i") for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/sf/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for d in ("sf", "none"):
        spark.createDataFrame([(i, int(i < 120), int(i >= 120)) for i in range(240)] + [(None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame([(1, good[11]), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/sf/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, f"{tmp_path}/sf")
        assert after.schema.names == docs.schema.names, name
        kept = after
    out = {r.doc_id: r.text for r in kept.collect()}
    assert not set(out) & set(range(120, 240)) and 500 not in out and 504 not in out and 11 not in out  # vile, a copy, the benchmark's
    assert set(range(120)) - {11} <= set(out) and None in out
    assert 503 not in out or key not in out[503]
    ids = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()
    assert {r.doc_id for r in ids} == set(out) and all(len(r.ids) == r.n_tokens for r in ids)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_and_pipeline(spark, sf):
    import __spark_entry__ as entry
    import corpus_pipeline

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.schema.names == docs.schema.names, name
        assert after.count() <= kept.count()
        kept = after
    out = corpus_pipeline.run(spark, sf).select("doc_id").collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert decontaminate.matches(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert kept.where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0


def test_search_groups_are_as_few_as_keep_the_cores_busy():
    """op9_top_k: only a group's first shard begins without thresholds."""
    for files, cores in ((1, 6), (6, 6), (32, 6), (49, 6), (1536, 6), (1536, 200), (5, 200)):
        size = search.group_size(files, cores)
        assert 1 <= size <= search.TASK_SHARDS
        groups = -(-files // size)
        assert groups >= min(files, cores) * 3 / 4
        assert size == search.TASK_SHARDS or groups <= cores * -(-files // (cores * search.TASK_SHARDS))
