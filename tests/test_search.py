"""Goldens, parity with SQL, plans and properties of the search engine."""

import json
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonde.functions import text as T
from sonde.functions.encode import HashingEncoder, encode, encode_embedded, encode_vectors
from sonde.functions.models import Activations, EmbeddedActivations, SineModel, TokenVectors, cosines, freeze
from sonde.functions.vectors import dot, max_sim
from sonde.operators import chars, dense, evaluate, lexical, losses, rank, scan, sparse
from sonde.operators.lexical import BM25, TfIdf
from sonde.plans.queries import QUERIES, SQL
from sonde.sources import corpora, staging, store

TINY = [(0, "Food"), (1, "Sports"), (2, "Cinema")]
ASKED = [(0, "Food"), (1, "Sports"), (2, "Cinema food sports"), (3, "cinema")]


def frames(spark, docs=TINY, asked=ASKED):
    return spark.createDataFrame(docs, "id long, document string"), spark.createDataFrame(asked, "query_id long, query string")


def results(df, key="id"):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r[key]] = r["similarity"]
    return out


def test_bm25_golden(spark):
    docs, asked = frames(spark)
    got = results(BM25("id", "document").add(docs).search(asked))
    assert got == {0: {0: pytest.approx(3)}, 1: {1: pytest.approx(9)}, 2: {0: pytest.approx(3), 1: pytest.approx(9), 2: pytest.approx(9)}, 3: {2: pytest.approx(9)}}


def test_bm25_two_batches(spark):
    docs, asked = frames(spark)
    more, _ = frames(spark, [(i + 3, t) for i, t in TINY])
    index = BM25("id", "document").add(docs).add(more)
    assert results(index.search(asked))[0] == {0: pytest.approx(3), 3: pytest.approx(3)}
    both = results(BM25("id", "document", norm="global").add(docs).add(more).search(asked))[0]
    assert both == {3: pytest.approx(2.432886, abs=1e-5), 0: pytest.approx(1.755296, abs=1e-5)} or both == {0: pytest.approx(2.432886, abs=1e-5), 3: pytest.approx(1.755296, abs=1e-5)}


def test_tfidf_finds_itself(spark):
    docs, asked = frames(spark)
    got = results(TfIdf("id", "document").add(docs).search(asked, 1))
    assert got[0] == {0: pytest.approx(1)} and got[1] == {1: pytest.approx(1)} and got[3] == {2: pytest.approx(1)}


def test_no_documents_no_vocabulary(spark):
    _, asked = frames(spark)
    for kind in (BM25, TfIdf):
        index = kind("id", "document")
        for call in (index.vocabulary, index.weights, lambda index=index: index.search(asked)):
            with pytest.raises(ValueError, match="add documents first"):
                call()


def test_accents_words_and_stop_words(spark):
    df = spark.createDataFrame([("Été  À la FORÊT e\u0301t ß ø",)], "t string")
    assert df.select(T.normalize(F.col("t"), strip_accents=True)).head()[0] == "ete a la foret et ß ø"
    docs, asked = frames(spark, [(0, "the food"), (1, "the sports the"), (2, "the")], [(0, "the food"), (1, "the")])
    assert results(BM25("id", "document", analyzer="word", stop_words=("the",)).add(docs).search(asked)) == {0: {0: pytest.approx(1)}}
    def letters(rows, keys, text):
        return rows.select(*keys, F.explode(F.split(text, "")).alias("term")).where("term <> ' '").groupBy(*keys, "term").agg(F.count("*").alias("tf"))

    own = BM25("id", "document", analyzer=letters).add(frames(spark)[0])
    assert {r.term for r in own.weights().collect()} == set("foodsportscinema")
    assert results(own.search(asked.where("query_id = 0")))[0][0] > 0


def test_folded_idf_is_the_plain_formula(spark):
    """A batch's weights over their length need idf's sign only: against weights made step by step."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(("ab", "abc", "bcd", "zzz", "q")) for _ in range(rng.randint(0, 9)))) for i in range(12)]
    for norm in ("batch", "global", None):
        index = BM25("id", "document", norm=norm, ngram_range=(1, 2))
        parts = [docs[:5], docs[5:9], docs[9:]]
        for part in parts:
            index = index.add(frames(spark, part)[0])
        grams = lambda t: [w[i : i + n] for w in t.split() for n in (1, 2) for i in range(len(w) - n + 1)]
        known = {g for _, t in parts[0] for g in grams(t)}
        want, cf, n = {}, {}, 0
        for part in parts:
            tf = {i: {} for i, _ in part}
            for i, t in part:
                for g in grams(t):
                    if g in known:
                        tf[i][g] = tf[i].get(g, 0) + 1
                        cf[g] = cf.get(g, 0) + 1
            n += len(part)
            mean = sum(sum(c.values()) for c in tf.values()) / len(part)
            new = {(i, g): c * 2.5 / (c + 1.5 * (0.25 + 0.75 * sum(tf[i].values()) / mean)) * math.log((n + 1) / (cf[g] + 0.5)) for i in tf for g, c in tf[i].items()}
            every = {**want, **new}
            for g in known if norm else ():
                length = math.sqrt(sum(v * v for (_, x), v in (every if norm == "global" else new).items() if x == g))
                for k in list(every if norm == "global" else new):
                    if k[1] == g and length:
                        every[k] /= length
            want = every
        got = {(r.id, r.term): r.weight for r in index.weights().collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


@pytest.mark.parametrize("analyzer", ["char_wb", "word"])
def test_scans_find_what_the_weights_say(spark, monkeypatch, analyzer):
    """Searches by small chunks and few queries at once, against products with the index's weights; no postings are staged."""
    for name, value in (("CHUNK", 3), ("HEAD", 4), ("QUERIES", 2), ("TERMS", 9), ("CACHE", 5), ("AT_ONCE", 2)):
        monkeypatch.setattr(scan, name, value)
    names, plain = [], staging.staged
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(("food", "foot", "sport", "sports", "cinéma", "movie")) for _ in range(rng.randint(0, 6)))
    docs = [(i, text()) for i in range(40)]
    asked = spark.createDataFrame([(0, "food foot"), (1, "sport"), (2, "cinéma movies"), (3, "food foot"), (4, ""), (5, "sports food")], "query_id long, query string")
    for options in ({}, {"norm": "global", "epsilon": 0.5}, {"norm": None, "idf_by": "df"}):
        index = BM25("id", "document", analyzer=analyzer, **options)
        for part in (docs[:15], docs[15:30], docs[30:]):
            index = index.add(frames(spark, part)[0])
        want = sparse.search(index.query_counts(asked).withColumnRenamed("tf", "weight"), index.weights(), "id", 4)
        with monkeypatch.context() as m:
            for module in (lexical, scan):
                m.setattr(module, "staged", lambda df, name, **how: (names.append(name), plain(df, name, **how))[1])
            got = index.search(asked, 4).collect()
        assert {(r.query_id, r["rank"], r.id): round(r.similarity, 7) for r in got} == {(r.query_id, r["rank"], r.id): round(r.similarity, 7) for r in want.collect()}
    assert "chunks" in names and "postings" not in names


def test_rows_of_one_key_are_one_document(spark):
    """As in the queries' SQL; rows of different lengths were documents of their own, and met the mean length so."""
    docs, asked = frames(spark, [(0, "food"), (0, "food sport cinema"), (1, "food sport"), (2, "movie"), (None, "movie")], [(0, "food sport")])
    merged, _ = frames(spark, [(0, "food food sport cinema"), (1, "food sport"), (2, "movie")])
    plain = results(BM25("id", "document", norm="batch").add(merged).search(asked))[0]
    assert results(BM25("id", "document", norm="batch").add(docs).search(asked))[0] == {k: pytest.approx(v) for k, v in plain.items()}


def test_stream_folder_has_no_counts(spark, sf, tmp_path):
    """A stream's folder keeps texts; n-gram counts are many times their size."""
    from sonde.streaming.index import index_stream, load, stream_table

    every = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(20)
    every.write.parquet(f"{tmp_path}/in")
    index_stream(stream_table(spark, every.schema, f"{tmp_path}/in"), BM25("doc_id", "text"), f"{tmp_path}/index", f"{tmp_path}/checkpoint").awaitTermination()
    assert [p.name for p in (tmp_path / "index").iterdir()] == ["rows"]
    assert sum(b.keys.count() for b in load(spark, BM25("doc_id", "text"), f"{tmp_path}/index").batches) == 20


def test_nulls_empty_texts_and_empty_tables(spark):
    docs, asked = frames(spark, [(0, None), (1, ""), (2, "food")], [(0, None), (1, ""), (2, "food")])
    assert list(results(BM25("id", "document").add(docs).search(asked))) == [2]
    assert BM25("id", "document").add(docs.limit(0)).search(asked).count() == 0


def test_order_of_documents_does_not_matter(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(("food", "foot", "sport", "cinema", "movie")) for _ in range(6))) for i in range(30)]
    a = results(BM25("id", "document").add(frames(spark, docs)[0]).search(frames(spark)[1]))
    b = results(BM25("id", "document").add(frames(spark, docs[::-1])[0]).search(frames(spark)[1]))
    assert {q: {k: round(v, 9) for k, v in m.items()} for q, m in a.items()} == {q: {k: round(v, 9) for k, v in m.items()} for q, m in b.items()}


def test_grams(spark):
    row = spark.createDataFrame([("abcd",)], "t string").select(T.grams(F.col("t"), 3, 5).alias("g"), T.n_grams(F.col("t"), 3, 5).alias("n")).head()
    assert sorted(row.g) == ["abc", "abcd", "bcd"] and row.n == 3


def test_content_keeps_the_blank_of_a_null(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert df.select(T.content(("x", "y", "z"))).head()[0] == "a  c"


@pytest.mark.parametrize(
    "name",
    [
        "content_concat", "text_prefix_suffix", "text_strip_accents", "bm25_words", "bm25_global_norm", "encode_vectors_of_places", "encode_sparse", "encode_sparse_embedded", "maxsim_in_batch_scores", "candidates_unknown", "query_dedup", "content_dedup", "batches", "ngram_wb_counts", "term_cf", "bm25_weights_l2", "bm25_topk", "bm25_two_batch", "bm25_df_idf", "tfidf_oov_batch", "splade_pool", "sparse_dot_topk", "decode_tokens",
        "maxsim_retrieve", "maxsim_rank", "sparse_embed_retrieve", "intersect_scores", "sparse_embed_pool", "flatten_candidates", "fan_out_duplicates", "train_loss_sparse_embed", "in_batch_roll", "eval_map", "eval_ndcg", "triples", "epochs", "stream_index",
    ],
)
def test_parity_with_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "part", "embeddings", "conversations", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    assert (order(got) == order(want)).all().all() and len(got) == len(want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm_and_limit_early(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    terms = spark.createDataFrame([("the",)], "term string")
    postings = plan(BM25("doc_id", "text").add(docs).saturated(0, terms))
    assert "Python" not in postings and "Cartesian" not in postings and postings.count("FileScan parquet") == 2  # the n-grams, and the mean length
    assert postings.count("ReadSchema: struct<doc_id:bigint,text:string>") + postings.count("ReadSchema: struct<text:string>") == 2
    p = plan(QUERIES["bm25_topk"](spark, sf))
    assert "WindowGroupLimit" in p and "Python" not in p and "Window [" in p and "text:string" not in p


def test_max_sim_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(p), rng.normal(size=4).tolist()) for k in range(12) for p in range(1 + k % 4)]
    df = spark.createDataFrame(rows, "key long, pos int, embedding array<double>")
    got = results(dense.max_sim_all(df, df.where("key < 3")), "key")
    m = {k: np.array([e for kk, _, e in rows if kk == k]) for k in range(12)}
    for q in range(3):
        for k in range(12):
            assert got[q][k] == pytest.approx((m[q] @ m[k].T).max(1).sum(), abs=1e-9)
    pairs = spark.createDataFrame([(0, 5), (1, 7)], "query_id long, key long")
    for r in dense.max_sim_pairs(df, df, pairs).collect():
        assert r.similarity == pytest.approx((m[r.query_id] @ m[r.key].T).max(1).sum(), abs=1e-9)
    assert dense.max_sim_all(df.limit(0), df.where("key < 3")).count() == 0
    assert dense.max_sim_rank(df, df, pairs.limit(0)).count() == 0


def test_in_batch_products_golden(spark):
    df = spark.createDataFrame([(0, 9, 1.0), (1, 9, 2.0), (2, 9, 3.0)], "key long, term int, value double")
    assert [r.score for r in sparse.in_batch_products(df).orderBy("key").collect()] == [5, 8, 9]


def test_losses(spark):
    scores = spark.createDataFrame([(0, 2.0, 1.0), (1, 0.5, 700.0)], "row long, positive double, negative double")
    want = (math.log(1 + math.exp(-1)) + 699.5) / 2
    assert losses.ranking(scores).head().loss == pytest.approx(want)
    steps = spark.range(1, 4).select(losses.flops_weight(F.col("id"), 1.0, 3).alias("w"))
    assert [r.w for r in steps.collect()] == pytest.approx([4 / 9, 1, 1])
    assert spark.range(1).select(losses.flops_weight(F.col("id"), 1.0, 1)).head()[0] == 0


def test_metrics(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (9, 10, 1)], "query_id long, key long, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 10, 1)], "query_id long, key long, relevance int")
    got = {r.metric: r.value for r in evaluate.evaluate(run, qrels, ("map", "ndcg@10", "hits@2", "hit_rate@2", "recall@2", "precision@2", "mrr@10", "f1@2", "r-precision")).collect()}
    dcg, best = 1 / math.log2(3) + 2 / 2, 2 + 1 / math.log2(3)
    want = {"map": (1 / 2 + 2 / 3) / 2, "ndcg@10": dcg / best, "hits@2": 1, "hit_rate@2": 1, "recall@2": 0.5, "precision@2": 0.5, "mrr@10": 0.5, "f1@2": 0.5, "r-precision": 0.5}
    assert got == {k: pytest.approx(v / 2) for k, v in want.items()}
    assert [round(r.score, 6) for r in evaluate.run_scores(run.where("query_id = 1")).orderBy("rank").collect()] == [1, 0.666667, 0.333333]


def test_upkeep(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    b = spark.createDataFrame([(2, "x"), (3, "y")], "id long, t string")
    assert sorted(map(tuple, rank.add_if_absent(a, b, "id").collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert rank.append(a, b).count() == 4
    assert rank.unknown_candidates(b, a, "id").head().id == 3
    assert rank.candidate_contents(b, a, "id").count() == 1


def test_beir_folder(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps({"_id": f"d{i}", "title": f"t{i}", "text": f"x{i}"}) for i in range(3)))
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": f"q{i}", "text": t}) for i, t in enumerate(("a", "b", "a"))))
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq0\td0\t1\nq2\td1\t1\n")
    docs, asked, qrels = corpora.read_beir(spark, str(tmp_path))
    assert docs.columns == ["id", "title", "text"] and docs.count() == 3
    assert [tuple(r) for r in asked.collect()] == [("q2", "a")]
    assert [tuple(r) for r in qrels.collect()] == [("q2", "d1", 1)]


def test_negatives_can_exclude_the_positive(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, t string")
    asked = spark.createDataFrame([(5, "q")], "query_id long, query string")
    qrels = spark.createDataFrame([(5, i, 1) for i in range(5)], "query_id long, key long, relevance int")
    got = corpora.triples(qrels, asked, docs, "id", "t", exclude_positive=True).collect()
    assert len(got) == 5 and all(r.key != r.negative_key for r in got)


def test_numbers_by_ranges(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g int")
    got = corpora.numbered(df, ["id"], "n").collect()
    assert sorted((r.n, r.id) for r in got) == list(enumerate(sorted(i for i, _ in rows)))
    got = corpora.numbered(df, ["id"], "n", "g").collect()
    for g in range(3):
        assert sorted((r.n, r.id) for r in got if r.g == g) == list(enumerate(sorted(i for i, k in rows if k == g)))
    assert corpora.batches(df.limit(0), ["id"], 8).count() == 0


def test_heads(spark):
    vectors = TokenVectors(SineModel(), cosines(6, 4), 8)
    a, b = vectors.encode(["one two", "a b c d e f g h i j k"])
    assert a.shape == b.shape == (8, 4) and np.allclose(np.linalg.norm(a, axis=1), [1] * 3 + [0] * 5) and np.allclose(np.linalg.norm(b, axis=1), 1)
    sparse_head, dense_head = Activations(SineModel(), 9, top=5), EmbeddedActivations(SineModel(), 9, top=5, linear=cosines(6, 4))
    logits, hidden, mask = SineModel().forward(["x yy [MASK] [MASK] [MASK]"], 9)
    value = np.log1p(np.maximum(logits[0, :5], 0)).max(0)
    terms, values = sparse_head.encode(["x yy"])[0]
    assert terms.tolist() == sorted(range(32), key=lambda t: (-value[t], t))[:5] and np.allclose(values, value[terms])
    at = np.exp(logits[0][:, terms] * mask[0][:, None])
    want = np.maximum((at / at.sum(1, keepdims=True)).T @ (hidden[0] * mask[0][:, None]) @ cosines(6, 4), 0)
    assert np.allclose(dense_head.encode(["x yy"])[0][2], want)
    df = spark.createDataFrame([(1, "x yy"), (2, "x yy"), (3, "")], "id long, t string")
    rows = encode_embedded(df, "id", F.col("t"), lambda: EmbeddedActivations(SineModel(), 9, top=5)).collect()
    assert len(rows) == 15 and {r.token for r in rows if r.id == 1} == set(terms.tolist())
    assert encode_vectors(df, "id", F.col("t"), lambda: TokenVectors(SineModel(), cosines(6, 4), 8)).count() == 24


def test_freeze_leaves_the_last():
    class Parameter:
        requires_grad = True

    class Holder:
        every = [Parameter() for _ in range(7)]

        def parameters(self):
            return iter(self.every)

    freeze(Holder(), 3)
    assert [p.requires_grad for p in Holder.every] == [False] * 4 + [True] * 3


def test_duplicate_queries(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "query_id long, query string")
    with pytest.warns(UserWarning, match="1 duplicate"):
        got = rank.distinct_queries(df, warn=True).collect()
    assert sorted((r.query, r.query_id) for r in got) == [("a", 3), ("b", 2)]


def test_rank_keeps_the_candidates_fields(spark):
    df = spark.createDataFrame([(k, 0, [float(k), 1.0]) for k in range(4)], "key long, pos int, embedding array<double>")
    cand = spark.createDataFrame([(1, 2, "x", 9), (1, 3, "y", 8)], "query_id long, key long, title string, rank int")
    got = dense.max_sim_rank(df, df, cand).collect()
    assert [(r["rank"], r.key, r.title) for r in got] == [(1, 3, "y"), (2, 2, "x")]


def test_persisted_embeddings_and_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([(k, [float(k)]) for k in range(4)], "key long, embedding array<double>")
    store.save_embeddings(df, str(tmp_path / "e"))
    assert sorted(map(tuple, store.load_embeddings(spark, str(tmp_path / "e")).collect())) == sorted(map(tuple, df.collect()))
    store.save_checkpoint(spark, str(tmp_path / "m"), {"linear": cosines(3, 2), "bias": np.zeros(2)}, {"length": 32})
    weights, params = store.load_checkpoint(spark, str(tmp_path / "m"))
    assert params == {"length": 32} and np.array_equal(weights["linear"], cosines(3, 2)) and weights["bias"].shape == (2,)


def test_shared_folder_must_be_given_on_a_cluster(monkeypatch):
    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(Fake)


def test_store_round_trip(spark, tmp_path):
    docs, _ = frames(spark)
    store.save_index(BM25("id", "document").add(docs).weights(), str(tmp_path / "ix"), {"b": 0.75})
    postings, params = store.load_index(spark, str(tmp_path / "ix"))
    assert params == {"b": 0.75} and postings.count() == 3 + 9 + 9


def test_distinct_texts_are_encoded_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, t string")
    got = {r.id: r.matrix for r in encode(df, "id", F.coalesce("t", F.lit("")), lambda: HashingEncoder(4, 3)).collect()}
    assert got[1] == got[2] and len(got[3]) == 3
    assert np.allclose(np.linalg.norm(np.array(got[1]), axis=1), [1, 1, 0])


def test_encoding_takes_all_words(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["encode_map_in_pandas"](spark, sf).collect()}
    assert len(got) == len(texts) and max(r.n_tokens for r in got.values()) > 1000
    for i, t in texts.items():
        words = ["[D]", *t.split()]
        want = np.zeros(16)
        for w in words:
            v = np.random.default_rng(zlib.crc32(w.encode())).standard_normal(16)
            want += (v / np.linalg.norm(v)).astype(np.float32)
        assert got[i].n_tokens == len(words) and np.allclose(got[i].total, want, atol=1e-3)


def test_dot_and_floor(spark):
    df = spark.createDataFrame([([1.0, 2.0], [[-1.0, -1.0]])], "a array<double>, m array<array<double>>")
    row = df.select(dot(F.col("a"), F.col("a")), max_sim(F.array("a"), F.col("m")), max_sim(F.array("a"), F.col("m"), True)).head()
    assert list(row) == [5, -3, 0]


def test_registry_runs_without_the_llm_subpackage():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


LETTERS = ["Ab cabİ  abc", "", None, "漢字漢字 ab", "a\U0001f600bc\U0001f600bc", "x\x00yz\x00yz", "ab", "abc abc abc", "࿾࿿က abc", "zq zq"]


def plain_tfidf(docs, low, high):
    """Vectors of (key, texts) by plain dictionaries."""
    tf = {}
    for key, t in docs:
        t = " ".join((t or "").lower().split())
        grams = [t[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1)]
        for g in grams:
            mine = tf.setdefault(key, {})
            mine[g] = mine.get(g, 0) + 1
    df = {}
    for mine in tf.values():
        for g in mine:
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}
    unit = lambda w: {g: x / math.sqrt(sum(y * y for y in w.values())) for g, x in w.items()}
    return {key: unit({g: n * idf[g] for g, n in mine.items()}) for key, mine in tf.items()}, idf, unit


@pytest.mark.parametrize("low, high, size", [(3, 5, None), (1, 2, None), (2, 4, 3), (3, 3, 1)])
def test_tfidf_by_scans(spark, monkeypatch, low, high, size):
    """the weights are not written down, whatever the letters, and the table may be of many slices."""
    staged_as = []
    monkeypatch.setattr(lexical, "staged", lambda df, name, **o: staged_as.append(name) or staging.staged(df, name, **o))
    if size:  # more files of repeated n-grams
        monkeypatch.setattr(chars, "SLICE", size)
    docs = [(i, t) for i, t in enumerate(LETTERS)] + [(7, "one more abc"), (9, "ab")]
    index = TfIdf("id", "document", ngram_range=(low, high)).add(spark.createDataFrame(docs, "id long, document string"))
    want, idf, unit = plain_tfidf(docs, low, high)
    got = {}
    for r in index.weights().collect():
        assert r["term"] not in got.setdefault(r["id"], {})
        got[r["id"]][r["term"]] = r["weight"]
    assert got == {key: pytest.approx(w) for key, w in want.items()}
    totals = {r["id"]: (r["n"], r["total"], r["most"]) for r in index.totals().collect()}
    assert totals == {key: pytest.approx((len(w), sum(w.values()), max(w.values()))) for key, w in want.items()}
    queries = [(i, t) for i, t in enumerate(LETTERS)] + [(20, "nothing known 一丁"), (7, "zq")]
    asked = spark.createDataFrame([*queries, (None, "abc")], "query_id long, query string")
    scores = {}
    for q, w in plain_tfidf(queries, low, high)[0].items():
        texts = [" ".join((t or "").lower().split()) for i, t in queries if i == q]
        tf = {}
        for t in texts:
            for g in (t[i : i + n] for n in range(low, high + 1) for i in range(len(t) - n + 1)):
                if g in idf:
                    tf[g] = tf.get(g, 0) + 1
        w = unit({g: n * idf[g] for g, n in tf.items()}) if tf else {}
        mine = {d: s for d, v in want.items() if (s := sum(x * v.get(g, 0.0) for g, x in w.items())) > 1e-9}
        if mine:
            scores[q] = mine
    every = {q: pytest.approx(s) for q, s in scores.items()}
    assert results(index.search(asked)) == every
    best = {q: [d for d, _ in sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:2]] for q, s in scores.items()}
    assert {q: list(s) for q, s in results(index.search(asked, 2).orderBy("query_id", "rank")).items()} == best
    assert not {"counts", "weights", "tfidf"} & set(staged_as)


def test_tfidf_table_of_many_slices(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(3)
    grams, df = np.unique(rng.integers(-(1 << 62), 1 << 60, 5000)), None
    df = rng.integers(2, 900, len(grams))
    urls = []
    for i, part in enumerate(np.array_split(np.arange(len(grams)), 3)):
        pq.write_table(pa.table({"gram": grams[part], "df": df[part]}), tmp_path / f"{i}.parquet")
        urls.append(f"file://{tmp_path}/{i}.parquet")
    alone = np.setdiff1d(rng.integers(0, 1 << 60, 500), grams)
    asked = np.sort(np.concatenate([grams[::7], alone[:9]]))
    look = np.concatenate([grams, alone])
    want = np.log(1000 / (1 + np.concatenate([df, np.ones(len(alone), int)]))) + 1
    place = {g: i for i, g in enumerate(asked.tolist())}
    for size in (100, 1 << 20):
        monkeypatch.setattr(chars, "SLICE", size)
        for u in (urls, []):
            weights = chars.Weights(u, 999, asked)
            idf, term = weights.of(look)
            assert np.allclose(idf, want if u else np.log(1000 / 2) + 1)
            assert term.tolist() == [place.get(g, -1) for g in look.tolist()]
