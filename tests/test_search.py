"""Searches against brute force in plain Python, on both data placements."""

import math
import random
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwell.operators import block_join, pivots
from pairwell.operators.block_join import Kernel, Limits, Search, _Best, best_of_each, contenders
from pairwell.operators.bm25 import Bm25Kernel, bm25_search, bm25_topk, corpus_stats, corpus_totals, merged_counts, term_counts, tokenised
from pairwell.operators.lsh import lsh_candidate_counts, lsh_topk
from pairwell.operators.pivots import pivot_reach, pivot_topk, write_pivot_index
from pairwell.operators.sketch import MAX_HASH, band_table, optimal_bands, permutations, signature, skills_signature
from pairwell.operators.vector import vector_search, vector_topk
from pairwell.sources.search_index import (
    banded_pairs,
    indexed_bands,
    indexed_bm25_topk,
    indexed_counts,
    indexed_lsh_topk,
    indexed_words,
    write_index,
)

# Everything broadcast, and many small blocks.
PLACEMENTS = [Limits(), Limits(broadcast_bytes=0, block_bytes=600, scores=64)]
WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def corpus():
    """Small texts in which one text makes up a third and one word is everywhere."""
    draw = random.Random(7)
    docs = {i: ["hot", *draw.choices(WORDS, k=draw.randint(0, 9))] for i in range(60)}
    docs |= {i: docs[0] for i in range(60, 90)}
    docs[90] = []
    cvs = {i: ["hot", *draw.choices(WORDS, k=6)] for i in range(12)}
    cvs[12] = []
    cvs[13] = ["unknown", "words"]
    cvs[14] = docs[0]
    return cvs, docs


def frames(spark, corpus):
    cvs, docs = corpus
    left = spark.createDataFrame([(i, " ".join(t)) for i, t in cvs.items()], "cv_id long, title string")
    right = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, title string")
    return left.repartition(3), right.repartition(4)


def ranked(scores, k):
    """``{(cv, rank): (doc, score)}`` from ``{cv: {doc: score}}``."""
    out = {}
    for cv, by_doc in scores.items():
        best = sorted(by_doc.items(), key=lambda item: (-item[1], item[0]))[:k]
        out |= {(cv, rank): item for rank, item in enumerate(best, 1)}
    return out


def collected(channel):
    return {(r.cv_id, r.rank): (r.doc_id, r.raw_score) for r in channel.collect()}


def assert_same(got, expected):
    assert got.keys() == expected.keys()
    for key, (doc, score) in expected.items():
        assert got[key][0] == doc and got[key][1] == pytest.approx(score, abs=2e-6), key


@pytest.mark.parametrize("limits", PLACEMENTS)
@pytest.mark.parametrize("dedup", [False, True])
def test_bm25(spark, corpus, limits, dedup):
    cvs, docs = corpus
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    scores = {}
    for cv, asked in cvs.items():
        for doc, words in docs.items():
            times = Counter(words)
            score = sum(
                2.0 * (1 if dedup else q) * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                * times[t] * 2.2 / (times[t] + 1.2 * (0.25 + 0.75 * len(words) / mean))
                for t, q in Counter(asked).items() if times[t]
            )
            if score > 0:
                scores.setdefault(cv, {})[doc] = round(score, 6)
    got = bm25_topk(*frames(spark, corpus), 5, dedup_terms=dedup, limits=limits, digits=6)
    assert_same(collected(got), ranked(scores, 5))


def sketches(spark, corpus):
    def side(frame):
        words = F.array_distinct(F.filter(F.split("title", " "), lambda w: w != ""))
        return frame.withColumn("tokens", words).withColumn("signature", signature(F.col("tokens")))

    return [side(frame) for frame in frames(spark, corpus)]


@pytest.mark.parametrize("limits", PLACEMENTS)
@pytest.mark.parametrize("threshold", [0.05, 0.4])
@pytest.mark.parametrize("verify", ["sketch", "exact"])
def test_lsh(spark, corpus, limits, threshold, verify):
    left, right = sketches(spark, corpus)
    a = {r.cv_id: (r.signature, set(r.tokens)) for r in left.collect()}
    b = {r.doc_id: (r.signature, set(r.tokens)) for r in right.collect()}
    bands, rows = optimal_bands(threshold)
    scores, counts = {}, Counter()
    for cv, (s, x) in a.items():
        for doc, (t, y) in b.items():
            parts = [slice(i * rows, (i + 1) * rows) for i in range(bands)]
            if x and y and any(s[p] == t[p] for p in parts):
                counts[cv] += 1
                same = sum(p == q for p, q in zip(s, t)) / 128
                jaccard = len(x & y) / len(x | y)
                value = same if verify == "sketch" else jaccard
                scores.setdefault(cv, {})[doc] = math.floor(value * 1e6 + 0.5) / 1e6
    got = lsh_topk(left, right, 5, threshold, verify=verify, limits=limits, digits=6)
    assert_same(collected(got), ranked(scores, 5))
    found = lsh_candidate_counts(left, right, threshold, limits=limits).collect()
    assert {r.cv_id: r.candidates for r in found if r.candidates} == dict(counts)


def test_lsh_rejects_unknown_verification(spark, corpus):
    with pytest.raises(ValueError):
        lsh_topk(*sketches(spark, corpus), 5, verify="guess")


@pytest.mark.parametrize("limits", PLACEMENTS)
def test_vector_topk(spark, limits):
    draw = np.random.default_rng(3)
    docs = {f"d{i:02}": draw.normal(size=8).astype(np.float32).tolist() for i in range(40)}
    docs |= {f"e{i:02}": docs["d00"] for i in range(20)}
    docs |= {"null": None, "zero": [0.0] * 8}
    cvs = {i: draw.normal(size=8).astype(np.float32).tolist() for i in range(6)}
    cvs |= {6: None, 7: [0.0] * 8, 8: docs["d00"]}
    left = spark.createDataFrame(list(cvs.items()), "cv_id int, vector array<float>").repartition(2)
    right = spark.createDataFrame(list(docs.items()), "doc_id string, vector array<float>").repartition(3)
    scores = {}
    for cv, u in cvs.items():
        for doc, v in docs.items():
            if u and v and any(u) and any(v):
                cosine = np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v))
                scores.setdefault(cv, {})[doc] = math.floor((cosine + 1) * 1e6 + 0.5) / 1e6
    got = vector_topk(left, right, 7, limits=limits, digits=6)
    assert_same(collected(got), ranked(scores, 7))


@pytest.mark.parametrize("limits", PLACEMENTS)
def test_pivots_find_what_all_scores_find(spark, tmp_path, limits):
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(12, 10))
    docs = [(i, (centres[i % 12] + 0.1 * draw.normal(size=10)).astype(np.float32).tolist()) for i in range(400)]
    docs += [(400 + i, docs[0][1]) for i in range(30)] + [(500, None), (501, [0.0] * 10)]
    cvs = [(i, (centres[i % 12] + 0.2 * draw.normal(size=10)).astype(np.float32).tolist()) for i in range(20)]
    cvs += [(20, None), (21, [0.0] * 10), (22, docs[0][1])]
    right = spark.createDataFrame(docs, "doc_id long, vector array<float>")
    left = spark.createDataFrame(cvs, "cv_id int, vector array<float>")
    path = str(tmp_path / "index")
    assert write_pivot_index(right, path) == 21
    got = collected(pivot_topk(spark, path, left, 4, limits=limits, digits=6))
    assert got == collected(vector_topk(left, right, 4, digits=6))
    reached = {r.cv_id: r.candidates for r in pivot_reach(spark, path, left, 4, limits=limits, digits=6).collect()}
    assert reached.keys() == set(range(20)) | {22} and sum(reached.values()) < 0.5 * 430 * 21
    few = str(tmp_path / "few")
    write_pivot_index(right, few, pivots=2)
    assert collected(pivot_topk(spark, few, left, 4, limits=limits, digits=6)) == got
    none = str(tmp_path / "none")
    assert write_pivot_index(right.limit(0), none) == 0
    assert pivot_topk(spark, none, left, 4, limits=limits).count() == 0


def test_scores_that_differ_little_keep_their_order(spark):
    left = spark.createDataFrame([(0, [1.0, 0.0])], "cv_id int, vector array<double>")
    right = spark.createDataFrame([(1, [1.0, 0.0008]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "doc_id int, vector array<double>")
    assert [r.doc_id for r in vector_topk(left, right, 2).orderBy("rank").collect()] == [2, 3]


def test_many_profiles_merge_in_few_steps():
    rng = np.random.default_rng(1)
    profiles, postings = 20_000, 300
    scores = rng.random((profiles, postings))

    class Fixed(Kernel):
        def matches(self, state, batch, floor, k):
            ids = batch.column("doc_id")
            return contenders(scores[:, ids.to_numpy()], floor, k, ids)

    ids = pa.array(np.arange(postings))
    batch = pa.RecordBatch.from_arrays([ids], names=["doc_id"])
    start = time.process_time()
    running = _Best(Search("fixed", Fixed(), None, 0, {}), SimpleNamespace(ids=pa.array(np.arange(profiles))), 5, 300_000)
    running.add(batch)
    (*parts,) = running.result()
    assert time.process_time() - start < 20
    got = pa.Table.from_batches(parts).to_pandas().sort_values(["cv_id", "score"], ascending=[True, False])
    best = np.sort(scores, axis=1)[:, ::-1][:, :5]
    assert np.array_equal(got["score"].to_numpy().reshape(profiles, 5), best)


def test_vectors_of_different_lengths_are_an_error(spark):
    left = spark.createDataFrame([(1, [1.0, 2.0])], "cv_id int, vector array<float>")
    for rows in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, [1.0, 2.0, 3.0])]):
        right = spark.createDataFrame(rows, "doc_id int, vector array<float>")
        with pytest.raises(Exception, match="different lengths"):
            vector_topk(left, right, 1).collect()


@pytest.mark.parametrize("limits", PLACEMENTS)
def test_no_profiles_or_no_postings(spark, corpus, limits):
    left, right = sketches(spark, corpus)
    assert lsh_topk(left.limit(0), right, 5, limits=limits).count() == 0
    assert lsh_topk(left, right.limit(0), 5, limits=limits).count() == 0
    texts = frames(spark, corpus)
    assert bm25_topk(texts[0].limit(0), texts[1], 5, limits=limits).count() == 0
    assert bm25_topk(texts[0], texts[1].limit(0), 5, limits=limits).count() == 0


def test_signature_matches_its_definition(spark):
    from hashlib import sha1

    rows = [["Python", " ", "SQL "], [], None]
    frame = spark.createDataFrame([(r,) for r in rows], "skills array<string>")
    got = [r[0] for r in frame.select(skills_signature(F.col("skills"))).collect()]
    numbers = [int.from_bytes(sha1(t).digest()[:4], "little") for t in (b"python", b"sql")]
    expected = [
        min(((int(a) * x + int(b)) % 2**64 % (2**61 - 1)) & MAX_HASH for x in numbers)
        for a, b in permutations()
    ]
    assert got == [expected, [MAX_HASH] * 128, [MAX_HASH] * 128]


def test_sketch_estimates_jaccard(spark):
    draw = random.Random(1)
    pairs = []
    for i in range(40):
        shared = draw.randint(0, 30)
        x = {f"s{i}-{j}" for j in range(shared)}
        pairs.append((i, sorted(x | {f"a{i}-{j}" for j in range(20)}), sorted(x | {f"b{i}-{j}" for j in range(20)})))
    frame = spark.createDataFrame(pairs, "i int, a array<string>, b array<string>")
    rows = frame.select("a", "b", signature(F.col("a")).alias("s"), signature(F.col("b")).alias("t")).collect()
    errors = [
        np.mean(np.array(r.s) == np.array(r.t)) - len(set(r.a) & set(r.b)) / len(set(r.a) | set(r.b)) for r in rows
    ]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_band_layout():
    assert optimal_bands(0.05, 128) == (32, 1)
    bands, rows = optimal_bands(0.8, 128)
    assert bands * rows <= 128 and rows > 5


def test_band_table(spark):
    frame = spark.createDataFrame([(1, list(range(128)))], "doc_id long, signature array<bigint>")
    rows = band_table(frame, threshold=0.5).orderBy("band").collect()
    assert len(rows) == 25
    assert rows[1].bucket == "5-6-7-8-9"


def test_corpus_statistics(spark):
    frame = spark.createDataFrame([(["a", "b", "a"],), (["b"],), ([],), (None,)], "tokens array<string>")
    stats = {r.term: (r.docs, r.occurrences) for r in corpus_stats(frame).collect()}
    assert stats == {"a": (1, 2), "b": (2, 2)}
    assert tuple(corpus_totals(frame).first()) == (4, 4, 1.0)


def test_term_counts_merge(spark):
    first = spark.createDataFrame([(["a", "b", "a"],), (["b"],), ([],), (None,)], "tokens array<string>")
    second = spark.createDataFrame([(["a"] * 5 + ["c"],)], "tokens array<string>")
    rows = {r.term: tuple(r)[1:] for r in merged_counts(term_counts(first).unionByName(term_counts(second))).collect()}
    assert rows == {"": (5, 10, None, None), "a": (2, 7, 5, 3), "b": (2, 2, 1, 1), "c": (1, 1, 1, 6)}
    assert [tuple(r) for r in term_counts(first.limit(0)).collect()] == [("", 0, 0, None, None)]


@pytest.mark.parametrize("limits", PLACEMENTS)
def test_bm25_on_stored_statistics(spark, corpus, limits):
    left, right = frames(spark, corpus)
    stored = tokenised(right, "title")
    search = bm25_search(left, None, stats=term_counts(stored), limits=limits, digits=6)
    got = best_of_each([search], stored, 90, limits)
    same = bm25_topk(left, right, 90, limits=limits, digits=6)
    assert {(r.cv_id, r.doc_id): r.score for r in got.collect()} == {(r.cv_id, r.doc_id): r.raw_score for r in same.collect()}


def test_words_of_small_gain_find_no_postings_of_their_own():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    profiles = pa.table({
        "cv_id": [cv for cv in range(6) for _ in words],
        "term": words * 6,
        "weight": [rng.choice([0.01, 0.02, 0.01, 0.02, 5.0]) for _ in range(6 * len(words))],
    })
    profiles = profiles.append_column("peak", pa.array(profiles["weight"].to_numpy() * 2.2))
    kernel = Bm25Kernel(6.0, 1.2, 0.75, 6)
    lists = [rng.choices(words, k=rng.randrange(12)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "tokens"])
    state = kernel.prepare(profiles)
    coded = kernel.encode(state, batch)
    nothing = np.full(6, -np.inf)
    row, column, score = kernel.matches(state, coded, nothing, 10)
    floor = np.array([np.sort(score[row == cv])[-10] for cv in range(6)])
    whole = {(r, c): s for r, c, s in zip(row, column, score) if s >= floor[r]}
    cells = []
    add_up = type(state.index).add_up
    state.index.__class__.add_up = lambda self, *args: cells.append(len((found := add_up(self, *args))[0])) or found
    try:
        again = dict(zip(zip(*(x := kernel.matches(state, coded, floor, 10))[:2]), x[2]))
    finally:
        state.index.__class__.add_up = add_up
    assert again.keys() == whole.keys() and all(abs(again[k] - whole[k]) < 1e-9 for k in whole)
    assert cells[0] < 0.8 * len(row)


def test_best_rows_do_not_depend_on_merging(spark, corpus, monkeypatch):
    left, right = frames(spark, corpus)
    usual = collected(bm25_topk(left, right, 3, digits=6))
    monkeypatch.setattr(block_join, "MERGE_ROWS", 1)
    assert collected(bm25_topk(left, right, 3, limits=Limits(scores=40), digits=6)) == usual


def test_profiles_beyond_the_bound_leave_postings_where_they_are(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=256).astype(np.float32).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    left, right = vectors.withColumnRenamed("id", "cv_id"), vectors.withColumnRenamed("id", "doc_id").repartition(3)
    limits = Limits(broadcast_bytes=100_000, block_bytes=60_000)
    search = vector_search(left, "vector", "vector", "v", 6)
    assert search.profile_bytes > limits.broadcast_bytes
    found = best_of_each([search], right, 2, limits)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition above
    first = {r.cv_id: r.doc_id for r in vector_topk(left, right, 1, limits=limits, digits=6).collect()}
    assert first == {i: i for i in range(300)}


def test_results_of_very_many_tasks_are_ranked_in_two_steps(spark, corpus):
    left, right = frames(spark, corpus)
    usual = collected(bm25_topk(left, right, 4, digits=6))
    twice = bm25_topk(left, right, 4, limits=Limits(tasks=0), digits=6)
    assert collected(twice) == usual and "branch" in twice._jdf.queryExecution().optimizedPlan().toString()


def test_band_index_finds_what_the_kernel_finds(spark, corpus):
    left, right = sketches(spark, corpus)
    bands = band_table(right.filter("size(tokens) > 0"), threshold=0.4)
    usual = collected(lsh_topk(left, right, 5, 0.4, digits=6))
    for limits, hot in ((Limits(), 10), (Limits(broadcast_bytes=0, block_bytes=3000), 4), (Limits(broadcast_bytes=0), 10**6)):
        assert collected(indexed_lsh_topk(bands, left, right, 5, 0.4, limits=limits, digits=6, hot_rows=hot)) == usual
    asked = band_table(left.filter("size(tokens) > 0"), "cv_id", threshold=0.4)
    pairs = {tuple(r) for r in banded_pairs(asked, bands, Limits(), 5).collect()}
    salted = banded_pairs(asked, bands, Limits(broadcast_bytes=0), 5)
    assert {tuple(r) for r in salted.collect()} == pairs and salted.count() == len(pairs)


def test_index_follows_the_newest_batch(spark, tmp_path):
    def batch(rows):
        frame = spark.createDataFrame(rows, "posting_id string, title string, skills array<string>")
        return frame.withColumn("skills_signature", skills_signature(F.col("skills")))

    index = str(tmp_path / "index")
    write_index(batch([("a", "old old words", ["x"]), ("b", "new words", ["y"]), ("c", None, [])]), index, 0)
    write_index(batch([("a", "new", ["z"])]), index, 1)
    write_index(batch([("a", "new", ["z"])]), index, 1)
    words = {r.posting_id: r.tokens for r in indexed_words(spark, index).collect()}
    assert words == {"a": ["new"], "b": ["new", "words"], "c": []}
    counts = {r.term: (r.docs, r.tokens) for r in indexed_counts(spark, index).collect()}
    assert counts == {"": (3, 3), "new": (2, 2), "words": (1, 1)}
    bands = indexed_bands(spark, index)
    assert {r.doc_id for r in bands.collect()} == {"a", "b"} and bands.count() == 64
    profiles = spark.createDataFrame([(1, "old new")], "cv_id int, title string")
    found = indexed_bm25_topk(spark, index, profiles, 5).orderBy("rank").collect()
    assert [r.doc_id for r in found] == ["a", "b"]


def test_a_task_holds_profiles_by_what_it_needs_for_them(spark, tmp_path):
    """Not by their rows alone: unit vectors, angles to pivots and the running best take more."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "id long, vector array<float>")
    left, right = vectors.withColumnRenamed("id", "cv_id"), vectors.withColumnRenamed("id", "doc_id")
    limits = Limits(broadcast_bytes=200_000, block_bytes=200_000)
    path = str(tmp_path / "index")
    write_pivot_index(right, path)

    def bounded(search, most):
        whole = search.kernel.prepare

        def prepare(profiles):
            assert profiles.num_rows <= most, profiles.num_rows
            return whole(profiles)

        search.kernel.prepare = prepare
        return search

    search = bounded(vector_search(left, "vector", "vector", "v", 6), 200)
    assert search.profile_bytes <= limits.broadcast_bytes
    found = best_of_each([search], right, 10, limits).filter("cv_id = doc_id")
    assert found.count() == 2000
    search, stored = pivots._searched(spark, path, left, 10, "vector", "v", pivots.PivotKernel, limits, 6)
    assert best_of_each([bounded(search, 200)], stored, 10, limits).filter("cv_id = doc_id").count() == 2000


def test_pivots_score_few_pairs_in_full(spark, tmp_path, monkeypatch):
    """Cosines in single precision leave the pairs that can reach a floor; only those are scored."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 16)).astype(np.float32)
    cen = pa.table({"doc_id": range(40), "vector": vectors[:40].tolist()}, pa.schema([("doc_id", pa.int64()), ("vector", pa.list_(pa.float32()))]))
    kernel = pivots.PivotKernel(cen, 3, 6)
    profiles = pa.table({"cv_id": range(300), "vector": vectors[:300].tolist()}, pa.schema([("cv_id", pa.int64()), ("vector", pa.list_(pa.float32()))]))
    units = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1)[:, None]
    cosine = units @ units[:40].T
    near, angle = cosine.argmax(axis=1), np.arccos(np.clip(cosine.max(axis=1), -1, 1))
    order = np.lexsort((angle, near))
    columns = [pa.array(order), pa.array(vectors[order].tolist(), pa.list_(pa.float32())), pa.array(near[order].astype(np.int32)), pa.array(angle[order])]
    postings = pa.RecordBatch.from_arrays(columns, names=["doc_id", "vector", "pivot", "angle"])
    state, scored = kernel.prepare(profiles), []
    monkeypatch.setattr(pivots, "rounded", lambda score, digits, plain=pivots.rounded: scored.append(score.size) or plain(score, digits))
    row, column, score = kernel.matches(state, postings, np.full(300, -np.inf), 3)
    whole = block_join.rounded(units[:300] @ units.T + 1.0, 6)
    floor = np.sort(whole[:, :40], axis=1)[:, -3]
    expected = {(i, j): whole[i, j] for i, j in zip(*np.nonzero(whole >= floor[:, None]))}
    assert {(i, order[j]): s for i, j, s in zip(row, column, score)} == expected
    assert sum(scored) < 0.2 * whole.size
