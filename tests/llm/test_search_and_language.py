"""Neighbour search and language labels against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenlens.llm import ann, language
from scenlens.llm.queries import op2_cross_polytope
from scenlens.llm.shared import stored
from scenlens.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import documents, nothing, odd_rows, words

# ---- neighbours ---------------------------------------------------------------------------


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("q", "ids", "tbl", "bucket", "part", "slice", "nth", "asks", "score", "rank"))])


def brute_neighbours(rows, is_query, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    good = [(i, v) for i, v in good if len(v) == size]
    out = set()
    for q, v in good:
        if is_query(q):
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)[:k]
            out |= {(q, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(near)}
    return out


def searched(df, divisor=10, **options):
    rows = ann.nearest(df, F.col("vec_id") % divisor == 0, **options).collect()
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in rows}


def test_all_buckets_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, rows[10][1])]
    rows += [(400, None), (401, [0.0] * 6), (410, [float("nan")] * 6), (420, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (430, [math.inf] * 6), (440, [1.0, 2.0]),
             (None, [1.0] * 6), (450, [])]
    assert searched(vectors(spark, rows), probes=16) == brute_neighbours(rows, lambda i: i % 10 == 0, 10)


def test_few_rows_are_found_whole(spark):
    rows = [(i, [float(i + 1), -1.0, 0.5]) for i in range(5)]
    assert searched(vectors(spark, rows), 1, probes=1, tables=1) == brute_neighbours(rows, lambda i: True, 10)
    assert searched(vectors(spark, [(0, [1.0])])) == set()
    assert searched(vectors(spark, [])) == set()


def test_recall_and_order(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(1500, 32)))]
    got, want = searched(vectors(spark, rows), 50, tables=12, probes=10), brute_neighbours(rows, lambda i: i % 50 == 0, 10)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    for _, group in itertools.groupby(sorted(got), key=lambda r: r[0]):
        near = list(group)
        assert [r[1] for r in near] == list(range(1, 11)) and [(r[3], r[2]) for r in near] == sorted((r[3], r[2]) for r in near)


def test_recall_on_the_given_embeddings(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in given.collect()}
    got, hit, want = op2_cross_polytope(spark, sf_dir).collect(), 0, 0
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert all(abs(r["score"] - np.linalg.norm(x[r["query_id"]] - x[r["vec_id"]])) < 1e-12 for r in got)
    for q in (i for i in x if i % 100 == 0):
        near = sorted((np.linalg.norm(v - x[q]), i) for i, v in x.items() if i != q)[:10]
        hit, want = hit + sum((q, i) in found for _, i in near), want + len(near)
    assert hit >= 0.9 * want > 0


def test_a_vector_is_moved_once_whatever_the_tables(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = vectors(spark, [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)])
    dealt = []
    monkeypatch.setattr(ann, "stored", lambda df, label: dealt.append((label, df)) or stored(df, label))
    ann.nearest(rows, F.col("vec_id") % 10 == 0, tables=12, probes=8)
    plan = next(df for label, df in dealt if label == "ann-found")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "Join" not in plan and "explode(" in plan


def test_buckets_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_POINTS", 5)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(80)]
    assert searched(vectors(spark, rows), 4, probes=8) == brute_neighbours(rows, lambda i: i % 4 == 0, 10)


def test_turned_vectors_keep_their_length():
    x = np.random.default_rng(4).normal(size=(50, 12)) * 1e30
    scores = ann.axis_scores(x, ann.rotations(12, 1)[0])
    assert np.allclose((scores[:, :16] ** 2).sum(1), 1.0) and (scores[:, :16] == -scores[:, 16:]).all()


# ---- language -----------------------------------------------------------------------------

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}


def speech(rng, lang, n):
    return ["".join(rng.choices(LETTERS[lang], k=rng.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    return language.fit_field({k: [speech(rng, k, 100) for _ in range(20)] for k in LETTERS}, chains=600)


def test_forward_backward_matches_all_paths(field):
    rng = np.random.default_rng(1)
    scores, steps, k = rng.normal(size=(1, 4, 3)), 4, 3
    total, post, moved = 0.0, np.zeros((steps, k)), np.zeros((k, k))
    for path in itertools.product(range(k), repeat=steps):
        p = math.exp(field.first[path[0]] + sum(scores[0, t, s] for t, s in enumerate(path)) + sum(field.moves[a, b] for a, b in itertools.pairwise(path)))
        total += p
        for t, s in enumerate(path):
            post[t, s] += p
        for a, b in itertools.pairwise(path):
            moved[a, b] += p
    got, moves = field.posteriors(scores, np.ones((1, 4), bool))
    assert np.allclose(got[0], post / total) and np.allclose(moves, moved / total)
    padded = np.concatenate([scores, rng.normal(size=(1, 3, 3))], axis=1)
    got, moves = field.posteriors(padded, np.array([[True] * 4 + [False] * 3]))
    assert np.allclose(got[0, :4], post / total) and np.allclose(moves, moved / total)


def test_words_of_mixed_text_get_their_own_labels(field):
    rng = random.Random(2)
    w = [(x, k) for k in ("aa", "bb", "cc", "aa") for x in speech(rng, k, 14)]
    post, _ = field.posteriors(field.emissions([x for x, _ in w])[None], np.ones((1, len(w)), bool))
    assert np.mean([field.labels[i] == k for i, (_, k) in zip(post[0].argmax(1), w, strict=True)]) > 0.95
    assert (np.diag(field.moves) > field.moves.mean()).all()  # it stays in a language more than it switches


def test_labels_of_texts(spark, field, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(speech(rng, k, rng.randint(3, 500))), k, "a", 1) for i, k in enumerate(list(LETTERS) * 10)]
    monkeypatch.setattr(language, "_MAX_TOKENS", 200)
    got = {r["doc_id"]: r for r in language.label_texts(documents(spark, rows), field).collect()}
    assert all(got[i]["lang_pred"] == k and 0.5 < got[i]["score"] <= 1 for i, _, k, _, _ in rows)
    assert all(got[i]["n_words"] == len(t.split()) for i, t, *_ in rows)


def test_texts_without_spaces_are_read_whole(spark, field):
    rng = random.Random(5)
    head, tail = "".join(speech(rng, "aa", 20)), "".join(speech(rng, "bb", 400))
    texts = [head + tail, ",".join([head, *speech(rng, "bb", 400)]), "。".join([head, tail])]
    got = language.label_texts(documents(spark, [(i, t, "bb", "a", 1) for i, t in enumerate(texts)]), field).collect()
    assert {r["lang_pred"] for r in got} == {"bb"} and all(r["n_words"] > 20 for r in got)


def test_pieces_hold_every_letter():
    long = "Ab1" * 30 + "é" * 95 + "..." + "क्" * 60
    got = language.pieces(["short", long, "-" * 90 + "word" + "!" * 90])
    assert got[0] == "short" and language.normal(got[-1]) == "word"
    assert all(len(language.normal(p)) <= 40 for p in got)
    language.features([language.normal(p) for p in language.pieces(["\u0130" * 40, long])])
    assert [c for p in got[1:-1] for c in p if c.isalpha()] == [c for c in long.lower() if c.isalpha()]


def test_labels_of_odd_texts(spark, field):
    rows = language.label_texts(documents(spark), field).collect()
    assert len(rows) == len(odd_rows())
    letters = {i: bool(t) and any(c.isalpha() for c in t) for i, t, *_ in odd_rows() if i is not None}
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not letters[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0)
    assert language.label_texts(nothing(spark), field).count() == 0
    assert {r["lang_pred"] for r in language.label_texts(documents(spark), None).collect()} == {"und"}


def test_training_is_bounded_and_passes_gaps_over(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(speech(rng, k, 40)), k, "a", 1) for i, k in enumerate(list(LETTERS) * 12)]
    odd = [(900, None, "aa", "a", 1), (901, "abc", None, "a", 1), (902, "123", "dd", "a", 1)]
    trained = language.train(documents(spark, rows + odd), sample_docs=4, chains=100)
    assert trained.labels == sorted(LETTERS)
    assert language.train(nothing(spark)) is None and language.train(documents(spark, odd)) is None


def test_held_out_rows(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r["doc_id"]: r["h"] for r in df.select("doc_id", language.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)} | {None: False}


# ---- queries ------------------------------------------------------------------------------


def test_language_query_is_right_on_held_out_rows(spark, sf_dir):
    rows = QUERIES["op5_language"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_words_are_not_numbers():
    assert [language.normal(t) for t in ("Word,", "1st", "l'eau!", "42", "...", "ÉTÉ")] == ["word", "st", "l'eau", "", "", "été"]
    assert words(random.Random(1), 3)
