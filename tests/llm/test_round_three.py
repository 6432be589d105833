"""Toxicity, lexical search and token alignment against plain Python, and the numbered-word encoder against its library."""

import functools
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenlens.llm import alignment, ball_search, mixing, toxicity
from scenlens.llm.queries import BYTE_VOCABULARY, PIECE_MODEL, QUERIES, WORD_VOCABULARY
from scenlens.llm.tokens import encoder
from tests.llm.fixtures import documents, multiset, nothing, odd_rows, prose, words

# ---- encoding -----------------------------------------------------------------------------

TEXTS = st.text(alphabet=st.sampled_from("abcdeéßñ ÄÖİ.,'\n\t  12!<|>sx×ǅ日́"), max_size=60)


@functools.cache
def library(name, plain):
    out = Tokenizer.from_file(public_tokenizers.path(name))
    out.encode_special_tokens = plain
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_numbered_words_encode_as_the_library_does(texts):
    for name in (BYTE_VOCABULARY, WORD_VOCABULARY):
        for plain in (True, False):
            got = encoder(public_tokenizers.path(name), plain).encode_many(texts)
            want = library(name, plain).encode_batch(texts, add_special_tokens=False)
            assert [g.tolist() for g in got] == [w.ids for w in want]


def test_every_word_of_the_vocabularies_encodes_as_the_library_does(sf_dir, spark):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(200).collect()]
    texts += [None, "", "a" * 3000, " " * 500, "<|endoftext|> is text", *(t for t in (r[1] for r in odd_rows()) if t)]
    for name in (BYTE_VOCABULARY, WORD_VOCABULARY):
        plain = library(name, False)
        texts_and_tokens = texts + [t.replace("Ġ", " ").replace("</w>", "") for t in plain.get_vocab()]
        got = list(encoder(public_tokenizers.path(name)).encode_many(texts_and_tokens))
        want = plain.encode_batch([t or "" for t in texts_and_tokens], add_special_tokens=False)
        assert [g.tolist() for g in got] == [w.ids for w in want]


# ---- lexical search -----------------------------------------------------------------------


def plain_terms(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if now:
                out.append(now)
            now = ""
        else:
            now += c.lower() if c.isascii() else c
    return out


def plain_ranking(docs, items, most):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        wanted, scores = Counter(plain_terms(text)), []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t, k in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i, score))
        scores.sort(key=lambda s: s[:2] + (s[2] or 0,))
        out += [(item, k + 1, s[2], s[3]) for k, s in enumerate(scores[:most])]
    return multiset(out)


def test_search_is_exact_over_odd_documents(spark, monkeypatch):
    rng = random.Random(3)
    rows = odd_rows() + [(1000 + i, prose(rng, 5 + i % 60), "en", "a", 1) for i in range(300)]
    rows += [(2000 + i, rows[40][1], "en", "a", 1) for i in range(60)]  # ties beyond the last place
    docs = [(r[0], r[1]) for r in rows]
    items = [(1, rows[40][1]), (1, rows[40][1]), (1, "another text of item an ber co"), (2, None), (3, ""), (4, "nothing?!"), (None, "an an an ber"),
             (5, rows[5][1]), (6, " ".join(words(rng, 400))), (7, "日本 éa"), (8, "SAME same")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("place", F.lit(2))
    want = plain_ranking(docs, items, 20)
    assert multiset(ball_search.rank(documents(spark, rows), frame).collect()) == want
    # several blocks of items, and small trees
    monkeypatch.setattr(ball_search, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(ball_search, "TREE_ROWS", 50)
    assert multiset(ball_search.rank(documents(spark, rows), frame).collect()) == want


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "an ber")], "item_id long, text string")
    assert ball_search.rank(nothing(spark), items).count() == 0
    assert ball_search.rank(documents(spark), items.limit(0)).count() == 0
    assert ball_search.rank(documents(spark), items.withColumn("text", F.lit("?"))).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    weights = rng.integers(1, 20_000, 200)
    many = rng.integers(1, 30, 2000)
    term = np.concatenate([np.sort(rng.choice(200 if i % 10 == 0 else 40, n, replace=False)) for i, n in enumerate(many)])
    factor = rng.integers(1, 1_000_000, len(term))
    starts = np.concatenate([[0], np.cumsum(many)])
    dense = np.zeros((2000, 200), np.int64)
    dense[np.repeat(np.arange(2000), many), term] = factor
    tree = ball_search.grow(np.arange(2000), starts.copy(), term.copy(), factor.copy(), weights)
    wanted = np.zeros((200, 8), np.int64)
    for j in range(8):
        wanted[rng.choice(np.arange(150, 200) if j < 4 else 200, 10, replace=False), j] = 1
    wanted *= weights[:, None]
    over = ball_search.bounds(tree, wanted.astype(float), weights)
    scores = dense @ wanted
    for (a, b, _, _), bound in zip(tree.nodes, over, strict=True):
        assert (scores[tree.ids[a:b]].max(axis=0) <= bound).all()
    visited = []
    for j in range(8):
        best = ball_search.Best(5)
        visited.append(ball_search.search(tree, over[:, j], wanted[:, j], best))
        order = np.lexsort((np.arange(2000), -scores[:, j]))[:5]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order, j].tolist()
    leaves = (tree.nodes[:, 2] < 0).sum()
    assert min(visited) < leaves


# ---- alignment ----------------------------------------------------------------------------


def plain_alignment(texts):
    first, second = library(BYTE_VOCABULARY, True), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    rows, counts = [], Counter()
    for text in texts:
        none = (0, 0, 0, "", [])
        if not text:
            rows.append(none)
            continue
        a = [(t, bytes(letters[c] for c in first.id_to_token(t))) for t in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for t in second.encode(text):
            p = second.id_to_piece(t)
            b.append((t, bytes([int(p[3:5], 16)]) if second.is_byte(t) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append(none)
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        groups, links, lo = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            hi = [ends[k].index(e) + 1 for k in (0, 1)]
            groups.append("|".join(",".join(str(t) for t, _ in side[lo[k] : hi[k]]) for k, side in enumerate((a, b))))
            links.append((a[hi[0] - 1][0], b[hi[1] - 1][0]))
            lo = hi
        counts.update(links)
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(na, nb, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest)
            for na, nb, g, digest, links in rows]


def test_alignment_over_odd_documents(spark, sf_dir, monkeypatch):
    given_rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    rows = odd_rows() + given_rows + [
        (3000, "<|endoftext|> <s> </s> <unk> is text", None, None, 1), (3001, "under▁score", None, None, 1), (3002, " two  spaces ", None, None, 1),
        (3003, "\t\ttabs\r\n", None, None, 1), (3004, "日本語のテキスト", None, None, 1), (3005, "a" * 2000, None, None, 1), (3006, "🙂🙂é", None, None, 1)]
    paths = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_MODEL)
    want = multiset([(r[0], *x) for r, x in zip(rows, plain_alignment([r[1] for r in rows]), strict=True)])
    assert multiset(alignment.cross_tokenizer_alignment(documents(spark, rows), *paths).collect()) == want
    monkeypatch.setattr(alignment, "SHARD_PAIRS", 97)
    assert multiset(alignment.cross_tokenizer_alignment(documents(spark, rows), *paths).collect()) == want


def test_alignment_of_nothing(spark):
    paths = public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_MODEL)
    assert alignment.cross_tokenizer_alignment(nothing(spark), *paths).count() == 0


def test_pointers_reach_the_end_of_long_chains():
    # tokens that overlap like bricks: one group however long
    n = 5000
    a, b = np.r_[np.arange(2, 2 * n + 1, 2)], np.r_[np.arange(1, 2 * n, 2), 2 * n]
    last_a, last_b = alignment.last_tokens(a, b)
    assert (last_a == n - 1).all() and (last_b == n - 1).all()


# ---- toxicity -----------------------------------------------------------------------------


def insulting(rng, text):
    out = text.split()
    for _ in range(max(1, len(out) // 25)):
        out.insert(rng.randrange(len(out)), rng.choice(("zzwretch", "qqvermin", "xxgrubby")))
    return " ".join(out)


def labelled_corpus(spark, n=1500):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        text, toxic = prose(rng, rng.randint(20, 120)), i % 5 == 0
        rows.append((insulting(rng, text) if toxic else text, int(toxic)))
    return rows


def test_toxic_texts_are_told_apart(spark):
    rows = labelled_corpus(spark)
    train = spark.createDataFrame(rows[:1000] + [(None, 1), ("no label", None)], "text string, toxic int")
    model = toxicity.train(train)
    docs = documents(spark, [(i, t, None, None, y) for i, (t, y) in enumerate(rows[1000:])])
    got = {r["doc_id"]: r for r in toxicity.score_texts(docs, model).collect()}
    hits = [got[i]["predicted"] == y for i, (_, y) in enumerate(rows[1000:])]
    assert sum(hits) >= 0.9 * len(hits)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    # the same rows in another order and dealing teach the same
    again = toxicity.train(train.repartition(7).orderBy(F.desc("text")))
    assert again.toxic == model.toxic and again.ordinary == model.ordinary and np.allclose(again.weights, model.weights)
    # a plain count of every window, one compression each
    coder, text = toxicity.Coder(), rows[1000][0]
    codes, pair = coder.words(text), (toxicity.Compressor(model.ordinary).zstd, toxicity.Compressor(model.toxic).zstd)
    away = [len(pair[0].compress(w)) - len(pair[1].compress(w)) for w in (b"".join(codes[i : i + 3]) for i in range(len(codes) - 2))]
    assert next(model.distances([text], coder)).tolist() == away
    score = model.scores(np.array([[sum(x > t for x in away) for t in model.thresholds]]), np.array([len(away)]))[0]
    assert abs(score - got[0]["score"]) < 1e-12


def test_toxicity_of_odd_documents(spark):
    model = toxicity.train(spark.createDataFrame(labelled_corpus(spark, 400), "text string, toxic int"))
    rows = toxicity.score_texts(documents(spark), model).collect()
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(r[0]) for r in odd_rows())
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_texts(nothing(spark), model).count() == 0
    for some, score in (([("one label", 0)], 0.0), ([("one label", 1)], 1.0), ([], 0.0)):
        one = toxicity.train(spark.createDataFrame(some, "text string, toxic int"))
        assert {round(r["score"], 9) for r in toxicity.score_texts(documents(spark), one).collect()} == {score}


def plain_code(word):
    word = word.strip(b".,;:!?\"'()[]|") or word
    sums, code = [], 0
    for i in range(len(word)):
        code = zlib.crc32(word[i : i + 1], code)
        sums.append((code & 0xFFFF).to_bytes(2, "little"))
    assert len(word) > 100 or code == zlib.crc32(word)
    return b"".join(sums)


def plain_distances(model, text):
    codes = [plain_code(w) for w in (text or "").encode().lower().split()]
    pair = toxicity.Compressor(model.ordinary).zstd, toxicity.Compressor(model.toxic).zstd
    parts = [b"".join(codes[i : i + 3]) for i in range(max(1, len(codes) - 2))] if codes else []
    return [len(pair[0].compress(p)) - len(pair[1].compress(p)) for p in parts]


def test_every_word_of_a_text_begins_a_window_however_long_it_is(spark):
    model = toxicity.train(spark.createDataFrame(labelled_corpus(spark, 600), "text string, toxic int"))
    rng = random.Random(4)
    texts = [insulting(rng, prose(rng, n)) for n in (300, 318, 319, 320, 321, 322, 700, 3001)]
    # windows of a hundred kilobytes and more, of bytes that no dictionary has; texts of less than a window
    texts += [None, "", " \t ", "one", "one two", "a " + "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(40_000)) + " b c", texts[-1]]
    expected = [plain_distances(model, t) for t in texts]
    assert [d.tolist() for d in model.distances(texts, toxicity.Coder())] == expected
    counts, number = (np.concatenate(x) for x in zip(*model.counts(texts, toxicity.Coder()), strict=True))
    over = [[sum(x > t for x in d) for t in model.thresholds] for d in expected]
    assert counts.tolist() == over and number.tolist() == [len(d) for d in expected]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], model.scores(np.array(over), np.array([len(d) for d in expected])), atol=1e-12)


def test_words_are_coded_as_one_by_one():
    rng = random.Random(5)
    texts = [None, "", "...", "(a) b. c!", "!!!a a!!! !a!", "\x1c x\x0by\x0cz\xa0w", "É!É ß", "|" * 300 + " q", "x y " + "ab" * 3000 + " z"]
    texts += ["".join(rng.choice("abC.,! \n\té日") for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    plain = [[plain_code(w) for w in (t or "").encode().lower().split()] for t in texts]
    coder = toxicity.Coder()
    assert [coder.words(t) for t in texts] == plain
    coded = coder.texts(texts)
    assert coded.data == b"".join(map(b"".join, plain)) and coded.words.tolist() == [len(p) for p in plain]
    assert coded.sizes.tolist() == [len(w) for p in plain for w in p]
    # a chunk ends after the text that fills it; texts before and after are coded alike
    assert [t for chunk in toxicity.chunks(iter(texts)) for t in chunk] == texts


def test_held_out_toxicity_of_the_given_table(spark, sf_dir):
    big = sf_dir.replace("sf0.01", "sf0.1")
    rows = QUERIES["op11_toxicity"](spark, big).join(spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    got = rows.select("toxic", "score").collect()
    bad, good = ([r["score"] for r in got if r["toxic"] == k] for k in (1, 0))
    above = sum((b > g) + (b == g) / 2 for b in bad for g in good)
    assert above / len(bad) / len(good) > 0.85


# ---- mixing -------------------------------------------------------------------------------


def test_no_text_is_split_again_for_each_of_its_words(spark):
    labelled = spark.createDataFrame([("good words here", "good"), ("low words there", "low")], "text string, domain string")
    by_text, _ = mixing.posteriors(documents(spark), labelled, ["good", "low"])
    lines = by_text._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert not any("split(" in line for line in lines[: at + 1])
