import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scenlens.llm import packing, token_counts, token_files
from scenlens.llm.tokens import Encoder
from tests.llm.fixtures import documents, nothing, odd_rows

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain(path, special_as_text=False):
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = special_as_text
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


LIBRARY = {(p, s): plain(p, s) for p in (BYTES, WORDS) for s in (False, True)}
ENCODERS = {k: Encoder(*k) for k in LIBRARY}


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("special_as_text", [False, True])
@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from("ab ' \n\t\r\x0b\x1c\x85\xa0É1.<|>é　́İßsdlv日🙂"), max_size=40))
def test_pieces_give_the_ids_of_the_text(path, special_as_text, text):
    ids = np.frombuffer(ENCODERS[path, special_as_text].encode(text), "<u4").tolist()
    assert ids == LIBRARY[path, special_as_text](text)


@pytest.mark.parametrize("text", ["<|endoftext|> a<|endoftext|>b", "it's IT'S we'll don't!", "a  b\n\nc ", "x" * 5000])
def test_special_strings_and_long_runs(text):
    for key, encode in LIBRARY.items():
        assert np.frombuffer(ENCODERS[key].encode(text), "<u4").tolist() == encode(text)


def test_a_full_memo_keeps_the_ids():
    small = Encoder(BYTES)
    small.words.most = small.tails.most = small.heads.most = 4
    rng = random.Random(3)
    for _ in range(50):
        text = " ".join(rng.choices(["one", "two", "three", "four.", "five", "six,", "seven"], k=20))
        assert np.frombuffer(small.encode(text), "<u4").tolist() == LIBRARY[BYTES, False](text)


# ---- token files ------------------------------------------------------------------------


def test_files_round_trip(spark):
    manifest = token_files.write_token_files(documents(spark), WORDS, 2)
    got = [tuple(r) for r in token_files.read_token_files(manifest, with_ids=True).orderBy("start").collect()]
    encode = LIBRARY[WORDS, False]
    want = collections.Counter((i, tuple([*encode(t), 2])) for i, t, *_ in odd_rows())
    assert collections.Counter((r[0], tuple(r[4])) for r in got) == want
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, checksum, ids in got:
        assert (start, n, checksum) == (at, len(ids), crc(ids))
        at += n


def test_files_of_no_documents(spark):
    manifest = token_files.write_token_files(nothing(spark), WORDS, 2)
    assert token_files.read_token_files(manifest).count() == 0
    assert token_counts.token_counts(manifest, 2).count() == 0


def test_ids_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="does not fit"):
        token_files.write_token_files(documents(spark), WORDS, 2, width=1).count()


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_separators_across_blocks(spark, tmp_path, block):
    files = {"a": [9, 9, 1, 2, 9, 3, 4, 5, 6, 7, 8], "b": [1, 2, 3, 9], "c": [9], "d": [1, 2, 3, 4, 5], "e": []}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / f"{name}.ids")
    table = spark.createDataFrame([(str(tmp_path), n, 2, len(i)) for n, i in files.items()], "folder string, name string, width int, n_tokens long")
    got = sorted((r["name"], r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in token_counts.token_counts(table, 9, block).collect())
    want = []
    for name, ids in files.items():
        start, ordinal = 0, 0
        for at, x in enumerate(ids):
            if x == 9 or at == len(ids) - 1:
                want.append((name, ordinal, start, at + 1 - start, x == 9))
                start, ordinal = at + 1, ordinal + 1
    assert got == sorted(want)


def test_counts_match_the_documents(spark):
    manifest = token_files.write_token_files(documents(spark), BYTES, 50256, plain_text=True)
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(manifest, 50256, 100, named=True).collect())
    assert got == collections.Counter((i, len(LIBRARY[BYTES, True](t)) + 1) for i, t, *_ in odd_rows())


# ---- packing ----------------------------------------------------------------------------


def fewest(sizes, capacity):
    """Least number of bins by trying everything."""
    for bins in range(1, len(sizes) + 1):
        seen = {tuple([capacity] * bins)}
        for s in sorted(sizes, reverse=True):
            seen = {tuple(sorted(r[:i] + (r[i] - s,) + r[i + 1 :])) for r in seen for i in range(bins) if r[i] >= s}
        if seen:
            return bins
    return 0


def used(patterns):
    counts = collections.Counter()
    for p in patterns:
        for size, copies in p.items:
            counts[size] += copies * p.count
    return counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_small_packings_are_least(sizes):
    patterns, bound, proven = packing.plan_sequences(collections.Counter(sizes), 20, nodes=5000)
    bins = sum(p.count for p in patterns)
    assert used(patterns) == collections.Counter(sizes) and all(p.size <= 20 for p in patterns)
    assert bound <= bins and bins == fewest(sizes, 20)
    assert proven or bins > bound


def test_search_beats_best_fit():
    rng, better = random.Random(8), 0
    for _ in range(300):
        counts = collections.Counter(rng.randint(15, 60) for _ in range(12))
        greedy = sum(p.count for p in packing.best_fit(counts, 100))
        found = sum(p.count for p in packing.plan_sequences(counts, 100, nodes=3000)[0])
        assert found <= greedy
        better += found < greedy
    assert better


def test_many_pieces_reach_the_bound():
    rng = random.Random(1)
    counts = collections.Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(100_000))
    patterns, bound, _ = packing.plan_sequences(counts, 2048)
    assert used(patterns) == counts and all(p.size <= 2048 for p in patterns)
    assert sum(p.count for p in patterns) <= 1.0005 * bound


def check_packed(rows, docs, encode, end, capacity):
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.defaultdict(list)
    for doc_id, text, *_ in docs:
        ids = [*encode(text), end]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want[doc_id] += [(k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_documents_are_packed(spark, capacity):
    rows = packing.pack_documents(documents(spark), BYTES, 0, capacity).collect()
    n = check_packed(rows, odd_rows(), LIBRARY[BYTES, False], 0, capacity)
    assert n <= -(-sum(r["length"] for r in rows) // capacity) + 1


def test_one_length_over_many_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 3)
    rows = [(i % 7, "word", "en", "a", 4) for i in range(50)]
    got = packing.pack_documents(documents(spark, rows), BYTES, 0, 10).collect()
    check_packed(got, rows, LIBRARY[BYTES, False], 0, 10)


def test_nothing_to_pack(spark):
    assert packing.pack_documents(nothing(spark), BYTES, 0, 16).count() == 0
