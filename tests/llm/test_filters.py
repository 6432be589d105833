"""Near duplicates, line dedup, quality rules, personal data, mixing, pipeline against plain Python."""

import collections
import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scenlens.llm import line_dedup, mixing, near_dup, pii, quality
from scenlens.llm.components import SALTS, _with_least, components
from scenlens.llm.shared import stored
from tests.llm.fixtures import CLASHES, documents, multiset, nothing, odd_rows, prose, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# ---- near duplicates ----------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    """doc_id, set size, component and kept of every row, by comparing all pairs."""
    sets = [shingles(r[1]) if r[0] is not None else frozenset() for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if sets[i]:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    out = collections.Counter()
    for i, r in enumerate(rows):
        component = least[root(i)] if sets[i] else r[0]
        out[r[0], len(shingles(r[1])), component, r[0] is None or component == r[0]] += 1
    return out


COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_of_odd_documents(spark):
    assert found(near_dup.near_duplicates(documents(spark)), *COLUMNS) == brute_components(odd_rows())


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice("abcdefgh")
    return " ".join(w)


def similar_rows():
    """Groups of copies edited more and less, around the threshold, and documents that share a passage."""
    rng, rows = random.Random(11), []
    for size, length in ((70, 60), (12, 300), (9, 12), (5, 7), (6, 1500)):
        base = prose(rng, length)
        rows += [edited(rng, base, rng.randint(0, max(1, length // 25))) for _ in range(size)]
    passage = prose(rng, 60)
    rows += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(60)]
    rows += [" ".join(words(rng, n)) for n in (1, 2, 3, 4, 5, 6) for _ in range(3)] + ["one two", "ONE  two", "one two three"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, t, "en", "a", len(t)) for i, t in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_of_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows = similar_rows()
    assert found(near_dup.near_duplicates(documents(spark, rows)), *COLUMNS) == brute_components(rows)


def test_blocks_of_long_sets_and_shuffled_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 0)
    rows = similar_rows()[::2]
    assert found(near_dup.near_duplicates(documents(spark, rows)), *COLUMNS) == brute_components(rows)


def test_no_documents_have_no_duplicates(spark):
    assert near_dup.near_duplicates(nothing(spark)).count() == 0
    assert near_dup.drop_near_duplicates(nothing(spark)).count() == 0


def test_dropping_near_duplicates_keeps_columns(spark):
    docs = documents(spark)
    got = near_dup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    keep = {r[0] for r, n in brute_components(odd_rows()).items() for r in [r] if r[3]}
    assert multiset(got.collect()) == multiset(r for r in docs.collect() if r["doc_id"] in keep)


def test_rows_of_one_id_are_dropped_by_their_own_text(spark):
    rng = random.Random(8)
    first, second, third = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(1, first, "en", "a", 1), (5, first + " more", "en", "a", 1), (5, second, "en", "a", 1), (5, None, "en", "a", 1),
            (7, third, "en", "a", 1), (7, third, "en", "a", 1), (9, second, "en", "b", 1), (None, third, "en", "a", 1)]
    got = near_dup.drop_near_duplicates(documents(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(
        [(1, first), (5, second), (5, None), (7, third), (7, third), (None, third)])


def test_a_hub_is_spread_over_tasks(spark):
    edges = spark.range(1, 4001).selectExpr("id % 3 + 5000 AS a", "id AS b").unionByName(
        spark.range(3).selectExpr("9000 AS a", "id + 5000 AS b"))
    pairs = edges.selectExpr("a AS u", "b AS v")
    least = {r["u"]: r["m"] for r in _with_least(pairs).select("u", "m").distinct().collect()}
    assert least == {5000: 3, 5001: 1, 5002: 2, 9000: 5000} and _with_least(pairs).count() == edges.count()
    salted = pairs.groupBy("u", (F.xxhash64("v") % SALTS).alias("s")).count().agg(F.max("count")).first()[0]
    assert salted < 4000 / 3 / 16
    assert {r["label"] for r in components(edges).collect()} == {1}


def test_lower_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        near_dup.near_duplicates(nothing(spark), similarity=50)


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)],
    [(random.Random(i).randrange(60), random.Random(i + 999).randrange(60)) for i in range(45)],
])
def test_components(spark, edges):
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    loops = {n for n in label if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: x for n, x in label.items() if n not in loops}


# ---- line dedup ---------------------------------------------------------------------------


def brute_lines(rows, least):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    seen = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    out = collections.Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out[r[0], len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("shard_keys", [line_dedup.SHARD_KEYS, 3])
@pytest.mark.parametrize("least", [2, 10])
def test_common_lines_go(spark, shard_keys, least):
    got = line_dedup.drop_common_lines(documents(spark), least, shard_keys=shard_keys)
    assert found(got, "doc_id", "n_lines", "n_dropped", "text") == brute_lines(odd_rows(), least)
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped", *CLASHES}


@pytest.mark.parametrize("shard_keys", [1000, 37, 2])
def test_several_shards(spark, shard_keys):
    rng = random.Random(2)
    pool = [" ".join(words(rng, 3)) for _ in range(300)]
    rows = [(i, "\n".join(rng.choices(pool, k=20)), "en", "a", 1) for i in range(120)]
    got = line_dedup.drop_common_lines(documents(spark, rows), 9, shard_keys=shard_keys)
    assert found(got, "doc_id", "n_lines", "n_dropped", "text") == brute_lines(rows, 9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_lines_of_more_than_255_documents_are_told_apart(spark):
    rows = [(i, "often\n" + ("less often" if i < 299 else "own"), "en", "a", 1) for i in range(300)]
    got = line_dedup.drop_common_lines(documents(spark, rows), 300)
    assert found(got, "doc_id", "n_lines", "n_dropped", "text") == brute_lines(rows, 300)


def test_a_repeated_task_leaves_the_shard(tmp_path):
    import numpy as np

    keys, counts = np.arange(1, 500, dtype=np.uint64), np.full(499, 7)
    for order in (slice(None), slice(None, None, -1)):
        line_dedup._write_shard(str(tmp_path), 3, line_dedup.Shard.build(keys[order], counts[order]))
        assert [p.name for p in tmp_path.iterdir()] == ["shard-3"]
        line_dedup.open_shard.cache_clear()
        assert (line_dedup.open_shard(str(tmp_path), 3).look_up(keys) == 7).all()
    assert line_dedup.open_shard(str(tmp_path), 4) is None


def test_no_lines(spark):
    assert line_dedup.drop_common_lines(nothing(spark)).count() == 0


def test_shard_knows_its_keys_and_no_others():
    import numpy as np

    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**64, 20_000, np.uint64))
    counts = rng.integers(2, 400, len(keys))
    shard = line_dedup.Shard.of(np.frombuffer(line_dedup.Shard.build(keys, counts).tobytes(), np.uint8))
    assert sorted(shard.slots(keys)) == list(range(len(keys)))  # minimal and perfect
    assert (shard.look_up(keys) == counts).all()
    assert not shard.look_up(np.setdiff1d(rng.integers(0, 2**64, 50_000, np.uint64), keys)).any()


# ---- quality rules -------------------------------------------------------------------------


def brute_counts(text):
    w = WORD.findall(text or "")
    triples = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_counts_and_base_rule(spark):
    got = found(quality.quality_scores(documents(spark)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = collections.Counter()
    for i, t, *_ in odd_rows():
        n = brute_counts(t)
        want[i, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]] += 1
    assert got == want


def test_words_repeated_across_the_text(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 40))), "en", "a", 1) for i in range(60)]
    got = found(quality.quality_scores(documents(spark, rows)), "doc_id", "n_repeat_words")
    assert got == collections.Counter((r[0], brute_counts(r[1])[4]) for r in rows)


def test_sketch_buckets_hold_their_values(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 12_345, 10**9]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality.bucket(F.col("v")))
    tops = {r["v"]: r["top"] for r in df.withColumn("top", quality.bucket_top(F.col("b"))).collect()}
    assert all(v <= tops[v] <= v + v // 32 for v in values)
    assert tops[63] == 63 and tops[0] == 0


def brute_rates(text):
    """The measures of a text, in thousandths."""
    n, t = brute_counts(text), text or ""
    kinds = [unicodedata.category(c) for c in t]
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    letters = sum(k[0] == "L" for k in kinds)
    other = sum(k[0] not in "LMNZ" and not "\t" <= c <= "\r" for k, c in zip(kinds, t, strict=True))
    parts = {
        "other_rate": (other, n[1]), "dup_line_rate": (n[3], lines), "repeat_rate": (n[4], n[0]),
        "caps_rate": (kinds.count("Lu"), letters),
    }
    return {m: 1000 * part // whole if whole else 0 for m, (part, whole) in parts.items()}


def brute_cut(levels):
    """The fence that the sketches of a group, its language and all must give, from their values."""
    top = lambda v: v if v < 64 else ((v >> (v.bit_length() - 6)) + 1 << (v.bit_length() - 6)) - 1
    found = []
    for values in levels:
        if len(values) >= quality.MIN_GROUP:
            values = sorted(values)
            q1, q3 = (top(values[-(-len(values) * q // 4) - 1]) for q in (1, 3))
            found.append((q3, q3 - q1))
    return found[0][0] + int(quality.FENCE * max(s for _, s in found)) if found and found[-1][1] else None


def compare_cuts(spark, rows):
    got = {r["doc_id"]: r for r in quality.quality_scores(documents(spark, rows)).collect()}
    rates = {i: brute_rates(t) for i, t, *_ in rows}
    by_group = collections.defaultdict(list)
    for i, _, lang, source, _ in rows:
        for g in ((lang, source), (lang,), ()):
            by_group[g].append(rates[i])
    for i, _, lang, source, _ in rows:
        over = False
        for m in quality.RATES:
            cut = brute_cut([[r[m] for r in by_group[g]] for g in ((lang, source), (lang,), ())])
            assert (got[i][m], got[i][f"cut_{m}"]) == (rates[i][m], cut)
            over |= cut is not None and rates[i][m] > cut
        assert got[i]["kept"] == (not over and not got[i]["base_failed"])
    return got, by_group


def test_thresholds_come_from_the_group_and_its_levels(spark):
    rng = random.Random(9)

    def marked(share):
        text = [w + ("#" if rng.random() < share else "") for w in words(rng, 80)]
        text = [w.title() if rng.random() < 0.2 else w for w in text]
        return "\n".join([" ".join(text), *[rng.choice(("a b c", "d e")) for _ in range(rng.randint(0, 3))]])

    rows = [(i, marked(0.5 if i % 2 else 0.05), "en", "noisy" if i % 2 else "clean", 1) for i in range(400)]
    rows += [(1000 + i, marked(0.05), "en", "small", 1) for i in range(5)] + [(2000, marked(0.9), "xx", None, 1)]
    rows += [(3000, "ÀÉ e\u0301 \u00a0\u3000 \u0967\u0968 ?!¿ " * 30, "en", "clean", 1)]
    got, by_group = compare_cuts(spark, rows)
    assert {len(by_group[g]) for g in by_group} >= {5, 1, 201, 407}
    assert len({r["cut_other_rate"] for r in got.values()}) > 2


def test_measures_without_spread_reject_nothing(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(words(rng, 60)), "en", "a", 1) for i in range(150)]
    rows += [(500, " ".join(words(rng, 60)).upper(), "en", "a", 1)]
    got, _ = compare_cuts(spark, rows)
    assert all(r["kept"] and r["cut_caps_rate"] is None for r in got.values())


def test_rejected_rows_leave_others_of_their_id_and_text(spark):
    rng = random.Random(12)
    plain = [" ".join(words(rng, 60)) + "?" * rng.randint(0, 9) for _ in range(900)]
    rows = [(i, t if i % 8 else t.replace(" ", "! "), "en", "" if i % 8 else None, 1) for i, t in enumerate(plain)]
    odd = rows[0][1]
    rows += [(900, odd, "en", "", 1), (900, odd, "en", None, 1), (900, odd, "en", None, 1)]
    got = quality.drop_poor(documents(spark, rows)).where("doc_id = 900").select("source").collect()
    assert [r["source"] for r in got] == [None, None]


# ---- personal data -------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def fits(kind, value):
        digits = [int(c) for c in value if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if fits(k, m.group())]


def test_base_spans_match_their_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices("a1.@+-_ ()9é:2 5\n4a@", k=rng.randint(0, 60)))
        assert brute_spans(text) == [(k, a, b) for k in pii.BASE for a, b in pii.find_spans(text)[k]]


def test_long_runs_are_read_once():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1((((" * 50_000, "@" * 300_000, "a@b." * 70_000):
        pii.find_spans(text)


@pytest.mark.parametrize("text, kind, value", [
    ('token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" x', "secret", "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"),
    ("IBAN: DE89 3704 0044 0532 0130 00, thanks", "account", "DE89 3704 0044 0532 0130 00"),
    ("see https://me:secret@host.example/x", "login", "me:secret@host.example"),
])
def test_spans_that_the_method_adds(text, kind, value):
    assert [text[a:b] for a, b in pii.find_spans(text)[kind]] == [value]


@pytest.mark.parametrize("text", ["token of thanks", "account DE89 3704 0044 0532 0130 01", "https://host.example/a:b", "password: short"])
def test_clean_text_has_no_such_spans(text):
    assert not any(pii.find_spans(text).values())


def test_digest(spark):
    rows = [*odd_rows(), (77, "ÄÖ mail a.b@c.example.com or +1 (017) 555-7713, 9807915762804490 İ x@y.z", "en", "a", 1)]
    got = pii.digest(pii.find_pii(documents(spark, rows)))
    want = collections.Counter()
    for i, t, *_ in rows:
        spans = brute_spans(t or "")
        n = collections.Counter(k for k, _, _ in spans)
        sha = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want[i, n["email"], n["ip"], n["card"], n["phone"], sha] += 1
    assert found(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    assert pii.digest(pii.find_pii(nothing(spark))).count() == 0


# ---- mixing --------------------------------------------------------------------------------


def labelled_corpus(spark):
    rng = random.Random(12)
    common = words(rng, 400)
    bad, junk = [f"bad{i}" for i in range(8)], [f"junk{i}" for i in range(8)]
    rows, domains = [], []
    for i in range(600):
        domain = ("good", "good", "good", "low", "toxic")[i % 5]
        w = rng.choices(common, k=rng.randint(60, 200))
        for j in rng.sample(range(len(w)), len(w) // 12):
            w[j] = rng.choice({"good": common, "low": junk, "toxic": bad}[domain])
        rows.append((i, " ".join(w), "en", "a", 1))
        domains.append((rows[-1][1], domain))
    return documents(spark, rows), spark.createDataFrame(domains[:300], "text string, domain string"), dict(enumerate(d for _, d in domains))


def test_rates_bring_domains_to_their_targets(spark):
    docs, labelled, domains = labelled_corpus(spark)
    weights = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    rows = mixing.mixing_rates(docs, labelled, weights).collect()
    assert sum(max(weights, key=lambda d: r[f"p_{d}"]) == domains[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
    reached = {d: sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in rows) for d in weights}
    for d, w in weights.items():
        assert reached[d] / sum(reached.values()) == pytest.approx(w, abs=0.005)
    assert all(r["rate"] >= 0 for r in rows) and max(r["rate"] for r in rows) < 1.05


def plain_rates(data, targets, tolerance):
    """Rates of cells (tokens, m_0, ..., b_0, ...) by the same steps, in numpy; and how many there were."""
    k = len(targets)
    data = np.array(data, float)
    tokens, m, b = data[:, 0], data[:, 1 : 1 + k], data[:, 1 + k :]
    rate = point = np.ones(len(data))
    momentum, against, n = 0, 0.0, 0
    while True:
        off = (point @ m - targets) / m.sum(0)
        new = np.maximum(0, point - (b @ off + mixing.RIDGE * (point - 1)) / (1 + mixing.RIDGE))
        momentum, n = 1 if against > 0 else momentum + 1, n + 1
        against = (tokens * (point - new) * (new - rate)).sum()
        if np.abs(new - point).max() <= tolerance:
            return new, n
        rate, point = new, new + (momentum - 1) / (momentum + 2) * (new - rate)


def soft_cells(spark, sharp):
    """Cells of three domains, one of which holds a thousandth of the tokens, and their targets."""
    rng, data = random.Random(21), []
    for i in range(200):
        e = [math.exp(rng.gauss(0, 1) + sharp * (k == i % 3)) for k in range(3)]
        tokens = rng.randint(1, 1000) * (1 if i % 3 == 2 else 1000)
        b = [x / sum(e) for x in e]
        data.append((tokens, *[tokens * x for x in b], *b))
    columns = "tokens long, m_0 double, m_1 double, m_2 double, b_0 double, b_1 double, b_2 double"
    cells = stored(spark.createDataFrame(data, columns).coalesce(1), "cells")
    own = [sum(c[1 + k] for c in data) for k in range(3)]
    return data, cells, own, [own[0], own[0] / 9, 0.0]


@pytest.mark.parametrize("sharp", [1.0, 4.0])
def test_gradient_steps_settle_where_the_least_is(spark, monkeypatch, sharp):
    monkeypatch.setattr(mixing, "HELD_STEPS", 20)
    data, cells, own, aims = soft_cells(spark, sharp)
    rows = {tuple(r[:7]): r["rate"] for r in mixing.projected_rates(cells, aims).collect()}
    plain, n = plain_rates(data, np.array(aims), mixing.TOLERANCE)
    assert n > 20
    assert [rows[c] for c in data] == pytest.approx(list(plain), abs=1e-5)
    off = [(sum(rows[c] * c[1 + k] for c in data) - aims[k]) / own[k] for k in range(3)]
    slopes = [(rows[c], sum(c[4 + k] * off[k] for k in range(3)) + mixing.RIDGE * (rows[c] - 1)) for c in data]
    assert any(rate == 0 for rate, _ in slopes)
    assert all(abs(slope) < 5e-6 if rate > 0 else slope > -5e-6 for rate, slope in slopes)


def test_few_cells_take_no_job_a_step(spark, monkeypatch):
    """A job a step brings the driver's memory over its limit, as each is planned there."""
    monkeypatch.setattr(mixing, "HELD_STEPS", 8)
    data, cells, _, aims = soft_cells(spark, 1.0)
    context = spark.sparkContext
    context.setJobGroup("few-cells", "steps within a row")
    try:
        few = mixing.projected_rates(cells, aims, 1e-2)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("few-cells"))
    _, n = plain_rates(data, np.array(aims), 1e-2)
    assert n > 30 and 0 < jobs <= 4 + 3 * (n // 8 + 1)
    rows = {tuple(r[:7]): r["rate"] for r in few.collect()}
    many = {tuple(r[:7]): r["rate"] for r in mixing.projected_rates(cells, aims, 1e-2, few=False).collect()}
    assert few.columns == [*cells.columns, "rate"] and rows.keys() == many.keys() == set(data)
    assert [rows[c] for c in data] == pytest.approx([many[c] for c in data], abs=1e-9)


def test_rates_of_no_tokens_stay(spark):
    cells = spark.createDataFrame([(0, 0.0, 0.5), (0, 0.0, 0.1)], "tokens long, m_0 double, b_0 double")
    assert [r["rate"] for r in mixing.projected_rates(cells, [3.0]).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("share", [1e-2, 1e-3, 1e-4])
def test_rates_of_a_rare_domain_settle(spark, monkeypatch, share):
    n = round(10 / share)
    docs = documents(spark, [(1, "good " * (n - 10), "en", "a", 1), (2, "bad " * 10, "en", "a", 1)])
    p = F.when(F.col("text").startswith("good"), 1.0).otherwise(0.0)
    known = docs.select(F.xxhash64("text").alias("key"), F.when(p == 1, n - 10).otherwise(10).cast("long").alias("tokens"),
                        p.alias("p_0"), F.lit(0.0).alias("p_1"), (1 - p).alias("p_2"))
    monkeypatch.setattr(mixing, "posteriors", lambda *_: (known, True))
    weights = {"good": 1.0, "low": 0.0, "toxic": 0.0}
    rates = {r["doc_id"]: r["rate"] for r in mixing.mixing_rates(docs, docs, weights).collect()}
    assert rates[1] == pytest.approx(1.0) and rates[2] < 0.01
    assert [r["doc_id"] for r in mixing.mix(docs, docs, weights, drawn=False).collect()] == [1]


def test_mixing_drops_and_draws(spark):
    docs, labelled, domains = labelled_corpus(spark)
    got = mixing.mix(docs, labelled, {"good": 1.0, "low": 0.0, "toxic": 0.0}, drawn=False)
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in got.collect()}
    good = {i for i, d in domains.items() if d == "good"}
    assert len(kept & good) >= 0.99 * len(good) and len(kept - good) <= 0.05 * (600 - len(good))
    twice = mixing.mix(docs, labelled, {"good": 1.0, "low": 0.0, "toxic": 0.0}, total=2.0 * sum(len(r["text"].split()) for r in docs.collect() if r["doc_id"] in good))
    assert 1.8 * len(good) <= twice.where(F.col("doc_id").isin(sorted(good))).count() <= 2.2 * len(good)


def test_mixing_of_odd_tables(spark):
    none = spark.createDataFrame([], "text string, domain string")
    weights = {"good": 0.9, "low": 0.1}
    docs = documents(spark)
    rows = mixing.mixing_rates(docs, none, weights).collect()
    assert len(rows) == len(odd_rows()) and {r["p_good"] for r in rows} == {0.5}
    assert mixing.mixing_rates(nothing(spark), none, weights).count() == 0
    odd = spark.createDataFrame([(None, "good"), ("word", None), ("", "low"), ("word", "other")], "text string, domain string")
    assert mixing.mix(docs, odd, weights).columns == docs.columns


def test_domains_of_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (None, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 3, 4, 5)], "doc_id long, text string")
    assert multiset(mixing.quality_domains(docs, labels).collect()) == multiset([("t1", "good"), ("t2", "low"), ("t3", "toxic")])


# ---- pipeline ------------------------------------------------------------------------------


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = stored(out, "stage")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {5, 6, 10} <= ids and not ids & {1, 2, 3, 4, 7, 8, 9, 12, 13}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids
    assert multiset(corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()) == multiset(
        packed.drop("sequence_id", "offset").collect())


def test_stages_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    nothing(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
