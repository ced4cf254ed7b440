"""Operators of the optional subpackage: brute force, round trips, held-out accuracy, and awkward input."""

from __future__ import annotations

import os
import random
import time
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from hypothesis import given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flockwise.llm import garbled, language, leaks, packing, similar, terms, topn
from flockwise.llm import queries as Q


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 1 language


@pytest.fixture(scope="module")
def pieces():
    return language.load_pieces()


def test_forward_sums_all_segmentations(pieces):
    few = {b" ": 0, b"a": 1, b"b": 2, b" a": 3, b"ab": 4, b" ab": 5}
    probs = np.array([[0.1], [0.2], [0.3], [0.05], [0.25], [0.1], [0.0]])
    # " a b": each piece alone; " a"+b; " "+ab; " ab"
    want = 0.1 * 0.2 * 0.3 + 0.05 * 0.3 + 0.1 * 0.25 + 0.1
    assert language.Lattices(["ab"], few).forward(probs)[0, 0] == pytest.approx(np.log(want))
    counts = language.Lattices(["ab"], few).expected(probs, np.array([0]), np.array([2.0]))
    assert counts[5, 0] == pytest.approx(2 * 0.1 / want) and counts[2, 0] == pytest.approx(2 * (0.1 * 0.2 * 0.3 + 0.05 * 0.3) / want)


TEXTS = {
    "en": "the cat sat in the window of the library and nobody noticed it. we walked to the old harbour before breakfast.",
    "de": "die katze sitzt im fenster der bücherei und niemand hat es gemerkt. wir sind vor dem frühstück zum hafen gelaufen.",
    "fr": "le chat est assis à la fenêtre de la bibliothèque et personne ne le voit. nous avons marché avant le petit déjeuner.",
}


def test_languages_and_cases(spark, small):
    train = spark.createDataFrame([(i, c, t, 0) for i, (c, t) in enumerate(TEXTS.items())], "id long, label string, text string, lang int")
    data = [
        (10, "en", "The cat walked to the harbour before breakfast."), (11, None, "Die Katze sitzt im Fenster der Bücherei."),
            (12, "FR", "we walked to the old library."), (13, "eng", "We walked to the library."),
        (14, "de-AT", "Die Katze sitzt im Fenster. Nous avons marché à la bibliothèque."), (15, "xx", "@ann https://x.test/the/cat #cat 12"), (16, None, None),
            (17, None, ""), (18, None, "Guten Tag"), (19, "de", "DIE KATZE SITZT IM FENSTER DER BUCHEREI"),
    ]
    df = spark.createDataFrame(data, "id long, label string, text string").withColumn("language", F.lit(1)).withColumn("segments", F.lit("x"))
    found = language.languages(df, "id", "text", "label", training=train)
    by = {r["id"]: r for r in found.collect()}
    assert len(by) == len(data) and by[10]["language"] == "en" and by[19]["language"] == "de" and all(by[i]["language"] is None for i in (15, 16, 17, 18))
    assert [s["lang"] for s in by[14]["segments"]] == ["de", "fr"] and 0 < by[14]["confidence"] <= 1
    assert rows(language.label_cases(found, "id")) == [(11, "de"), (12, "en"), (14, "de"), (14, "fr")]
    assert language.languages(df.limit(0), "id", "text", "label", training=train).count() == 0
    blind = language.languages(df, "id", "text", "label", training=train.limit(0)).collect()
    assert all(r["confidence"] is None or r["confidence"] < 0.2 for r in blind)


def test_held_out_accuracy(spark, pieces):
    path = "/root/testdata/sf0.01/statuses.parquet"
    data = duckdb.sql(f"SELECT language, max(text) FROM '{path}' WHERE language IN ('en','de','fr','es','pt','it','nl','sv','pl','ru','ja') AND length(text) > 30 GROUP BY id, language ORDER BY id").fetchall()
    random.Random(5).shuffle(data)
    half = len(data) // 2
    probs = language.fit(data[:half], pieces)
    found = language.Scorer(pieces, probs).segments([t for _, t in data[half:]])
    hit = sum(bool(s) and language.LANGUAGES[max(s, key=lambda x: x[3])[0]] == c for (c, _), s in zip(data[half:], found))
    assert hit / (len(data) - half) > 0.9  # about one label in twenty is wrong


def labelled(n=4000):
    path = "/root/testdata/sf0.01/statuses.parquet"
    data = duckdb.sql(f"SELECT language, max(text) FROM '{path}' WHERE language IN ('en','de','fr','es','pt','it','nl','sv','pl','ru','ja') AND length(text) > 30 GROUP BY id, language ORDER BY id").fetchall()
    random.Random(6).shuffle(data)
    return data[:n]


def test_text_of_no_known_language(pieces):
    data = labelled()
    probs = language.fit(data, pieces)
    scorer = language.Scorer(pieces, probs, language.floors(data, pieces, probs))
    foreign = [
        "Minä pidän kirjojen lukemisesta illalla kun ulkona sataa vettä.", "Akşamları dışarıda yağmur yağarken kitap okumayı seviyorum.",
            "Večer rád čtu knihy, když venku prší a fouká vítr.", "Îmi place să citesc cărți seara când afară plouă.",
        "Μου αρέσει να διαβάζω βιβλία το βράδυ όταν βρέχει.", "أحب قراءة الكتب في المساء عندما تمطر", "저녁에 비가 올 때 책 읽는 것을 좋아합니다", "Tôi thích đọc sách vào buổi tối khi trời mưa.",
    ]
    assert [[x[0] for x in s] for s in scorer.segments(foreign)] == [[-1]] * len(foreign)
    known = scorer.segments([t for _, t in data])
    assert sum(any(x[0] < 0 for x in s) for s in known) <= 0.001 * len(data)


def test_confidence_is_calibrated(pieces):
    data = labelled()
    half = len(data) // 2
    probs = language.fit(data[:half], pieces)
    hit, sure = [], []
    for (c, t), s in zip(data[half:], language.Scorer(pieces, probs, language.floors(data[:half], pieces, probs)).segments([t for _, t in data[half:]])):
        if len(s) == 1:
            hit.append(language.LANGUAGES[s[0][0]] == c)
            sure.append(s[0][1])
    # about one label in twenty is wrong, and no confidence can tell
    assert abs(np.mean(sure) - np.mean(hit)) < 0.08 and np.mean(sure) > 0.95


def test_words_of_any_length_are_summed_whole(pieces):
    word = "ながいことば" * 40  # far beyond a stretch of any fixed size
    probs = np.full((len(pieces) + 1, 2), 1e-4)
    probs[-1] = 0
    raw = b" " + word.encode()
    logs = [0.0] + [-np.inf] * len(raw)
    for e in range(1, len(raw) + 1):
        for a in range(max(0, e - 40), e):
            if raw[a:e] in pieces:
                logs[e] = np.logaddexp(logs[e], logs[a] + np.log(1e-4))
    got = language.Lattices(["kurz", word, "x"], pieces).forward(probs)
    assert got[1, 0] == pytest.approx(logs[-1]) and got[1, 1] == pytest.approx(logs[-1])
    long = language.word_scores(["a" * 100_000], pieces, probs)
    assert np.isfinite(long).all() and long[0, 0] < -1000


def test_label_notations(spark):
    labels = ["en", "EN", "en-US", "en_GB", "eng", " de ", "xx", "und", "", " ", None, "??", "unknown", "jpn"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(language.label_language(F.col("l"))).collect()]
    assert got == ["en", "en", "en", "en", "en", "de", None, None, None, None, None, None, None, "ja"]


# 2 vectors


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r], "dup") for i, r in zip(ids if ids is not None else range(1, len(x) + 1), x)],
        "id long, embedding array<float>, v string")


def brute(x, k, least):
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    out = set()
    for n in range(len(x)):
        order = np.lexsort((np.arange(len(x)), -s[n]))[:k]
        out |= {(n + 1, int(j) + 1) for j in order if s[n, j] >= least}
    return out


def clustered(n=600, seed=1, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 64)) * noise
    x[::3] = rng.normal(size=(len(x[::3]), 64))
    return x * rng.uniform(0.1, 50, (n, 1))


def test_pairs_match_brute_force(spark):
    x = clustered()
    got = {(r["id"], r["other"]) for r in similar.similar(vectors(spark, x), "id", "embedding", 10, least=0.9).collect()}
    want = brute(x, 10, 0.9)
    assert len(got & want) >= 0.99 * len(want) and got <= want | got and len(got - want) <= 0.01 * len(want)


def test_recall_without_least_similarity(spark):
    x = clustered(900, 2, 0.6)
    got = {(r["id"], r["other"]) for r in similar.similar(vectors(spark, x), "id", "embedding", 10, asks=lambda c: c % 3 == 0).collect()}
    want = {p for p in brute(x, 10, -1) if p[0] % 3 == 0}
    assert len(got & want) >= 0.9 * len(want) and {a for a, _ in got} == {a for a, _ in want}


def test_regions_and_parts_lose_nothing(spark, monkeypatch):
    x = clustered(500, 3)
    monkeypatch.setattr(similar, "REGION_ROWS", 40)
    got = {(r["id"], r["other"]) for r in similar.similar(vectors(spark, x), "id", "embedding", 5, least=0.9).collect()}
    want = brute(x, 5, 0.9)
    assert len(got ^ want) <= 0.02 * len(want)


def test_regions_are_filled_in_passes(spark, monkeypatch):
    x, cut, cuts, roots = clustered(500, 3), similar.Scratch.cut, [], set()
    for name, value in (("REGION_ROWS", 20), ("CERTAIN_ROWS", 100), ("PASS_ROWS", 0.5)):
        monkeypatch.setattr(similar, name, value)

    def noted(self, df, name, free=False):
        cuts.append((name, free))
        roots.add(self.root)
        return cut(self, df, name, free)

    monkeypatch.setattr(similar.Scratch, "cut", noted)
    got = {(r["id"], r["other"]) for r in similar.similar(vectors(spark, x), "id", "embedding", 5, least=0.9).collect()}
    assert len(got ^ brute(x, 5, 0.9)) <= 0.02 * len(got)
    assert sum(name.startswith("near") for name, _ in cuts) >= 2 and all(free for _, free in cuts)
    assert not any(os.path.exists(root.removeprefix("file:")) for root in roots)


def test_shuffles_of_a_pass_are_deleted(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: "".join(f.getName() + " " for f in (files.getAllFiles().apply(n) for n in range(files.getAllFiles().size()))).count("shuffle_")
    scratch, before = similar.Scratch(spark), held()
    scratch.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "t", True)
    for _ in range(20):
        if held() > before:
            time.sleep(0.25)
    scratch.drop()
    assert held() <= before


def test_few_sectors_lie_near_a_vector():
    x = np.random.default_rng(5).normal(size=(20_000, 64)) + 2 * np.random.default_rng(6).normal(size=(24, 64))[np.arange(20_000) % 24]
    sectors = similar.Sectors(x[:16_384], 1_000_000, 64, similar.REGION_ROWS)
    first, _ = similar.measured_radii(sectors, x[:4096], 1_000_000, 0.9, similar.SPREAD)
    assert len(sectors.centres) >= 24 and (sectors.distances(similar.unit(x[16_384:]))[0] <= first).sum(1).mean() < 4


def test_codebooks_grow_and_nothing_is_kept_for_each_cell():
    sample = np.random.default_rng(1).normal(size=(3000, 64)).astype(np.float32)
    index = similar.MultiIndex(sample, 4_000_000, 64, 1.0)
    assert min(index.sizes) > 512 and index.region.size == index.groups[0] * index.groups[1] <= 1024 and index.region.max() + 1 >= 40
    u = similar.unit(sample[:200])
    away = index.distances(u, False)
    radii = index.radii(away, 0.05)
    own = index.place(u)
    inside = [(away[0][n][index.sample[0]] + away[1][n][index.sample[1]] <= radii[n]).mean() for n in range(200)]
    assert np.allclose(inside, 0.05, atol=0.002)
    for n, met in enumerate(index.regions(away, radii)):  # every cell within the radius is in a region met
        sums = away[0][n][:, None] + away[1][n][None]
        i, j = np.nonzero(sums <= radii[n])
        assert set(index.region[index.group[0][i] * index.groups[1] + index.group[1][j]].tolist()) == set(met)
        assert index.region[index.group[0][own[0][n]] * index.groups[1] + index.group[1][own[1][n]]] in met


def test_pairs_of_few_directions_match_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 8)) @ rng.normal(size=(8, 64))
    got = [(r["id"], r["other"]) for r in similar.similar(vectors(spark, x), "id", "embedding", 10, least=0.9).collect()]
    want = brute(x, 10, 0.9)
    assert len(got) == len(set(got)) and len(set(got) & want) >= 0.99 * len(want) and len(set(got) - want) <= 0.01 * len(want)


def test_copies_nulls_and_empty_vectors(spark):
    one, two = [1.0] * 64, [-1.0] * 64
    data = [(i, one) for i in range(1, 31)] + [(40, two), (41, [x * 2 for x in two]), (50, None), (51, [0.0] * 64), (52, [float("nan")] * 64), (53, one[:63]),
        (54, [None, *one[1:]]), (55, [float("inf"), *one[1:]]), (1, one), (None, one)]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(similar.similar(df, "id", "embedding", 10, least=0.9).collect(), key=lambda r: r["rank"]):
        got[r["id"]].append(r["other"])
    assert set(got) == {*range(1, 31), 40, 41} and got[30] == list(range(1, 11)) and got[3] == [1, 2, *range(4, 12)] and got[40] == [41] and got[41] == [40]
    assert similar.similar(df.limit(0), "id", "embedding", 10, least=0.9).count() == 0 and similar.similar(df.limit(0), "id", "embedding", 10).count() == 0


def test_copies_are_found_by_others(spark):
    rng = np.random.default_rng(4)
    base, few = rng.normal(size=64), rng.normal(size=64)
    x = np.stack([*[base] * 14, base + 0.1 * rng.normal(size=64), base + 0.15 * rng.normal(size=64), *[few] * 4, few + 0.1 * rng.normal(size=64), *rng.normal(size=(9, 64))])
    x = x[rng.permutation(len(x))]
    pairs = {(r["id"], r["other"]) for r in similar.similar(vectors(spark, x), "id", "embedding", 10, least=0.9).collect()}
    nearest = {(r["id"], r["other"]) for r in similar.similar(vectors(spark, x), "id", "embedding", 10, asks=lambda c: c % 2 == 0, share=1.0).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T).round(9)  # equal vectors are equally near
    np.fill_diagonal(s, -9)
    best = {n + 1: [int(j) for j in np.lexsort((np.arange(len(x)), -s[n]))[:10]] for n in range(len(x))}
    assert pairs == {(n, j + 1) for n, b in best.items() for j in b if s[n - 1, j] >= 0.9}
    assert nearest == {(n, j + 1) for n, b in best.items() for j in b if n % 2 == 0}


@hypothesis_settings(max_examples=40, deadline=None)
@given(a=st.lists(st.floats(0, 9), max_size=8), b=st.lists(st.floats(0, 9), max_size=8), r=st.floats(0, 18))
def test_walk_is_in_order_and_complete(a, b, r):
    a, b = sorted(a), sorted(b)
    got = list(similar.walk(a, b, r))
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= r} and len(set(got)) == len(got)


# 3 top n


def test_top_n_matches_brute_force(spark):
    rng = random.Random(7)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    data = [(1 if rng.random() < 0.4 else rng.choice([None, *range(2, 40)]), rng.choice([None, *range(60)]),
        rng.choice(odd) if rng.random() < 0.1 else rng.choice([0.0, -0.0, 1.5, 2.5, rng.random()])) for _ in range(4000)]
    df = spark.createDataFrame(data, "viewer long, post long, score double").withColumn("rank", F.lit("x"))
    best = {}
    for v, p, s in data:
        if v is not None and p is not None and s is not None and np.isfinite(s):
            best[v, p] = max(best.get((v, p), -9e9), s)
    groups = defaultdict(list)
    for (v, p), s in best.items():
        groups[v].append((s + 0.0, p))
    want = sorted((v, p, s, n) for v, g in groups.items() for n, (s, p) in enumerate(sorted(g, reverse=True)[:10], 1))
    assert rows(topn.top_n_per_group(df, "viewer", "post", "score", 10)) == want
    assert rows(topn.top_n_per_group(df, "viewer", "post", "score", 10, step_rows=50, most_rows=100)) == want
    named = df.withColumn("post", F.lpad(F.col("post").cast("string"), 3, "0"))
    assert [(v, int(p), s, n) for v, p, s, n in rows(topn.top_n_per_group(named, "viewer", "post", "score", 10))] == want
    assert topn.top_n_per_group(df.limit(0), "viewer", "post", "score", 10).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, "viewer", "post", "score", 0)


# 5 terms


@hypothesis_settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_terms_are_runs_of_letters_marks_and_digits(t):
    want = regex.findall(r"[\p{L}\p{M}\p{N}]+", unicodedata.normalize("NFKC", t).lower())
    assert terms.terms_of(t) == want


def test_term_counts_match_brute_force(spark):
    rng = random.Random(3)
    words = ["Der", "der", "ﬁn", "fin", "x2", "é", "é", "日本", "a-b", "🎉"]
    texts = [None, "", "  "] + [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(300)] + ["hot " * 20_000]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, term string")
    occ, rec = Counter(), Counter()
    for t in texts:
        found = terms.terms_of(t)
        occ.update(found)
        rec.update(set(found))
    want = sorted((t, occ[t], rec[t]) for t in occ)
    assert rows(terms.term_counts(df, "text")) == want == rows(terms.term_counts(df, "text", max_terms=3))
    total = df.agg(F.count("*").alias("n"))
    marks = {r["term"]: r["mark"] for r in terms.marked(terms.term_counts(df, "text"), total, 2, 0.05).collect()}
    assert marks["hot"] == "rare" and marks["der"] == "common"
    assert terms.term_counts(df.limit(0), "text").count() == 0


# 6 packing


def check_packing(spark, data, budgets, **more):
    df = spark.createDataFrame(data, "doc long, text string, source string, size int")
    placed = packing.pack_texts(df, "doc", "text", "source", budgets, **more).collect()
    sizes = {d: len(t.encode()) for d, t, _, _ in data if t}
    for b, capacity in budgets:
        got, filled = defaultdict(list), Counter()
        for r in placed:
            if r["budget_id"] == b:
                got[r["id"]].append((r["start"], r["size"]))
                filled[r["container"]] += r["size"]
        assert set(got) == set(sizes)
        for d, parts in got.items():
            at = 0
            for start, size in sorted(parts):
                assert start == at and 0 < size <= capacity
                at += size
            assert at == sizes[d] and (len(parts) == 1 or sizes[d] > capacity)
        assert max(filled.values()) <= capacity
        yield b, capacity, filled, placed


def texts(n, seed=1, sources=("a", "b", "c", None)):
    rng = random.Random(seed)
    return [(i, "é" * rng.randint(1, 30) + "x" * rng.randint(0, 300), rng.choices(sources, [6, 3, 2, 1][: len(sources)])[0], 0) for i in range(n)]


def test_packing_is_whole_and_tight(spark):
    data = [*texts(800), (9000, None, "a", 0), (9001, "", "a", 0), (9002, "y" * 5001, "b", 0), (9003, "z" * 1024, "b", 0)]
    for _, capacity, filled, _ in check_packing(spark, data, [(1, 1024), (2, 4096), (3, 50)], partition_tokens=30_000):
        least = -(-sum(filled.values()) // capacity)
        assert len(filled) <= least * (1.02 if capacity > 100 else 3) + 2


def test_packing_edge_cases(spark):
    df = spark.createDataFrame([], "doc long, text string, source string")
    assert packing.pack_texts(df, "doc", "text", "source", [(1, 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack_texts(df, "doc", "text", "source", [(1, 0)])
    list(check_packing(spark, [(1, "abc", "a", 0), (2, "abcdefghij", None, 0), (3, "a" * 30, "a", 0)], [(1, 10)]))


def test_mixture_follows_the_shares():
    rng = random.Random(2)
    sources = ["a"] * 3000 + ["b"] * 1000
    sizes = [rng.randint(20, 400) for _ in sources]
    total = sum(sizes)
    target = {s: sum(z for x, z in zip(sources, sizes) if x == s) / total for s in "ab"}
    container = packing.pack(sources, sizes, 4096, target, {})
    share = defaultdict(Counter)
    for c, s, z in zip(container, sources, sizes):
        share[c][s] += z
    windows = [share[c]["a"] / sum(share[c].values()) for c in sorted(share)][:-5]
    assert np.mean(windows) == pytest.approx(target["a"], abs=0.03) and np.std(windows) < 0.08


def test_carry_shifts_the_first_windows():
    sources, sizes = ["a", "b"] * 50, [100] * 100
    plain = packing.pack(sources, sizes, 400, {"a": 0.5, "b": 0.5}, {})
    behind = packing.pack(sources, sizes, 400, {"a": 0.5, "b": 0.5}, {"a": 400.0, "b": -400.0})
    first = lambda c: Counter(s for s, x in zip(sources, c) if x == 0)
    assert first(plain) == {"a": 2, "b": 2} and first(behind) == {"a": 4}


def distances(container, sources, sizes, target):
    held = defaultdict(Counter)
    for c, s, z in zip(container, sources, sizes):
        held[c][s] += z
    return [sum(max(0, z / sum(h.values()) - target[s]) for s, z in h.items()) for h in held.values()]


@pytest.mark.parametrize("capacity", [1024, 4096, 16384])
def test_windows_are_nearer_the_mixture_than_a_random_order(capacity):
    data = duckdb.sql("SELECT coalesce(source, ''), strlen(text) FROM '/root/testdata/sf0.1/documents.parquet' WHERE strlen(text) > 0 ORDER BY hash(doc_id)").fetchall()
    sources, sizes = [s for s, _ in data], [z % capacity or capacity for _, z in data]
    target = Counter()
    for s, z in zip(sources, sizes):
        target[s] += z / sum(sizes)
    container = packing.pack(sources, sizes, capacity, target, {})
    order, room, n = [], capacity, 0
    for z in sizes:
        n, room = (n, room - z) if z <= room else (n + 1, capacity - z)
        order.append(n)
    own, other = distances(container, sources, sizes, target), distances(order, sources, sizes, target)
    assert np.mean(own) < np.mean(other) and np.quantile(own, 0.9) < np.quantile(other, 0.9) and sum(sizes) / ((max(container) + 1) * capacity) > 0.99


def test_sums_before_go_in_levels(spark):
    rng = random.Random(4)
    data = [(k, a, rng.randint(0, 9)) for k in "xy" for a in sorted(rng.sample(range(200), 150))]
    df = spark.createDataFrame(data, "k string, at long, v long")
    for keys, radix in ((["k"], 4), (["k"], 1000)):
        got = {(r["k"], r["at"]): r["before"] for r in packing.sums_before(df, keys, "at", "v", 200, radix).collect()}
        assert got == {(k, a): sum(v for k2, a2, v in data if k2 == k and a2 < a) for k, a, _ in data}


def test_copies_of_a_large_text_and_tiny_capacities(spark):
    data = [(1, "a" * 70, "s", 0), (2, "b" * 70, "s", 0), (3, "c" * 5, "t", 0), (4, "d", "t", 0)]
    for _, capacity, filled, placed in check_packing(spark, data, [(1, 7), (2, 1), (3, 64)], partition_tokens=8):
        assert sum(filled.values()) == 146
    twice = spark.createDataFrame([(1, "a" * 70, "s")] * 2, "doc long, text string, source string")
    held = Counter()
    for r in packing.pack_texts(twice, "doc", "text", "source", [(1, 7)]).collect():
        held[r["container"]] += r["size"]
    assert len(held) == 20 and set(held.values()) == {7}


def test_report_tells_the_mixture(spark):
    df = spark.createDataFrame([(i, "x" * 10, "ab"[i % 2]) for i in range(80)], "doc long, text string, source string")
    r = packing.packing_report(packing.pack_texts(df, "doc", "text", "source", [(1, 40)])).first()
    assert (r["containers"], r["used"], r["pieces"]) == (20, 1.0, 80) and r["mean_distance"] < 0.05


# 7 leaks

PASSAGE = "Hardly anyone in Daskultik knew why eight hundred clerks followed the hesitant cheese exchange after burning the reports on the left-handed index near Walist, and the jury of Valtlanholm ruled against the blue-striped charter."


def leak_rows(spark, documents, passages, **more):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(documents)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(i, p) for i, p in enumerate(passages)], "item_id long, passage string")
    return rows(leaks.leaks(docs, "doc_id", "text", items, "item_id", "passage", **more))


def test_leaks_by_length_and_errors(spark):
    w = PASSAGE.split()
    part = lambda a, n: " ".join(w[a : a + n])
    wrong = lambda ws, *at: " ".join("zebra" if i in at else x for i, x in enumerate(ws))
    documents = [
        PASSAGE, part(3, 15), part(3, 12), wrong(w[:15], 4, 9), wrong(w[:15], 3, 7, 11), "intro text here " + part(5, 16).upper() + " and more",
            part(2, 17).replace("e", "é"), "<p>" + part(0, 8) + "<br/><b>" + part(8, 9) + "</b></p>",
        part(4, 18).encode().decode("cp1252"), "​".join(part(0, 15)), None, "", "nothing of it", "> " + part(0, 8) + "\n> " + part(8, 9),
            " ".join(x for i, x in enumerate(w[:17]) if i not in (5, 12)), "x " * 5000 + PASSAGE,
    ]
    assert {d for d, _ in leak_rows(spark, documents, [PASSAGE])} == {0, 1, 3, 5, 6, 7, 8, 9, 13, 14, 15}


def test_shared_passages_blocks_and_empty_tables(spark):
    other = " ".join(f"word{i}" for i in range(40))
    want = [(0, 0), (0, 2), (1, 1)]
    passages = [PASSAGE, other, PASSAGE, None, "too short"]
    assert leak_rows(spark, [PASSAGE, other, "none"], passages) == want == leak_rows(spark, [PASSAGE, other, "none"], passages, filter_bits=1 << 10)
    assert leak_rows(spark, [], passages) == [] and leak_rows(spark, [PASSAGE], []) == []


def test_many_passages_and_a_full_filter_lose_nothing(spark):
    rng = random.Random(11)
    words = [f"w{n}" for n in range(3000)]
    passages = [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(400)]
    documents, want = [], set()
    for d in range(300):
        own = rng.choices(words, k=rng.randint(0, 300))
        for p in rng.sample(range(400), rng.randint(0, 2)):
            text = passages[p].split()
            n = rng.randint(15, len(text))
            a = rng.randint(0, len(text) - n)
            part = text[a : a + n]
            for at in range(rng.randint(0, 5), n, 6):  # every sixth word is wrong
                part[at] = "wrong"
            own += part
            own += rng.choices(words, k=20)
            if any(sum(x == "wrong" for x in part[i : i + size]) <= size // 6 for size in range(15, n + 1) for i in range(n - size + 1)):
                want.add((d, p))
        documents.append(" ".join(own))
    few = leak_rows(spark, documents, passages, filter_bits=1 << 10)
    assert few == leak_rows(spark, documents, passages) and want <= set(few)


def test_copies_null_keys_and_long_tags(spark):
    docs = spark.createDataFrame([(None, PASSAGE), *[(7, PASSAGE)] * 50, (8, PASSAGE.replace(" why", f' <a href="{"x" * 900}">why</a><!-- {"y" * 900} -->'))],
        "doc_id long, text string")
    items = spark.createDataFrame([(1, PASSAGE), (None, PASSAGE)], "item_id long, passage string")
    assert set(map(tuple, leaks.leaks(docs, "doc_id", "text", items, "item_id", "passage").collect())) == {(None, 1), (7, 1), (8, 1)}


def edit_distance_within(pattern, text, budget):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (p != w)))
        row = new
        best = min(best, row[-1])
    return best <= budget


@hypothesis_settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 4))
def test_myers_is_the_edit_distance(pattern, text, budget):
    masks = {}
    for b, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << b
    want = edit_distance_within(pattern, text, budget) if text else False
    got = leaks.myers(masks, len(pattern), text, budget)
    assert got == want or (not text and not got) or (len(pattern) <= budget and text)


# 8 garbled

SOUND = [
    "The café on the corner — “very” nice… isn’t it? €5", "Über die Straße lief ein größerer Bär", "Où est l’élève ? À bientôt, ça va.",
        "¿Dónde está mañana el niño? ¡Aquí!", "Zażółć gęślą jaźń, proszę bardzo", "Все счастливые семьи похожи друг на друга", "図書館の窓辺の猫をもっと大切にしたい",
    "ÂGE, ÎLE, CHÂTEAU, À BIENTÔT", "SÃO JOÃO, CONCEIÇÃO, ÂNGELA, FRANÇA", "Þórður, Æsa, Ðalvík, Ågot, Øyvind", "┌──────┐\n│ ok ▒ │\n└──────┘",
        "√2 ≈ 1.41, ∑ ≤ ∞, π ≠ 3, Ω", "caf&eacute; &amp; bar", unicodedata.normalize("NFD", "élève à Århus"),
        "Sizes: ¼, ½ cup; 180 °C ± 5; © 2019; £3; §4, µm, ×2", "A MINHA IRMÃ", "PÅ”", "",
]


@pytest.mark.parametrize("t", SOUND)
def test_sound_text_stays(t):
    assert garbled.restored(t) == (t, 0, False)


@pytest.mark.parametrize("wrong", ["mac_roman", "cp437", "cp850", "cp866", "cp1251", "koi8_r", "cp1250", "iso8859_2"])
def test_what_stands_beside_lost_characters_is_restored(wrong):
    t, lost = "Die Größe der Bücher über Köln ist schön, sagt Jürgen. ", "Ein Zeichen fehlt: Stra\ufffde."
    assert garbled.restored(t.encode().decode(wrong, "replace") + lost) == (t + lost, 1, True)


def test_remains_of_lost_characters_are_left():
    t = "Привет, это простое сообщение. "
    assert garbled.restored(t.encode("koi8_r").decode("cp1251") + "x\ufffdy") == (t + "x\ufffdy", 1, True)
    broken = "Кто ждёт: зде\u00d1\ufffd, шер\u00d1\ufffd\u00d1\ufffd"
    assert garbled.restored(broken) == (broken, 0, True)


@pytest.mark.parametrize("t", [x for x in SOUND[:7]])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
def test_round_trip_of_utf8(t, wrong):
    def damage(x):
        return "".join(chr(b) if wrong == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90,
            0x9D) else bytes([b]).decode(wrong) if not (wrong == "cp1251" and b == 0x98) else "\x98" for b in x.encode())

    once = damage(t)
    fixed, layers, remains = garbled.restored(once)
    assert layers and (fixed == t or wrong not in ("cp1252", "latin-1"))
    if wrong in ("cp1252", "latin-1"):
        twice = damage(once)
        assert garbled.restored(twice)[0] == t and not remains


def test_damage_in_places_and_after_processing():
    assert garbled.restored("Sound café here.\nAnd cafÃ© there.")[0] == "Sound café here.\nAnd café there."
    assert garbled.restored("lâ€™Ã©quipe vÃ©lo".lower())[0] == "l’équipe vélo"
    assert garbled.restored("critic&#195;&#179; el diario")[0] == "criticó el diario"
    assert garbled.restored("un caf� ici") == ("un caf� ici", 0, True)
    assert garbled.restored("Der BΣcker um die Ecke")[0] == "Der Bäcker um die Ecke"
    assert garbled.restored("La tempÍte au-dessus, la prÈsidente")[0] == "La tempête au-dessus, la présidente"
    assert garbled.restored("Пекарь за углом".encode("koi8_r").decode("cp1251"))[0] == "Пекарь за углом"
    assert garbled.restored(None) == (None, 0, False)


@hypothesis_settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_restoring_never_fails_and_is_stable(t):
    fixed, layers, _ = garbled.restored(t)
    assert isinstance(fixed, str) and (layers or fixed == t)


@pytest.mark.parametrize("layers", [9, 12])
def test_any_number_of_layers_is_undone(layers):
    t = "Über die Straße lief é"
    damaged = t
    for _ in range(layers):
        damaged = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in damaged.encode())
    assert garbled.restored(damaged) == (t, layers, False)


def test_garbled_table(spark):
    df = spark.createDataFrame([(1, "cafÃ©", "x"), (1, "cafÃ©", "x"), (2, "café", "y"), (3, None, ""), (4, "", ""), (5, "ÃƒÂ©lÃƒÂ¨ve " * 3000, "")],
        "doc_id long, text string, restored string")
    got = garbled.garbled(df, "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 5] and {r["restored"] for r in got if r["doc_id"] == 1} == {"café"} and next(r for r in got if r["doc_id"] == 5)["restored"] == "élève " * 3000
    assert garbled.garbled(df.limit(0), "doc_id", "text").count() == 0


# all of them on the smallest tables


@pytest.mark.parametrize("name", sorted(n for n in Q.QUERIES if n not in Q.SQL))
def test_runs_on_the_smallest_tables(spark, small, name):
    assert Q.QUERIES[name](spark, small).count() > 0


def test_found_columns(spark, small):
    want = {"p1_found": {"id": "bigint", "lang": "string"}, "p2_found": {"id_a": "bigint", "id_b": "bigint"},
        "p3_found": {"viewer_user_id": "bigint", "post_id": "bigint"}, "p5_found": {"term": "string", "mark": "string"},
        "p7_found": {"doc_id": "bigint", "item_id": "bigint"}, "p8_found": {"doc_id": "bigint"}}
    for name, columns in want.items():
        df = Q.QUERIES[name](spark, small)
        assert dict(df.dtypes) == columns and df.count() == df.distinct().count()
