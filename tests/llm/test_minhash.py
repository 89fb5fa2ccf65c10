import random
import re
from collections import defaultdict

import numpy as np
import pytest

from palimpsest.llm import minhash


def brute(rows, weights=None):
    """Groups by plain similarity of five-word runs, counted with their frequency."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        counts: dict = defaultdict(int)
        for j in range(len(words) - 4):
            counts[tuple(words[j : j + 5])] += 1
        sets[i] = {(k, n) for k, c in counts.items() for n in range(c)} or ({tuple(words)} if words else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.randint(60, 400))
        for _ in range(rng.randint(1, 9)):
            words = base[:]
            for _ in range(rng.randint(0, len(base) // 120)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rows += ["a b c", "a  b\nc", "a b", "", " ", None, "x y z w v", "x y z w v u", *["again and again and again and again"] * 3]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(documents):
    rows = corpus()
    want = brute(rows)
    got = {r.doc_id: (r.group_id, r.kept) for r in minhash.near_duplicates(documents(rows)).collect()}
    assert got == {i: (g, g == i) for i, g in want.items()}


def test_a_large_group_and_cut_buckets(spark, documents):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base = [f"w{i}" for i in range(150)]
        rows = [(i, " ".join(base[:70] + [f"own{i}"] + base[71:])) for i in range(300)] + [(1000 + i, " ".join(f"r{i}x{j}" for j in range(60))) for i in range(50)]
        got = {r.doc_id: r.group_id for r in minhash.near_duplicates(documents(rows).repartition(7)).collect()}
        assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 + i for i in range(50))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("postings", [1000, 50])
def test_pairs_inside_a_template(documents, monkeypatch, postings):
    """All documents share a long template, but only planted pairs are similar enough."""
    monkeypatch.setattr(minhash, "POSTINGS", postings, raising=False)
    template = [f"t{i}" for i in range(200)]
    rows = []
    for g in range(200):
        for side in range(2):
            rows.append(" ".join(template + [f"g{g}x{j}" for j in range(8)] + [f"g{g}s{side}x{j}" for j in range(19)]))
    random.Random(6).shuffle(rows)
    rows = list(enumerate(rows))
    mate: dict = {}
    want = {i: mate.setdefault(text.split()[200], i) for i, text in rows}
    assert brute(rows[:40]) == {i: want[i] for i in range(40)}
    assert {r.doc_id: r.group_id for r in minhash.near_duplicates(documents(rows)).collect()} == want


def test_recall_near_the_border(documents):
    """Pairs of similarity 0.8 to 0.9 by plain count: at least 0.9 are found, and none below 0.78."""
    rng = random.Random(11)
    rows, alike = [], {}
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(rng.randint(80, 300))]
        other = base[:]
        for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.uniform(0.005, 0.035)))):
            other[at] = f"new{g}x{at}"
        runs = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (base, other)]
        alike[g] = len(runs[0] & runs[1]) / len(runs[0] | runs[1])
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(documents(rows)).collect()}
    found = {g: got[2 * g + 1] == 2 * g for g in alike}
    near = [g for g, s in alike.items() if 0.8 <= s < 0.9]
    assert len(near) > 30 and sum(found[g] for g in near) >= 0.9 * len(near)
    assert not any(found[g] for g, s in alike.items() if s < 0.78)


def test_a_very_long_text(documents):
    long = " ".join(f"v{i % 60_000}" for i in range(150_000))
    rows = [(1, long), (2, "start " + long), (3, "v1 v2 v3")]
    assert {r.doc_id: r.group_id for r in minhash.near_duplicates(documents(rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_ids(documents):
    text = " ".join(f"t{i}" for i in range(40))
    docs = documents([(4, text), (4, text), (2, text), (None, text), (9, None)]).selectExpr("*", "1 as d", "2 as root", "3 as v")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.group_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(False, 2, 2, True), (False, 4, 2, False), (False, 4, 2, False), (False, 9, 9, True), (True, 0, None, True)]
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 9]


def test_empty(documents):
    assert minhash.near_duplicates(documents([])).count() == 0


def test_bands_follow_the_similarity():
    """Consistent samples agree as often as the sets are alike."""
    rng = np.random.default_rng(3)
    weights = np.full(1 << minhash.IDF_BITS, minhash.TOP, np.uint8)
    weights[::3] = minhash.TOP - minhash.SPAN
    agree, alike = [], []
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**64, 600, dtype=np.uint64)
        b = np.where(rng.random(600) < share, a, rng.integers(0, 2**64, 600, dtype=np.uint64))
        weigh = lambda x: weights[(x >> np.uint64(48)).astype(int)].astype(float).sum()
        both = np.intersect1d(a, b)
        alike.append(weigh(both) / weigh(np.union1d(a, b)))
        x = minhash.signatures(np.concatenate([a, b]), np.array([0, 600, 1200]), weights)
        agree.append((x[0] == x[1]).mean())
    expected = [s**minhash.ROWS for s in alike]
    assert all(abs(x - y) < 0.3 for x, y in zip(agree, expected, strict=True)) and agree[0] < agree[2]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6])
def test_short_texts(n):
    data = np.frombuffer(" ".join("abcdefgh"[:n]).encode(), np.uint8)
    runs, at, words, *_ = minhash.elements(data, np.array([0, len(data)]))
    assert words.tolist() == [n] and len(runs) == at[-1] == max(0, n - 4)
