import hashlib
import random
import re

import pytest

from palimpsest.llm import substring


def brute(rows, k=50):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict = {}
    for i, w in words:
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            least[key] = min(least.get(key, 1 << 62), 1 << 61 if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if least[tuple(w[j : j + k])] < (1 << 61 if i is None else i):
                gone |= set(range(j, j + k))
        out.append((i, w, gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    small = ["a", "b", "é", "日本"]
    passages = [[rng.choice(small if p % 3 == 0 else [f"w{x}" for x in range(500)]) for _ in range(rng.randint(49, 140))] for p in range(8)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            words += p[a : len(p) - rng.randint(0, 20)]
            if rng.random() < 0.5:
                words += [f"own{i}-{x}" for x in range(rng.randint(0, 30))]
            if words and rng.random() < 0.3:
                words[rng.randrange(len(words))] = "edit"
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(i, t) for i, t in rows[:3]] + [(None, rows[5][1]), (7, None), (8, ""), (9, "same " * 300), (3, "same " * 120)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(documents, seed):
    rows = corpus(seed)
    docs = documents(rows).selectExpr("*", "1 as d", "2 as contents", "3 as windows", "4 as w").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect())
    want = []
    for i, w, gone in brute(rows):
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want)
    assert sum(len(x[2]) for x in brute(rows)) > 500


def test_documents_keep_their_columns(documents):
    rows = corpus(4)
    docs = documents(rows).selectExpr("*", "cast(doc_id as string) as d", "array(1, 2) as contents")
    out = substring.without_repeats(docs)
    assert out.schema == docs.schema and out.count() == len(rows)
    want = {(i, None if t is None else t if not gone else " ".join(x for j, x in enumerate(w) if j not in gone)) for (i, t), (_, w, gone) in zip(rows, brute(rows), strict=True)}
    found = out.collect()
    assert {(r.doc_id, r.text) for r in found} == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in found)


def test_a_very_long_text(documents):
    long = " ".join(f"v{i}" for i in range(200_000))
    rows = [(1, long), (2, long[5000:-5000]), (3, "x " * 10)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.digests(documents(rows)).collect()}
    n = len(rows[1][1].split())
    assert got[1] == (200_000, 0) and got[3] == (10, 0)
    assert got[2][0] == n and n - 2 <= got[2][1] <= n


def test_empty(documents):
    assert substring.digests(documents([])).count() == 0
