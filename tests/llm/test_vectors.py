import numpy as np
import pytest

from palimpsest.llm import embdedup, topk
from palimpsest.llm.components import components

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, id INT, v INT, cell INT"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def odd(start):
    nan, inf = float("nan"), float("inf")
    return [(start, None, 1), (start + 1, [nan] * 8, 1), (start + 2, [inf] + [1.0] * 7, 1), (start + 3, [None] + [1.0] * 7, 1), (start + 4, [0.0] * 8, 1), (start + 5, [], 1), (start + 100 - start % 100, [1.0] * 3, 1), (start + 7, [1.0] * 8, None)]


def test_top_products(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(420, 8)).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + odd(1000) + [(5, x[5].tolist(), 0)]
    got = sorted(tuple(r) for r in topk.top_products(frame(spark, rows).repartition(5)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)


def brute_top(rows, k=10):
    good = [(i, [int(np.floor(1024 * np.float64(a))) for a in v]) for i, v, _ in rows if i is not None and v and all(a is not None and np.isfinite(a) for a in v)]
    want = []
    for n, (q, a) in enumerate(good):
        if q % 100 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(good) if m != n and len(b) == len(a)]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(want)


@pytest.mark.parametrize("bits,gathered", [(12, 1 / 32), (4, 0.0), (5, 0.3)])
def test_top_products_of_many_blocks(spark, monkeypatch, bits, gathered):
    """Blocks that are asked again, repeated ids, equal scores."""
    monkeypatch.setattr(topk, "ROW_BITS", bits)
    monkeypatch.setattr(topk, "GATHERED", gathered)
    rng = np.random.default_rng(8)
    rows = [(i % 350, rng.integers(-3, 4, 6).astype(float).tolist(), 0) for i in range(400)]
    got = sorted(tuple(r) for r in topk.top_products(frame(spark, rows).repartition(3)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)


def test_a_safe_cutoff_saves_work(spark, monkeypatch):
    """Where queries have near neighbours, few blocks are asked again; those that are have all that may pass."""
    asked = []
    scan = topk._scan
    monkeypatch.setattr(topk, "_scan", lambda rows, block, k, cutoffs, of: (asked.append(of) if cutoffs is not None else None, scan(rows, block, k, cutoffs, of))[1])
    rng = np.random.default_rng(9)
    base = rng.normal(size=(20, 32))
    x = base[rng.integers(0, 20, 3000)] + 0.1 * rng.normal(size=(3000, 32))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    monkeypatch.setattr(topk, "ROW_BITS", 9)
    got = sorted(tuple(r) for r in topk.top_products(frame(spark, rows)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)
    assert sum(len(q) for of in asked for q in of.values()) < 0.5 * 30 * 8


def test_top_products_of_large_components(spark):
    """Sums beyond 2**53 and components beyond 32 bits."""
    rows = [(i, [1e6 + i, -1e5 * (i % 7), 1.0 * i, 2.2e6 * (i % 3 == 0)], 0) for i in range(300)]
    wide = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    got = sorted(tuple(r) for r in topk.top_products(wide).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)
    huge = topk.top_products(spark.createDataFrame([(0, [1e9], 0), (1, [1e9], 0), (2, [-1e9], 0)], wide.schema))
    assert [tuple(r) for r in huge.collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 1)]


def brute(rows):
    unit = {}
    for n, (i, v, label) in enumerate(rows):
        if label is not None and i is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v):
            a = np.array(v, np.float64)
            unit[n] = a / np.linalg.norm(a)
    links = {n: [m for m in unit if m != n and rows[m][2] == rows[n][2] and len(unit[m]) == len(unit[n]) and unit[n] @ unit[m] >= 0.93] for n in unit}
    root = {n: rows[n][0] for n in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for n, near in links.items():
            low = min([root[n], *[root[m] for m in near]])
            changed |= low < root[n]
            root[n] = low
    return sorted((str(r[0]), len(links.get(n, [])), root[n], r[0] is not None and root[n] == r[0]) for n, r in enumerate(rows))


@pytest.mark.parametrize("per_cell,block", [(8, 16 << 20), (2, 64 * 20), (1, 1)])
def test_links(spark, monkeypatch, per_cell, block):
    monkeypatch.setattr(embdedup, "PER_CELL", per_cell)
    monkeypatch.setattr(embdedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(embdedup, "CHUNK", 50)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 8))
    x = base[rng.integers(0, 25, 260)] + rng.normal(size=(260, 8)) * rng.choice([0.0, 0.1, 0.3], (260, 1))
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(500 + i, rows[9][1], 0) for i in range(40)] + [(600, [2 * a for a in rows[9][1]], 0)] + odd(1000) + [(None, [1.0] * 8, 1)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embdedup.links(frame(spark, rows)).collect())
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 2000


def test_cells_prune_and_lose_nothing():
    """Of random vectors with groups of near copies: few cells are visited, all links are found, a tight group is one cell."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 64))
    x[4000:] = x[3] + 0.05 * rng.normal(size=(2000, 64))
    x[3000:4000] = x[rng.integers(0, 100, 1000)] + rng.choice([0.1, 0.3, 0.4], (1000, 1)) * rng.normal(size=(1000, 64))
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    one = np.ones(len(x), np.int64)
    got = embdedup.compare(units, one, units, one, 0.93, True)
    linked = units @ units.T >= 0.93
    np.fill_diagonal(linked, False)
    assert (got.links == linked.sum(axis=1)).all() and linked.sum() > 4_000_000
    assert got.visited < 0.25
    assert len(got.between[0]) + len(got.among[0]) < 20_000
    a, b = embdedup.compare(units[:2500], one[:2500], units[2500:], one[2500:], 0.93, False), linked[:2500, 2500:]
    assert (a.links == b.sum(axis=1)).all() and (a.others == b.sum(axis=0)).all()


def test_no_vectors(spark):
    assert embdedup.links(frame(spark, [])).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (100, 102), (7, 7), (200, 200)] + [(300, 300 + i) for i in range(1, 40)] + [(3, 2)]
    got = {r.id: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100} | {300 + i: 300 for i in range(40)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
