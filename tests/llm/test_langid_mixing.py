import re
import zlib
from collections import Counter, defaultdict

from palimpsest.llm import langid, mixing

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) > 0.98 * len(rows)


def test_odd_texts(spark, documents):
    rows = [(i, f"der die und ist {i} nicht", "de") for i in range(40)] + [(100 + i, f"the of and is {i} not", "en") for i in range(40)]
    rows += [(200, None, "de"), (201, "", "de"), (202, "123 !! \n", None), (203, "und nicht", None), (5, rows[5][1], "de")]
    docs = documents(rows).selectExpr("*", "1 as fold", "2 as nth", "3 as score")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202, 203)] == ["und", "und", "und", "de"]
    assert got[200].score == 0 and not got[202].accepted
    kept = langid.keep_identified(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()}.isdisjoint({200, 201, 202})


def test_rules_against_brute_force(documents):
    """The model's scores, text by text and n-gram by n-gram, and who may be learned from."""
    import numpy as np

    rng = np.random.default_rng(2)
    vocabulary = {"xx": ["lorem", "ipsum", "dolor", "sit"], "yy": ["żółw", "święto", "ąę", "Łódź"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 9)), lang) for i, lang in enumerate(["xx", "yy"] * 60)]
    rows += [(500, "LOREM " * 40_000, "zz"), (501, "lorem  Żółw\tipsum 12", None), (502, "٣ 12 --", "xx"), (None, "dolor sit", "xx")]
    docs = documents(rows)
    learned = langid.sample(docs)
    assert {lang for _, lang, _ in learned} == {"xx", "yy", "zz"} and max(len(t) for t, _, _ in learned) == langid.SAMPLE_CHARS
    fold_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    assert Counter(f for _, _, f in learned) == Counter(fold_of(i) for i, t, lang in rows if lang and fold_of(i))
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, text, _ in rows:
        words = [w.lower().encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        total, n = np.zeros(len(model.labels)), 0
        for word, times in Counter(words).items():
            padded = b" " + word + b" "
            for size in langid.ORDERS:
                for k in range(len(padded) - size + 1):
                    h = size
                    for b in padded[k : k + size]:
                        h = (h ^ b) * 0x01000193 % 2**32
                    total += times * model.table[(h ^ (h >> 15)) % langid.BUCKETS]
                    n += times
        p = langid.softmax((total / n + model.bias) / model.temperature)
        r = got[i]
        if any(c.isalpha() for c in text):
            assert r.lang_pred == model.labels[int(p.argmax())] and abs(r.score - p.max()) < 1e-6
            assert r.accepted == (p.max() >= model.reject_below)
        else:
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        assert r.held_out == (fold_of(i) == 0)


def brute_copies(rows):
    """How often each of (doc_id, text, lang, source) is taken, by sorting every source by hash."""
    import hashlib

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    name = lambda i, t: int(hashlib.md5((str(i) if i is not None else t or "").encode()).hexdigest()[:15], 16)
    sizes: Counter = Counter()
    for _, t, _, s in rows:
        sizes[s] += count(t)
    limit, base = {}, {}
    for s, target in brute_targets(sizes).items():
        base[s] = int(target // sizes[s]) if sizes[s] else 0
        left, limit[s] = target - base[s] * sizes[s], 0
        words: Counter = Counter()
        for i, t, _, source in rows:
            if source == s:
                words[name(i, t)] += count(t)
        for h in sorted(words):
            if words[h] > left:
                limit[s] = h + (words[h] - left < left)
                break
            left -= words[h]
        else:
            limit[s] = 1 << 60
    return [base[s] + (name(i, t) < limit[s]) for i, t, _, s in rows]


def test_copies_against_brute_force(documents):
    rows = corpus() + [(None, "one two three", "en", "a"), (None, "one two three", "en", "a"), (None, "four", "en", "b")]
    got = Counter((r.doc_id, r.size, r.copies) for r in mixing.mix(documents(rows)).collect())
    assert got == Counter((i, len((t or "").split()), c) for (i, t, _, _), c in zip(rows, brute_copies(rows), strict=True))


def test_a_very_long_text(documents):
    rows = [(1, "word " * 400_000, "en", "a"), (2, "a b", "en", "b")]
    got = {r.doc_id: r.size for r in mixing.mix(documents(rows)).collect()}
    assert got == {1: 400_000, 2: 2}


def test_nothing_to_learn(documents):
    docs = documents([(1, "text", None), (2, None, "en")])
    model = langid.fit(docs)
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(documents([]), model).count() == 0


def brute_targets(sizes):
    """Resharing by weight in rounds, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = budget
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def corpus():
    rows = []
    for i in range(900):
        source = [None, "a", "b", "é", "Z", "tiny"][(i * 7) % 6 if i % 3 else 1]
        rows.append((i, "w " * ((i * 37) % 50) + "x", "en", source))
    return rows + [(900, None, "en", "a"), (901, "", "en", "empty"), (None, "a b", "en", "b"), (3, rows[3][1], "en", rows[3][3])]


def check(rows, got):
    sizes: Counter = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken, source = defaultdict(int), {i: s for i, _, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 51, (s, taken[s], want[s])


def test_mix(documents):
    rows = corpus()
    docs = documents(rows).selectExpr("*", "1 as size", "2 as hash", "3 as target", "4 as low")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert again == sorted(map(str, got))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.select("doc_id").collect())
    expected: Counter = Counter()
    for r in got:
        expected[r.doc_id] += r.copies
    assert copies == +expected


def test_mix_of_nothing(documents):
    assert mixing.mix(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None)])).collect()] == [0]


def test_features_take_few_bytes():
    """The driver keeps the features of the whole sample: two bytes a bucket, and no more for a count than it needs."""
    at, times = langid.features("ein Wort und noch ein Wort")
    assert at.itemsize == 2 and times.itemsize == 1 and times.max() > 1
    at, times = langid.features("a " * 70_000 + "b")
    assert at.itemsize == 2 and times.max() == 70_000 and abs((times / times.sum()).sum() - 1) < 1e-12
    assert [len(x) for x in langid.features(" ")] == [0, 0]
