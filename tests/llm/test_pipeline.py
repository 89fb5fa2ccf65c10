import __spark_entry__
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    from palimpsest.llm.storage import materialize

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as d")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] == counts[1] > counts[2] == counts[3] < counts[4]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == counts[-1]


def test_registered():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_run_against_brute_force(spark, tmp_path):
    """Every stage by brute force on a small table with odd rows; of language identification, by the model text by text."""
    import hashlib
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    from palimpsest.llm import langid
    from palimpsest.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    from . import test_langid_mixing, test_minhash, test_substring

    rng = random.Random(4)
    vocabulary = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    passage = rng.choices(vocabulary, k=70)
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 90)) + (passage if i % 4 == 0 else [])) for i in range(48)]
    texts += [texts[3], texts[4] + " more", texts[5], " ".join(texts[8].split()[:-1]), None, "", "123 456", texts[9].replace(" ", "\n", 3)]
    rows = [(i * 7 % 60, t, "de", rng.choice(["a", "b", None])) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[0], "de", "a")]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, d BIGINT, root STRING, hash INT"
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, 1, "x", 2) for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = langid.fit(docs)
    kept = [r for r in rows if model.predict(pa.array([r[1]], pa.string()))[2][0].as_py()]
    groups = test_minhash.brute(sorted({(i, t) for i, t, _, _ in kept if i is not None}))
    kept = [r for r in kept if r[0] is None or groups[r[0]] == r[0]]
    passed = test_substring.brute([(i, t) for i, t, _, _ in kept])
    kept = [(i, t if not gone else " ".join(w for j, w in enumerate(words) if j not in gone), lang, s) for (i, t, lang, s), (_, words, gone) in zip(kept, passed, strict=True)]
    copies = test_langid_mixing.brute_copies(kept)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want: Counter = Counter()
    for (i, t, _, _), n in zip(kept, copies, strict=True):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False).encode())] += n
    assert got == +want
    assert len(kept) < len(rows) - 5 and any(gone for _, _, gone in passed)


def test_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
