import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, tokenstore
from palimpsest.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a<|endoftext|>b <|startoftext|>X", "<|ENDOFTEXT|>", "e<|endoftext|>́", "isn't I'LL we'Ve '''s", "aaaaaaa " * 9, "x" * 5000, "word " * 9000]
    for letters in ("aAbBéÉ́ \t\n\xa0 　日本😀ΣσIİ'stvrelmd1٣<|>!.?\x1c\x85​…—≠", "abAB's.t!1?≠…é "):
        out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1000)]
    return out


def test_same_ids_and_text_as_the_library(library):
    vocabulary, own = bpe.encoder(tokenizer_path())
    other = tokenstore.library_encoder(tokenizer_path())
    texts = odd_texts()
    for i in range(0, len(texts), 40):  # chunks with and without added tokens
        some = texts[i : i + 40]
        for words in (own, other):
            for begin, end, ids, offsets in words.chunks(pa.array(some, pa.string())):
                for j in range(begin, end):
                    mine = ids[offsets[j - begin] : offsets[j - begin + 1]]
                    want = library.encode(some[j] or "", add_special_tokens=False).ids
                    assert mine.tolist() == want, some[j]
                    assert vocabulary.decode(mine).decode() == library.decode(want, skip_special_tokens=False)


def test_full_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "WORD_CACHE", 5)
    monkeypatch.setattr(bpe, "PIECE_CACHE", 3)
    vocabulary = bpe.Vocabulary(tokenizer_path())
    words = bpe.WordEncoder(vocabulary.encode_pieces, vocabulary.added)
    for text in ["one two three four five six seven", "one two eight nine ten", "seven six one"] * 2:
        (_, _, ids, _), = words.chunks(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_queries(spark, documents, library):
    rows = [(i * 3 % 70, t) for i, t in enumerate(odd_texts()[:60])] + [(5, "same"), (5, "same"), (None, "no id")]
    docs = documents(rows).selectExpr("*", "1 as n_tokens", "2 as start")
    want = [(r.doc_id, r.text or "") for r in docs.selectExpr("doc_id", "text", "xxhash64(text) as h").orderBy(F.col("doc_id").asc_nulls_first(), "h", "text").collect()]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, tokenizer_path()).collect()}
    ids = [library.encode(t, add_special_tokens=False).ids for _, t in want]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for (i, _), x in zip(want, ids, strict=True)}
    stored = sorted(tokenstore.store_and_check(spark, docs, tokenizer_path()).collect(), key=lambda r: r.start)
    start = 0
    assert [r.doc_id for r in stored] == [i for i, _ in want]
    for r, x in zip(stored, ids, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes()))
        start += r.n_tokens
    again = bpe.encode_texts(docs, tokenizer_path()).select("doc_id", "token_ids").where("doc_id = 5").collect()
    same, more = library.encode("same", add_special_tokens=False).ids, [library.encode(t or "", add_special_tokens=False).ids for i, t in rows if i == 5 and t != "same"]
    assert sorted(r.token_ids for r in again) == sorted([same, same, *more])


def test_selective_reads(spark, documents, monkeypatch):
    import pyarrow.parquet as pq

    from palimpsest.llm.storage import new_folder, open_fs

    docs = documents([(i, f"text number {i} " * (i % 7)) for i in range(300)]).repartition(3)
    manifest = tokenstore.write_tokens(docs, tokenizer_path(), new_folder(spark, "tokens")).cache()
    every = {r.doc_id: (r.start, r.tokens) for r in tokenstore.read_tokens(manifest).collect()}
    some = {r.doc_id: (r.start, r.tokens) for r in tokenstore.read_tokens(manifest, 40, 59).collect()}
    assert some == {i: every[i] for i in range(40, 60)} and len(every) == 300
    fs, path = open_fs(manifest.first().path)
    with fs.open_input_file(path) as f:
        column = pq.ParquetFile(f).metadata.row_group(0).column(2)
        assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index


def test_empty(spark, documents):
    docs = documents([])
    assert bpe.digests(docs, tokenizer_path()).count() == 0
    assert tokenstore.store_and_check(spark, docs, tokenizer_path()).count() == 0
