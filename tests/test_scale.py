"""What a write or read brings into one task, or into one worker's memory, is bounded."""

from __future__ import annotations

import gc
import os
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.conf import TableConfig
from palimpsest.functions import codec
from palimpsest.operators import sections as S
from palimpsest.schema import SEQUENCE, resolve
from palimpsest.sources import table as table_module
from palimpsest.sources.table import VersionedTable


@pytest.fixture
def numbered(spark, monkeypatch):
    """Per numbering over tasks: the chains it had, and how many rows each task held."""
    seen = []
    plain = VersionedTable._numbered_over_tasks

    def spy(self, new, *rest):
        out = plain(self, new, *rest)
        seen.append(({r[0] for r in out.select("__g").distinct().collect()}, [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]))
        return out

    monkeypatch.setattr(table_module, "HOT_BYTES", 50_000, raising=False)
    monkeypatch.setattr(VersionedTable, "_numbered_over_tasks", spy)
    kept = {n: spark.conf.get(n) for n in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield seen
    for name, value in kept.items():
        spark.conf.set(name, value)


def test_a_chain_of_many_bytes_is_numbered_over_tasks(spark, catalog, numbered):
    t = catalog.create_table("d", "source STRING, doc_id BIGINT, text STRING, n INT", TableConfig(group_by="source", order_by="doc_id", keyframe_every=10))
    want = {"big": [(i // 3, "same start " * 30 + f"{i:05d}") for i in range(900)]} | {f"s{g}": [(i, f"text {i}") for i in range(g)] for g in range(1, 30)}
    rows = [(g, *r, i) for g, own in want.items() for i, r in enumerate(own)]
    random.Random(3).shuffle(rows)
    half = [r for r in rows if r[1] < 200], [r for r in rows if r[1] >= 200]
    for part in half:
        t.append(spark.createDataFrame(part, "source STRING, doc_id BIGINT, text STRING, n INT"), arrival=["doc_id", "text"])
    for g, own in want.items():
        found = t.df().where(F.col("source") == g).orderBy(SEQUENCE).collect()
        assert [(r.doc_id, r.text, r[SEQUENCE]) for r in found] == [(*r, i) for i, r in enumerate(own, 1)]
    assert [chains for chains, _ in numbered] == [{"big"}, {"big"}]
    assert all(max(each) < 0.6 * sum(each) for _, each in numbered)
    assert t.sections().groupBy("g_source", "_base", "_sec").count().where("count > 1").count() == 0


def test_a_chunk_of_sections_is_decoded_piece_by_piece():
    values = [os.urandom(10_000) for _ in range(2000)]
    blobs = [codec.encode_keyframe(v) for v in values]
    offsets = list(range(0, 2001, 10))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(blobs, pa.binary()))
    seqs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(range(2000), pa.int64()))
    del blobs
    tracemalloc.start()
    out = S._decode_lists(lists.slice(20), seqs.slice(20), pa.binary())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.flatten().to_pylist() == values[200:]
    assert most < 1.7 * sum(map(len, values))  # the answer's own buffer, which grows by eighths, and a piece


def test_decoding_keeps_nulls_and_empty_values():
    texts = [["a", None, ""], [], None, [None], ["é" * 40, "é" * 41]]
    flat = [v for x in texts for v in x or []]
    blobs = [None if v is None else codec.encode_keyframe(v.encode()) for v in flat]
    offsets = pa.array([0, 3, 3, 3, 4, 6], pa.int32())
    mask = pa.array([x is None for x in texts])
    lists = pa.ListArray.from_arrays(offsets, pa.array(blobs, pa.binary()), mask=mask)
    seqs = pa.ListArray.from_arrays(offsets, pa.array(range(6), pa.int64()))
    out = S._decode_lists(lists, seqs, pa.string())
    out.validate(full=True)
    assert out.to_pylist() == texts
    assert S._decode_lists(lists.slice(3), seqs.slice(3), pa.string()).to_pylist() == texts[3:]


def test_a_table_without_groups_is_numbered_over_tasks(spark, catalog, numbered):
    """One chain of far fewer than a million rows, but of many bytes, is not one task's."""
    schema = T.StructType.fromDDL("page_id BIGINT, url STRING, html STRING NOT NULL")
    config = TableConfig(order_by="page_id", delta_columns=("html",), keyframe_every=20)
    t = VersionedTable.create(spark, catalog._path("p"), schema, config)
    rows = [(i // 2, f"u{i % 2}", f"<p>{i}</p>" * 20) for i in range(600)]
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    t.append(spark.createDataFrame(mixed, "page_id BIGINT, url STRING, html STRING"), arrival=["page_id", "url"])
    assert [tuple(r) for r in t.df().orderBy(SEQUENCE).collect()] == [(*r, i) for i, r in enumerate(rows, 1)]
    assert [chains for chains, _ in numbered] == [{0}]
    assert all(max(each) < 0.6 * sum(each) for _, each in numbered)


@pytest.fixture
def encoder(spark, monkeypatch):
    """What workers run on batches to encode sections of K = 3, in this process; and a maker of its batches."""
    frame, made = type(spark.range(1)), []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *rest, **more: made.append(run) or plain(self, run, *rest, **more))
    schema = T.StructType.fromDDL("id BIGINT, version BIGINT, text STRING")
    rows = spark.createDataFrame([], f"id BIGINT, version BIGINT, text STRING, _base BIGINT, _sec BIGINT, {SEQUENCE} BIGINT")
    S.encode(rows, schema, {n: n for n in schema.names}, resolve(schema, TableConfig(group_by="id", order_by="version")), 3, 1, True, 0)

    def batch(first, n):
        texts = [os.urandom(5_000).hex() for _ in range(n)]
        numbers = range(first, first + n)
        whole = [[1] * n, [1] * n, [i // 3 for i in numbers], [i + 1 for i in numbers], list(numbers)]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in whole), pa.array(texts)], ["g_id", "_base", "_sec", "_seq", "p_version", "d_text"])

    return made[0], batch


def test_a_batch_of_rows_is_encoded_piece_by_piece(encoder):
    run, batch = encoder
    parts = [batch(0, 2000), batch(2000, 1), batch(2001, 1)]
    tracemalloc.start()
    rows = sum(sum(out.column("_rows").to_pylist()) for out in run(iter(parts)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2002
    assert most < 0.7 * parts[0].nbytes


def test_an_open_section_does_not_keep_the_batch_it_began_in(encoder):
    run, batch = encoder
    left, before = [], pa.total_allocated_bytes()

    def source():
        for i in range(3):
            part = batch(i * 500, 500)  # 500 is no multiple of three: a section goes on in the next batch
            size = part.nbytes
            yield part
            del part
            gc.collect()
            left.append((pa.total_allocated_bytes() - before) / size)

    found = [r for out in run(source()) for r in out.select(["_sec", "_rows"]).to_pylist()]
    assert [r["_sec"] for r in found] == list(range(500)) and {r["_rows"] for r in found} == {3}
    assert max(left) < 0.1
