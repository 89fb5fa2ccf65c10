from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.conf import EngineConf, TableConfig
from palimpsest.errors import (
    ConcurrentModification,
    ConfigurationError,
    DuplicateSequence,
    InvalidSequence,
    NotVersioned,
    NullDelta,
    NullGroup,
    UnknownColumn,
    UnsupportedOperation,
    VersionedTableError,
)
from palimpsest.operators import cache, history, introspect
from palimpsest.sources import table as table_module
from palimpsest.sources.table import VersionedTable

DDL = "group_id INT, version INT, content STRING NOT NULL"


def make(catalog, rows=(), ddl=DDL, name="t", **settings):
    t = catalog.create_table(name, ddl, TableConfig(**({"group_by": "group_id"} | settings)))
    if rows:
        add(t, rows)
    return t


def add(t, rows, **options):
    names = [f.name for f in t.schema.fields[: len(rows[0])]]
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in t.schema.fields[: len(rows[0])]])
    del names
    return t.append(t.spark.createDataFrame(rows, kinds), **options)


def got(t, **options):
    return sorted((tuple(r) for r in t.df(**options).collect()), key=lambda r: (str(r[0]), r[-1]))


def versions(group, n, text="Version {} content"):
    return [(group, v, text.format(v)) for v in range(1, n + 1)]


def test_keyframes_and_contents(catalog):
    t = make(catalog, versions(1, 11), keyframe_every=5)
    assert [r[2] for r in got(t)] == [f"Version {v} content" for v in range(1, 12)]
    keys = introspect.inspect(t, 1).where("is_keyframe").select("seq").collect()
    assert sorted(r.seq for r in keys) == [1, 6, 11]
    s = introspect.stats(t).first()
    assert (s.total_rows, s.keyframe_count, s.delta_count, s.total_groups) == (11, 3, 8, 1)
    assert s.compression_ratio > 0 and s.avg_compression_depth == 1.0


def test_depth_takes_the_smallest_base(catalog):
    a, b, c = ("".join(random.Random(i).choices("abcdefghij", k=300)) for i in range(3))
    t = make(catalog, [(1, 1, a), (1, 2, b), (1, 3, c), (1, 4, a)], compress_depth=3)
    tags = {r.seq: r.tag for r in introspect.physical(t, 1).collect()}
    assert tags[4] == 3 and got(t)[3][2] == a
    e = make(catalog, [(1, 1, "x" * 22), (1, 2, ""), (1, 3, "")], name="e", compress_depth=5)
    assert [r[2] for r in got(e)] == ["x" * 22, "", ""]
    assert {r.seq: r.tag for r in introspect.physical(e, 1).collect()} == {1: 0, 2: 1, 3: 1}


def test_batches_continue_chains(catalog):
    t = make(catalog, keyframe_every=4, compress_depth=2)
    want = []
    for i in range(5):
        rows = [(g, i * 10 + v, f"g{g} batch {i} row {v}") for g in range(3) for v in range(i + 1)]
        want += rows
        add(t, rows)
    for g in range(3):
        mine = [r for r in want if r[0] == g]
        assert got(t, group=g) == [(*r, s) for s, r in enumerate(mine, 1)]
    assert t.count() == len(want)
    # one tail section for each chain, and none that is split
    assert t.sections(kind="tail").count() == 3
    assert t.sections().groupBy("g_group_id", "_sec").count().where("count > 1").count() == 0


def test_no_group_and_numbering_over_tasks(catalog, monkeypatch):
    monkeypatch.setattr(table_module, "HOT_ROWS", 10)
    t = catalog.create_table("n", "version INT, content STRING", TableConfig(keyframe_every=7))
    rows = [(v, f"text {v}") for v in range(100)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    add(t, shuffled)
    add(t, [(v, "late") for v in range(100, 150)])
    assert [(r[0], r[2]) for r in sorted(got(t), key=lambda r: r[2])] == [(v, v + 1) for v in range(150)]
    assert t.delete("version = 120") == 30
    assert t.count() == 120 == t.df().count()


@pytest.mark.parametrize("ddl,rows", [
    ("group_id STRING, version BIGINT, content BINARY", [("a", 1, b"\x00\xff"), ("a", 2, b""), ("b", 3, b"\x00" * 900)]),
    ("group_id DECIMAL(12,4), version SMALLINT, content STRING", None),
    ("group_id DATE, version TIMESTAMP, content STRING", None),
])
def test_types(catalog, ddl, rows):
    import datetime
    from decimal import Decimal

    if rows is None and "DECIMAL" in ddl:
        rows = [(Decimal("1.0000"), -3, "x"), (Decimal("1.0000"), 32767, "y\n\t\\'\"é日"), (Decimal("2.5000"), 0, "z")]
    elif rows is None:
        rows = [(datetime.date(2024, 1, i), datetime.datetime(1999, 1, i, 3, 4, 5, 678), f"v{i}") for i in (1, 2)]
    t = make(catalog, rows, ddl)
    assert sorted(r[:3] for r in got(t)) == sorted(rows)
    assert got(t, group=rows[0][0])[0][:3] == rows[0]


def test_plain_columns_nulls_and_many_deltas(catalog):
    extra = ", ".join(f"c{i} STRING" for i in range(33))
    t = make(catalog, ddl=f"group_id INT, version INT, tags ARRAY<STRING>, flag BOOLEAN, m MAP<STRING,INT>, {extra}")
    rows = [(1, v, ["a", None] if v % 2 else None, None if v == 2 else True, {"k": v}, *[f"{i}-{v}" if i % 3 or v > 1 else None for i in range(33)]) for v in range(1, 5)]
    add(t, rows)
    assert [r[:-1] for r in got(t)] == rows
    assert t.df().select("c5").where("c5 like '5-%'").count() == 4


def test_order_values_are_ordinary(catalog):
    t = make(catalog, [(1, 5, "a"), (1, 2, "b"), (1, None, "c"), (1, 2, "d")])
    assert [r[2] for r in got(t)] == ["b", "d", "a", "c"]
    u = make(catalog, name="u")
    add(u, [(1, 5, "a"), (1, 2, "b")], arrival=[F.col("version").desc()])
    assert [r[2] for r in got(u)] == ["a", "b"]


def test_cascade_delete(catalog):
    t = make(catalog, versions(1, 12) + versions(2, 3), keyframe_every=5)
    assert t.delete("group_id = 1 AND version = 8") == 5
    assert [r[1] for r in got(t, group=1)] == list(range(1, 8)) and len(got(t, group=2)) == 3
    s = introspect.stats(t).first()
    assert (s.total_rows, s.keyframe_count) == (10, 3)
    fresh = make(catalog, versions(1, 7) + versions(2, 3), name="f", keyframe_every=5)
    assert introspect.stats(fresh).first().raw_size_bytes == s.raw_size_bytes
    assert introspect.stats(fresh).first().compressed_size_bytes == s.compressed_size_bytes
    add(t, [(1, 99, "after")])
    assert got(t, group=1)[-1] == (1, 99, "after", 8)
    assert t.delete(F.col("content").like("%Version 1 %")) == 11
    assert t.count() == 0 and not introspect.stats_exist(t)
    add(t, [(1, 1, "again")])
    assert got(t) == [(1, 1, "again", 1)]
    assert t.delete("false") == 0


def test_explicit_sequences(catalog):
    t = make(catalog, keyframe_every=3)
    add(t, [(1, 1, "a", 1), (1, 2, "b", 2), (1, 3, "c", 5), (1, 4, "d", None), (1, 5, "e", 0), (1, 6, "f", -4)])
    assert [r[3] for r in got(t)] == [1, 2, 5, 6, 7, 8]
    add(t, [(1, 7, "gap", 3)])
    assert [(r[2], r[3]) for r in got(t)][2] == ("gap", 3)
    assert [r[2] for r in got(t)] == ["a", "b", "gap", "c", "d", "e", "f"]
    assert t.sections(kind="tail").count() == 1
    with pytest.raises(DuplicateSequence):
        add(t, [(1, 8, "x", 6)])
    assert t.count() == 7
    add(t, [(1, 8, "next")])
    assert got(t)[-1][3] == 9


def test_conflicts(catalog):
    t = make(catalog)
    add(t, [(1, 1, "first"), (1, 1, "second"), (None or 2, None, "n"), (2, None, "m")], on_conflict=["group_id", "version"])
    add(t, [(1, 1, "third"), (1, 2, "new")], on_conflict=["group_id", "version"])
    assert [r[2] for r in got(t)] == ["first", "new", "n", "m"]
    with pytest.raises(UnsupportedOperation):
        add(t, [(1, 1, "x")], on_conflict=["version"], action="update")


def test_returning(catalog):
    t = make(catalog, versions(1, 2))
    out = add(t, [(1, 3, "x"), (2, 1, "y")], returning=True)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3, "x", 3), (2, 1, "y", 1)]


def test_errors(catalog, spark, tmp_path):
    t = make(catalog, versions(1, 2), delta_columns=("content",))
    with pytest.raises(NullGroup, match="group_id"):
        add(t, [(None, 1, "x")])
    with pytest.raises(NullDelta, match="content"):
        add(t, [(1, 1, None)])
    for call in (t.update, t.cluster, t.sample):
        with pytest.raises(UnsupportedOperation):
            call()
    with pytest.raises(UnknownColumn):
        t.append(spark.createDataFrame([(1, 1, "x", 1)], "group_id INT, version INT, content STRING, more INT"))
    for settings, kind in (({"keyframe_every": 0}, ConfigurationError), ({"keyframe_every": 10_001}, ConfigurationError), ({"compress_depth": 0}, ConfigurationError), ({"compress_depth": 65_536}, ConfigurationError), ({"order_by": "content"}, ConfigurationError), ({"group_by": "nope"}, UnknownColumn), ({"delta_columns": ("version",)}, ConfigurationError)):
        with pytest.raises(kind):
            catalog.configure("t", **({"group_by": "group_id"} | settings))
    with pytest.raises(ConfigurationError, match="NOT NULL"):
        catalog.create_table("u", "id INT, body STRING", TableConfig(delta_columns=("body",)))
    with pytest.raises(ConfigurationError, match="order_by"):
        catalog.create_table("v", "body STRING")
    with pytest.raises(ConfigurationError, match="delta column"):
        catalog.create_table("w", "id INT, n INT")
    with pytest.raises(InvalidSequence):
        catalog.create_table("x", "id INT, body STRING, _xp_seq STRING")
    with pytest.raises(NotVersioned):
        catalog.table("missing")
    with pytest.raises(NotVersioned):
        VersionedTable.open(spark, str(tmp_path / "nothing"))
    with pytest.raises(VersionedTableError, match="exists"):
        catalog.create_table("t", DDL)
    assert t.refresh().count() == 2


def test_snapshots_and_conflicts(catalog):
    t = make(catalog, versions(1, 3))
    first = t.version
    other = catalog.table("t")
    add(t, [(1, 4, "x")])
    with pytest.raises(ConcurrentModification):
        add(other, [(1, 4, "y")])
    assert [r[1] for r in got(t.at(first))] == [1, 2, 3] and t.count() == 4
    with pytest.raises(UnsupportedOperation):
        add(t.at(first), [(1, 9, "x")])
    # writers of other buckets do not meet
    buckets = {g: t.spark.range(1).select(t._bucket(F.lit(g))).first()[0] for g in range(1, 20)}
    far = next(g for g in buckets if buckets[g] != buckets[1])
    a, b = catalog.table("t"), catalog.table("t")
    add(a, [(1, 5, "near")])
    add(b, [(far, 1, "far")])
    assert catalog.table("t").count() == 6
    t.refresh().truncate()
    assert t.count() == 0 and t.df().count() == 0
    t.restore(b.version)
    assert t.count() == 6
    assert t.vacuum() > 0
    assert t.df().count() == 6
    with pytest.raises(VersionedTableError, match="vacuumed"):
        t.at(first)


def test_many_commits_use_checkpoints(catalog):
    t = make(catalog)
    for _ in range(45):
        t.configure(t.config)
    assert catalog.table("t").version == 45
    assert t.at(30).version == 30


def test_columns_change(catalog):
    t = make(catalog, versions(1, 3))
    t.add_column("note", T.StringType())
    t.rename_column("content", "body")
    add(t, [(1, 4, "four", "n4")])
    assert t.schema.names == ["group_id", "version", "body", "note", "_xp_seq"]
    assert [(r[2], r[3]) for r in got(t)] == [("Version 1 content", None), ("Version 2 content", None), ("Version 3 content", None), ("four", "n4")]
    t.drop_column("note")
    t.add_column("note", T.IntegerType())
    assert [r[3] for r in got(t)] == [None] * 4
    with pytest.raises(ConfigurationError):
        t.drop_column("version")
    with pytest.raises(UnknownColumn):
        t.rename_column("gone", "x")


def test_new_settings_begin_with_a_keyframe(catalog):
    t = make(catalog, versions(1, 7), keyframe_every=5)
    catalog.configure("t", group_by="group_id", keyframe_every=2)
    t.refresh()
    add(t, [(1, v, f"Version {v} content") for v in range(8, 12)])
    assert [r[1] for r in got(t)] == list(range(1, 12))
    assert sorted(r.seq for r in introspect.inspect(t, 1).where("is_keyframe").collect()) == [1, 6, 8, 10]


def test_catalog(catalog, spark):
    make(catalog, versions(1, 3), keyframe_every=9)
    catalog.create_table("auto", "id INT, body STRING")
    assert catalog.tables() == ["public.auto", "public.t"]
    assert introspect.get_config(catalog.table("auto")).count() == 0
    assert introspect.get_config(catalog.table("t")).first().keyframe_every == 9
    dumped = [r.statement for r in catalog.dump_configs().collect()]
    assert len(dumped) == 1 and '"keyframe_every": 9' in dumped[0]
    assert catalog.load_configs(dumped) == 1
    described = {r.property: r.value for r in introspect.describe(catalog.table("t")).collect()}
    assert described["total_rows"] == "3" and described["column[1]"] == "group_id int (group_by)"
    assert catalog.fix_restored_configs() == 0
    catalog.table("t").copy_to(f"{catalog.root}/spare")
    catalog._files.delete("public/t")
    VersionedTable.create(spark, f"{catalog.root}/public/t", T.StructType.fromDDL(DDL), None, "t")
    assert catalog.fix_restored_configs() == 1
    assert catalog.table("t").config.keyframe_every == 9
    catalog._files.delete("public/t")
    assert catalog.fix_restored_configs() == 0 and catalog.table_config().count() == 0
    catalog.rename_table("auto", "other")
    assert catalog.tables() == ["public.other"]
    catalog.drop_table("other")
    assert catalog.tables() == []


def test_introspection(catalog):
    t = make(catalog, versions(1, 10) + versions(2, 5), keyframe_every=4)
    assert introspect.inspect(t).count() == 15 and introspect.inspect(t, 2).count() == 5
    assert introspect.physical(t, 1, 7).count() == 3 and introspect.physical(t, from_seq=4).count() == 7
    r = introspect.refresh_stats(t).first()
    assert (r.groups_scanned, r.rows_scanned) == (2, 15)
    assert {r.column_name: (r.rows, r.nulls) for r in introspect.analyze(t).collect()}["content"] == (15, 0)
    w = cache.warm_cache_parallel(t, max_workers=2).first()
    assert (w.rows_warmed, w.groups_warmed, w.sections_warmed, w.workers_used) == (15, 2, 5, 2)
    assert cache.warm_cache_parallel(t, max_groups=0).first()[:4] == (0, 0, 0, 0)
    w = cache.warm_cache(t, max_groups=1).first()
    assert w.rows_scanned == 11 and w.groups_warmed == 2
    assert cache.warm_cache(t, max_rows=3).first()[:2] == (3, 1)
    c = cache.cache_stats(t).first()
    assert c.entries_count > 0 and c.cache_max_bytes == 256 << 20
    assert cache.insert_cache_stats(t).first().total_slots == 16
    cache.release(t)
    for call in (lambda: cache.warm_cache(t, max_rows=-1), lambda: cache.warm_cache(t, max_groups=-1), lambda: cache.warm_cache_parallel(t, max_workers=-1)):
        with pytest.raises(ConfigurationError, match="non-negative"):
            call()
    with pytest.raises(NotVersioned):
        cache.warm_cache("t")


def test_history(catalog):
    t = make(catalog, versions(1, 10) + versions(2, 5), keyframe_every=4)
    assert sorted((r.group_id, r.version) for r in history.latest_per_group(t).collect()) == [(1, 10), (2, 5)]
    assert sorted((r.group_id, r.version) for r in history.as_of(t, 7).collect()) == [(1, 7), (2, 5)]
    assert history.next_version(t, 2, "version") == 6 and history.next_version(t, 77, "version") == 1
    assert history.version_diff(t, "content").where("length_change = 1").count() == 1


def test_engine_conf():
    c = EngineConf(cache_size_mb=64)
    assert c.cache_size_mb == 64 and c.show("warm_cache_workers") == 4
    c.set("encode_threads", 8)
    for name, value in (("encode_threads", 65), ("cache_max_entry_kb", 8), ("cache_size_mb", 5), ("nothing", 1)):
        with pytest.raises(ConfigurationError):
            c.set(name, value)
    c.reset("encode_threads")
    assert c.encode_threads == 0


def test_stream(catalog, spark, tmp_path):
    from palimpsest.streaming.sink import append_batches

    t = make(catalog)
    write = append_batches(t, "w")
    rows = spark.createDataFrame(versions(1, 3), DDL)
    write(rows, 0), write(rows, 0), write(rows, 1)
    assert t.refresh().count() == 6


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(catalog):
    t = make(catalog, versions(1, 10) + versions(2, 5), keyframe_every=4)
    one = plan(t.df().where("group_id = 1").select("content"))
    assert "EqualTo(g_group_id,1)" in one and one.count("ArrowEvalPython") == 1 and "Exchange" not in one
    assert "d_content" not in plan(t.df().groupBy("group_id").count())
    assert plan(t.df().where("content like '%3%'").select("content")).count("ArrowEvalPython") == 1
    ranged = plan(t.df(seq=(3, 4)))
    assert "GreaterThanOrEqual(_hi,3)" in ranged and "LessThanOrEqual(_lo,4)" in ranged


def test_random_histories(catalog):
    """Appends and deletes against a list of rows per chain."""
    rng = random.Random(7)
    t = make(catalog, keyframe_every=3, compress_depth=2)
    model: dict[int, list] = {}
    for step in range(6):
        rows = [(g, step * 100 + i, "".join(rng.choices("abc ", k=rng.randrange(60)))) for i, g in enumerate(rng.choices(range(4), k=12))]
        add(t, rows, arrival=["version"])
        for r in rows:
            model.setdefault(r[0], []).append(r)
        g = rng.randrange(4)
        if step % 2 and model.get(g):
            cut = rng.randrange(len(model[g]))
            assert t.delete(f"group_id = {g} AND version = {model[g][cut][1]}") == len(model[g]) - cut
            del model[g][cut:]
    assert got(t) == sorted(((*r, s) for rows in model.values() for s, r in enumerate(rows, 1)), key=lambda r: (str(r[0]), r[-1]))


def test_two_writers_keep_their_scratch(catalog):
    """A write drops its own intermediate tables only, and what it returned outlives later writes."""
    t = make(catalog, versions(1, 4))
    other = catalog.table("t")
    with other._writing():
        held = other._stash(t.spark.range(5))
        first = add(t, versions(2, 3), returning=True)
        assert held.count() == 5
    add(t, versions(2, 2) + versions(3, 1))
    assert sorted((r.group_id, r["_xp_seq"]) for r in first.collect()) == [(2, 1), (2, 2), (2, 3)]
    assert t.store.files.tree("_tmp") == []


def test_returning_with_given_numbers(catalog):
    t = make(catalog, [(1, 1, "a", 1), (1, 2, "b", 6)], DDL + ", _xp_seq BIGINT")
    rows = t.spark.createDataFrame([(1, 9, "x", 3), (2, 9, "y", 5)], "group_id int, version int, content string, _xp_seq bigint")
    out = t.append(rows, returning=True)
    add(t, [(1, 3, "c", None)])
    assert sorted((r.group_id, r.content, r["_xp_seq"]) for r in out.collect()) == [(1, "x", 3), (2, "y", 5)]


def test_vacuum_leaves_files_of_writers_at_work(catalog):
    t = make(catalog, versions(1, 4))
    working = t._write(t._read(t.state.paths()).withColumn("kind", F.lit("tail")))
    add(t, versions(1, 1))
    assert t.vacuum() >= 1  # what the append replaced
    there = {p for p, _ in t.store.files.tree("data")}
    assert set(working) <= there
    assert t.vacuum(orphan_age_s=0) == len(working)
    assert t.df().count() == 5


def test_a_commit_off_the_local_disk_is_one_rename(catalog):
    t = make(catalog, versions(1, 2))
    files = t.store.files
    files.local = False
    assert files.create("_log/x.json", "one") and not files.create("_log/x.json", "two")
    assert files.read("_log/x.json") == "one" and not [n for n in files.names("_log") if n.endswith(".tmp")]
    add(t, versions(2, 2))
    assert t.df().count() == 4


def test_bounds_prune_sections(catalog):
    t = make(catalog, [(g, v, f"text {v}", v * 10 + g) for g in range(3) for v in range(1, 41)], DDL + ", score INT", keyframe_every=10, order_by="version", index_columns=("score",))
    assert t.sections(between={"version": (12, 13)}).count() == 3 and t.sections(between={"score": (None, 45)}).count() == 3
    assert sorted(r.version for r in t.df(group=1, between={"version": (12, 13)}).collect()) == [12, 13]
    assert [r.version for r in t.df(between={"score": (101, 101)}).collect()] == [10]
    plan = t.df(between={"version": (12, 13)})._jdf.queryExecution().executedPlan().toString()
    assert "most_version" in plan.split("PushedFilters", 1)[1]
    with pytest.raises(UnknownColumn):
        t.df(between={"content": ("a", "b")})
    t.delete("version = 15 AND group_id = 1")
    assert t.sections(group=1, between={"version": (15, None)}).count() == 0
    t.add_column("more", T.IntegerType())
    t.configure(t.config.with_values(index_columns=("score", "more")))
    add(t, [(1, 50, "x", 1, 7)])
    assert t.df(between={"more": (7, 7)}).count() == 1  # sections older than the index are looked through


def test_deletes_and_appends_leave_other_files_alone(catalog):
    t = catalog.create_table("t", DDL, TableConfig(group_by="group_id", keyframe_every=5), buckets=1)
    for g in range(4):
        add(t, versions(g, 12))
    before = set(t.state.files)
    t.delete("group_id = 2 AND version = 4")
    gone = before - set(t.state.files)
    assert len(gone) == 2 and t.df().count() == 36 + 3
    before = set(t.state.files)
    add(t, versions(3, 1))
    assert len(before - set(t.state.files)) == 1
    rows = got(t)
    assert t.compact() > 2 and len(t.state.files) == 2 and got(t) == rows and t.compact() == 0


def test_warm_rows_answer_reads(catalog):
    t = make(catalog, versions(1, 8) + versions(2, 8) + versions(3, 8), keyframe_every=4)
    r = cache.warm_cache(t, max_rows=10).first()
    assert (r.rows_scanned, r.groups_warmed) == (10, 2)
    assert [f.count() for f, _ in cache.cache_of(t).frames] == [10]
    assert t.df(group=1).count() == 8 and t.df(group=2).count() == 8 and t.df().count() == 24
    s = cache.cache_stats(t).first()
    assert (s.entries_count, s.hit_count, s.miss_count, s.eviction_count) == (10, 1, 2, 0)
    cache.warm_cache(t)
    assert got(t, seq=(2, 3)) == [(g, v, f"Version {v} content", v) for g in (1, 2, 3) for v in (2, 3)]
    assert "InMemoryTableScan" in t.df()._jdf.queryExecution().executedPlan().toString()
    cache.release(t)
    assert "InMemoryTableScan" not in t.df()._jdf.queryExecution().executedPlan().toString()


def test_renaming_moves_no_data(catalog):
    t = make(catalog, versions(1, 3), name="old")
    files = {p for p, _ in t.store.files.tree("data")}
    t = catalog.rename_table("old", "new")
    assert {p for p, _ in t.store.files.tree("data")} == files and got(t)[0][2] == "Version 1 content"
    assert catalog.tables() == ["public.new"] and [r.table_name for r in catalog.table_config().collect()] == ["new"]
    with pytest.raises(VersionedTableError):
        catalog.rename_table("new", "new")
