"""Registered queries over versioned tables.  Each builds its table from the driver's Parquet and answers through the
engine; the SQL beside it says the same over the raw Parquet."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..conf import TableConfig
from ..functions import json_ops
from ..operators import cache, history, introspect
from ..schema import SEQUENCE
from ..sources.catalog import Catalog, version
from ..sources.store import scratch_root
from ..sources.table import VersionedTable
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_CTE = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, text) AS rn FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
p AS (SELECT *, row_number() OVER (ORDER BY page_id, url) AS rn FROM pages)
"""


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = _CTE + sql
        return f

    return register


_E = "event_id, ts, user_id, event_type, value, props, rn::BIGINT AS _xp_seq"
_C = "conv_id, turn, role, text, rn::BIGINT AS _xp_seq"


# Round trips: scan, encode, decode


@query(f"SELECT {_E} FROM e")
def roundtrip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df()


@query(f"SELECT {_C} FROM c")
def roundtrip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.TALKS).df()


@query("SELECT doc_id, text, lang, source, n_chars, rn::BIGINT AS _xp_seq FROM d")
def roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.DOCUMENTS).df()


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, rn::BIGINT AS _xp_seq FROM o")
def roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.ORDERS).df()


@query(f"SELECT {_C} FROM c")
def roundtrip_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.TALKS, compress_depth=3, keyframe_every=6).df()


@query(f"SELECT {_C} FROM c")
def roundtrip_nozstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.TALKS, enable_zstd=False).df()


@query("SELECT page_id, url, html, rn::BIGINT AS _xp_seq FROM p")
def roundtrip_nogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.PAGES).df()


# Pruned reads


@query(f"SELECT {_E} FROM e WHERE user_id = 7 AND rn = 12")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df(group=7, seq=12)


@query(f"SELECT {_E} FROM e WHERE user_id = 11")
def group_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history(X.built(spark, sf_dir, X.EVENTS), 11)


@query(f"SELECT {_E} FROM e WHERE rn BETWEEN 8 AND 23")
def seq_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df(seq=(8, 23))


@query(f"SELECT {_E} FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_per_group(X.built(spark, sf_dir, X.EVENTS))


@query(f"SELECT {_E} FROM e WHERE rn <= 15 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1")
def as_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.as_of(X.built(spark, sf_dir, X.EVENTS), 15)


@query(f"SELECT {_E} FROM e WHERE ts BETWEEN (SELECT quantile_disc(ts, 0.4) FROM e) AND (SELECT quantile_disc(ts, 0.5) FROM e)")
def order_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose bounds of the order column are outside are not decoded."""
    ts = X.rows(spark, sf_dir, X.EVENTS).groupBy("ts").count().withColumn("upto", F.sum("count").over(Window.orderBy("ts")))
    total = X.rows(spark, sf_dir, X.EVENTS).count()
    low, high = (ts.where(F.col("upto") >= share * total).agg(F.min("ts")).first()[0] for share in (0.4, 0.5))
    return X.built(spark, sf_dir, X.EVENTS).df(between={"ts": (low, high)})


@query(f"SELECT {_E} FROM e WHERE event_id BETWEEN 300 AND 420 AND user_id <> 3")
def index_plain_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS, index_columns=("event_id",)).df(between={"event_id": (300, 420)}).where("user_id <> 3")


@query("SELECT user_id, event_id FROM e WHERE user_id IN (3, 5, 9) OR rn = 1")
def or_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df().where(F.col("user_id").isin(3, 5, 9) | (F.col(SEQUENCE) == 1)).select("user_id", "event_id")


# Filters and expressions on delta columns


@query("SELECT conv_id, turn, text FROM c WHERE text LIKE '%the%'")
def like_on_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.TALKS).df().where(F.col("text").like("%the%")).select("conv_id", "turn", "text")


@query("SELECT event_id, user_id FROM e WHERE event_type = 'click' AND value > 10")
def filter_on_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df().where("event_type = 'click' AND value > 10").select("event_id", "user_id")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'ask' ELSE coalesce(role, '-') END AS kind, length(text)::BIGINT AS n FROM c")
def case_on_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "ask").otherwise(F.coalesce("role", F.lit("-")))
    return X.built(spark, sf_dir, X.TALKS).df().select("conv_id", "turn", kind.alias("kind"), F.length("text").cast("long").alias("n"))


# Aggregates


@query("SELECT count(*)::BIGINT AS n FROM e")
def count_no_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).sections().agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n"))


@query("SELECT user_id, count(*)::BIGINT AS n, min(rn)::BIGINT AS low, max(rn)::BIGINT AS high FROM e GROUP BY user_id")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df().groupBy("user_id").agg(F.count("*").alias("n"), F.min(SEQUENCE).alias("low"), F.max(SEQUENCE).alias("high"))


@query("SELECT conv_id, sum(length(text))::BIGINT AS chars, max(text) AS top FROM c GROUP BY conv_id")
def agg_on_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.TALKS).df().groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.max("text").alias("top"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT props)::BIGINT AS kinds FROM e GROUP BY event_type")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df().groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("kinds"))


@query("SELECT DISTINCT role FROM c")
def distinct_on_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.TALKS).df().select("role").distinct()


@query("SELECT sum(event_id)::BIGINT AS total, min(value) AS least, min(ts) AS first_ts, max(ts) AS last_ts FROM e")
def global_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df().agg(F.sum("event_id").alias("total"), F.min("value").alias("least"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# Joins and subqueries


@query("SELECT o_orderkey, o_orderpriority, c_name FROM o JOIN customer ON o_custkey = c_custkey")
def join_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return X.built(spark, sf_dir, X.ORDERS).df().join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_name")


@query("SELECT d.doc_id, lang FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return X.built(spark, sf_dir, X.DOCUMENTS).df().join(good, "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT o_orderkey, n_name FROM o JOIN nation ON o_custkey BETWEEN n_nationkey * 10 AND n_nationkey * 10 + 1")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    low = F.col("n_nationkey") * 10
    orders = X.built(spark, sf_dir, X.ORDERS).df()
    return orders.join(nations, F.col("o_custkey").between(low, low + 1)).select("o_orderkey", "n_name")


@query("SELECT conv_id, turn, text FROM c x WHERE turn = (SELECT max(turn) FROM c y WHERE y.conv_id = x.conv_id)")
def correlated_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    X.built(spark, sf_dir, X.TALKS).create_view("palimpsest_talks")
    return spark.sql("SELECT conv_id, turn, text FROM palimpsest_talks x WHERE turn = (SELECT max(turn) FROM palimpsest_talks y WHERE y.conv_id = x.conv_id)")


@query("SELECT user_id, event_id FROM e WHERE rn = 1 UNION ALL SELECT user_id, event_id FROM e WHERE rn = 2")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.built(spark, sf_dir, X.EVENTS)
    return t.df(seq=1).unionByName(t.df(seq=2)).select("user_id", "event_id")


# JSON


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k')::INTEGER * 2 AS twice FROM e")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = json_ops.text(F.col("props"), "k")
    return X.built(spark, sf_dir, X.EVENTS).df().select("event_id", k.alias("k"), (k.cast("int") * 2).alias("twice"))


@query("SELECT event_id FROM e WHERE list_contains(json_keys(props), 'k')")
def json_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df().where(json_ops.has_key(F.col("props"), "k")).select("event_id")


@query("SELECT event_id FROM e WHERE json_contains(props, '{\"k\": 3}')")
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df().where(json_ops.contains(F.col("props"), {"k": 3})).select("event_id")


@query("SELECT conv_id, '{\"turns\":' || count(*) || ',\"chars\":' || sum(length(text)) || '}' AS summary FROM c GROUP BY conv_id")
def json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = X.built(spark, sf_dir, X.TALKS).df().groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return totals.select("conv_id", json_ops.object_text(turns=F.col("turns"), chars=F.col("chars")).alias("summary"))


# Order


@query("SELECT event_id, ts FROM e ORDER BY ts, event_id LIMIT 20 OFFSET 10")
def order_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).df().orderBy("ts", "event_id").offset(10).limit(20).select("event_id", "ts")


@query("SELECT conv_id, turn, text FROM c ORDER BY text DESC, conv_id, turn LIMIT 15")
def topk_on_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.TALKS).df().orderBy(F.desc("text"), "conv_id", "turn").limit(15).select("conv_id", "turn", "text")


@query("SELECT conv_id, rn::BIGINT AS _xp_seq, (length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY rn))::BIGINT AS length_change FROM c")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.version_diff(X.built(spark, sf_dir, X.TALKS), "text").select("conv_id", SEQUENCE, F.col("length_change").cast("long"))


@query("SELECT coalesce(max(turn), 0)::BIGINT + 1 AS next_turn FROM c WHERE conv_id = 4")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.TALKS).df(group=4).agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).cast("long").alias("next_turn"))


# Introspection


@query("SELECT user_id, n AS column_name, rn::BIGINT AS seq, (rn - 1) % 10 = 0 AS is_keyframe, CASE WHEN (rn - 1) % 10 = 0 THEN 0 ELSE 1 END AS tag FROM e, (VALUES ('props'), ('event_type')) v(n)")
def keyframe_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = introspect.physical(X.built(spark, sf_dir, X.EVENTS))
    return rows.select(F.col("group_value").cast("long").alias("user_id"), "column_name", "seq", "is_keyframe", "tag")


@query("SELECT (epoch_us(ts) - 946684800000000)::BIGINT AS version, rn::BIGINT AS seq, n AS column_name, (rn - 1) % 10 = 0 AS is_keyframe, CASE WHEN (rn - 1) % 10 = 0 THEN 0 ELSE 1 END AS tag FROM e, (VALUES ('props'), ('event_type')) v(n) WHERE user_id = 7")
def inspect_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.inspect(X.built(spark, sf_dir, X.EVENTS), 7).select("version", "seq", "column_name", "is_keyframe", "tag")


@query("""SELECT count(*)::BIGINT AS total_rows, count(DISTINCT user_id)::BIGINT AS total_groups,
  count_if((rn - 1) % 10 = 0)::BIGINT AS keyframe_count, count_if((rn - 1) % 10 <> 0)::BIGINT AS delta_count,
  sum(strlen(props) + strlen(event_type))::BIGINT AS raw_size_bytes FROM e""")
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.stats(X.built(spark, sf_dir, X.EVENTS)).select("total_rows", "total_groups", "keyframe_count", "delta_count", "raw_size_bytes")


@query("""SELECT user_id::VARCHAR AS group_value, count(*)::BIGINT AS row_count, count_if((rn - 1) % 10 = 0)::BIGINT AS keyframe_count,
  max(rn)::BIGINT AS max_seq, sum(strlen(props) + strlen(event_type))::BIGINT AS raw_size_bytes FROM e GROUP BY user_id""")
def group_stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.group_stats(X.built(spark, sf_dir, X.EVENTS)).select("group_value", "row_count", "keyframe_count", "max_seq", "raw_size_bytes")


@query("SELECT count(DISTINCT user_id)::BIGINT AS groups_scanned, count(*)::BIGINT AS rows_scanned FROM e")
def refresh_stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.refresh_stats(X.built(spark, sf_dir, X.EVENTS)).select("groups_scanned", "rows_scanned")


@query("SELECT user_id::VARCHAR AS group_value, rn::BIGINT AS seq, n AS column_name, (rn - 1) % 10 = 0 AS is_keyframe, CASE WHEN (rn - 1) % 10 = 0 THEN 0 ELSE 1 END AS tag, true AS sized FROM e, (VALUES ('props'), ('event_type')) v(n) WHERE rn > 25")
def physical_from_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = introspect.physical(X.built(spark, sf_dir, X.EVENTS), from_seq=25)
    sized = F.octet_length("delta_bytes") == F.col("delta_size")
    return rows.select("group_value", "seq", "column_name", "is_keyframe", "tag", sized.alias("sized"))


@query("SELECT count(*)::BIGINT AS rows_scanned, count(DISTINCT user_id)::BIGINT AS groups_warmed FROM e")
def warm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.warm_cache(X.built(spark, sf_dir, X.EVENTS)).select("rows_scanned", "groups_warmed")


@query("SELECT 60::BIGINT AS rows_scanned, count(DISTINCT user_id)::BIGINT AS groups_warmed, 60::BIGINT AS entries_count FROM (SELECT user_id FROM e ORDER BY user_id, rn LIMIT 60)")
def warm_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit bounds what is held, not only what is reported."""
    t = X.fresh(spark, sf_dir, X.EVENTS)
    warmed = cache.warm_cache(t, max_rows=60)
    return warmed.crossJoin(cache.cache_stats(t)).select("rows_scanned", "groups_warmed", "entries_count")  # one row each


@query("SELECT 2::BIGINT AS hit_count, 1::BIGINT AS miss_count, 0::BIGINT AS eviction_count, count(*)::BIGINT AS entries_count FROM c WHERE conv_id IN (SELECT DISTINCT conv_id FROM c ORDER BY conv_id LIMIT 5)")
def cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads of a held chain are hits; a read of the whole table, of which only some chains are held, is a miss."""
    t = X.fresh(spark, sf_dir, X.TALKS)
    cache.warm_cache(t, max_groups=5)
    first = t.sections().agg(F.min(t._group_key())).first()[0]
    t.df(group=first), t.df(group=first), t.df()
    return cache.cache_stats(t).select("hit_count", "miss_count", "eviction_count", "entries_count")


@query("""SELECT n AS column_name, count(*)::BIGINT AS rows, 0::BIGINT AS nulls FROM e,
  (VALUES ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value'), ('props'), ('_xp_seq')) v(n) GROUP BY n""")
def analyze_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.analyze(X.built(spark, sf_dir, X.EVENTS)).select("column_name", "rows", "nulls")


@query("SELECT count(*)::BIGINT AS rows, true AS has_files, true AS has_bytes FROM e")
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.EVENTS).size_estimate().select("rows", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


@query("SELECT true AS filled, false AS empty")
def stats_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = introspect.stats_exist(X.built(spark, sf_dir, X.TALKS)), introspect.stats_exist(X.empty(spark, sf_dir, X.TALKS))
    return spark.createDataFrame([row], "filled boolean, empty boolean")


@query("SELECT 1 AS linked, 'public.talks' AS tables, 7 AS keyframe_every")
def restored_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that came back under its name gets its settings again; those of one that is gone are forgotten."""
    catalog = Catalog(spark, scratch_root(spark))
    for name in ("talks", "gone"):
        catalog.create_table(name, "conv_id INT, turn INT, text STRING", TableConfig(group_by="conv_id", keyframe_every=7))
    for name in ("talks", "gone"):
        catalog._files.delete(f"public/{name}")
    VersionedTable.create(spark, catalog._path("talks"), T.StructType.fromDDL("conv_id INT, turn INT, text STRING"), None, "talks")
    linked = catalog.fix_restored_configs()
    found = catalog.refresh("talks")
    return catalog.table_config().agg(F.array_join(F.collect_list(F.concat_ws(".", "schema_name", "table_name")), ",").alias("tables")).select(F.lit(linked).alias("linked"), "tables", F.lit(found.config.keyframe_every).alias("keyframe_every"))


@query("SELECT 'palimpsest 0.1.0 (codec 1, zstd)' AS version")
def engine_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(version(),)], "version string")


@query("""SELECT sum(m)::BIGINT AS rows_warmed, count(*)::BIGINT AS groups_warmed, sum(ceil(m / 10.0))::BIGINT AS sections_warmed, 4::BIGINT AS workers_used
  FROM (SELECT user_id, max(rn) AS m FROM e GROUP BY user_id)""")
def warm_parallel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.warm_cache_parallel(X.built(spark, sf_dir, X.EVENTS)).select("rows_warmed", "groups_warmed", "sections_warmed", "workers_used")


@query("SELECT 'user_id' AS group_by, 'ts' AS order_by, 'props,event_type' AS delta_columns, 10 AS keyframe_every, 1 AS compress_depth, true AS enable_zstd")
def get_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return introspect.get_config(X.built(spark, sf_dir, X.EVENTS)).withColumn("delta_columns", F.array_join("delta_columns", ","))


@query("""SELECT * FROM (VALUES ('table', 'events'), ('config_source', 'explicit'), ('group_by', 'user_id'), ('order_by', 'ts'), ('keyframe_every', '10'),
  ('compress_depth', '1'), ('enable_zstd', 'true'), ('delta_columns', 'props, event_type')) v(property, value)""")
def describe_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["table", "config_source", "group_by", "order_by", "keyframe_every", "compress_depth", "enable_zstd", "delta_columns"]
    return introspect.describe(X.built(spark, sf_dir, X.EVENTS)).where(F.col("property").isin(names))


@query("""SELECT 'configure("public.notes", {"compress_depth": 2, "delta_columns": null, "enable_zstd": true, "group_by": "id", "keyframe_every": 50, "order_by": null})' AS statement""")
def dump_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog(spark, scratch_root(spark))
    catalog.create_table("notes", "id INT, version INT, content STRING", TableConfig(group_by="id", keyframe_every=50, compress_depth=2))
    return catalog.dump_configs()


# Copies and cursors


@query(f"SELECT {_E} FROM e")
def copy_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/out"
    X.built(spark, sf_dir, X.EVENTS).copy_out(path)
    return spark.read.parquet(path)


@query("SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, rn::VARCHAR AS _xp_seq FROM c")
def copy_out_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/out"
    X.built(spark, sf_dir, X.TALKS).copy_out(path, "csv", header="true", quoteAll="true", escape='"')
    return spark.read.csv(path, header=True, multiLine=True, escape='"').select("conv_id", "turn", "role", SEQUENCE)


@query("SELECT event_id, user_id, rn::BIGINT AS _xp_seq FROM e ORDER BY event_id LIMIT 40")
def cursor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a cursor, which holds one partition at a time."""
    rows = islice(X.built(spark, sf_dir, X.EVENTS).cursor("event_id"), 40)
    return spark.createDataFrame([(r.event_id, r.user_id, r[SEQUENCE]) for r in rows], f"event_id long, user_id long, {SEQUENCE} long")


@query(f"SELECT {_C} FROM c")
def storage_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.built(spark, sf_dir, X.TALKS).copy_to(f"{scratch_root(spark)}/copy").df()


@query("""SELECT g::INTEGER AS id, v::INTEGER AS version, repeat('Paragraph ' || g || '. ', v::INTEGER) || 'Edit ' || v AS content,
  v::BIGINT AS _xp_seq FROM range(1, 21) a(g), range(1, 31) b(v)""")
def series_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows made by series, repetition and concatenation, as an edit history."""
    t = VersionedTable.create(spark, scratch_root(spark), T.StructType.fromDDL("id INT, version INT, content STRING NOT NULL"), TableConfig(group_by="id", order_by="version", keyframe_every=8))
    ids = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("id"))
    made = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("version"))
    text = F.concat(F.repeat(F.concat(F.lit("Paragraph "), F.col("id"), F.lit(". ")), F.col("version")), F.lit("Edit "), F.col("version"))
    t.append(made.withColumn("content", text))
    return t.df()


# Mutation


@query("SELECT event_id, ts, user_id, event_type, value, props, rn::BIGINT AS _xp_seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, ts, event_id) AS rn FROM events) WHERE event_id % 3 = 1")
def returning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an append returned stays, whatever is appended after it."""
    t = X.empty(spark, sf_dir, X.EVENTS)
    rows = X.rows(spark, sf_dir, X.EVENTS)
    made = [t.append(rows.where(F.col("event_id") % 3 == part), arrival=X.arrival(X.EVENTS), returning=True) for part in (0, 1, 2)]
    return made[1]


@query("SELECT event_id, ts, user_id, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, ts, event_id)::BIGINT AS _xp_seq FROM events")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.empty(spark, sf_dir, X.EVENTS)
    rows = X.rows(spark, sf_dir, X.EVENTS)
    for part in range(4):
        t.append(rows.where(F.col("event_id") % 4 == part), arrival=X.arrival(X.EVENTS))
    if not t.compact() or t.compact():
        raise RuntimeError("one compaction replaces files, and leaves nothing to the next")
    t.vacuum()
    return t.df()


@query(f"SELECT {_E} FROM e x WHERE rn < coalesce((SELECT min(rn) FROM e y WHERE y.user_id = x.user_id AND y.rn = 14 AND y.user_id % 3 = 0), 1000000000)")
def cascade_delete_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.fresh(spark, sf_dir, X.EVENTS)
    t.delete("_xp_seq = 14 AND user_id % 3 = 0")
    return t.df()


@query(f"SELECT {_E} FROM e WHERE user_id % 5 <> 0")
def cascade_delete_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.fresh(spark, sf_dir, X.EVENTS)
    t.delete("_xp_seq = 1 AND user_id % 5 = 0")
    return t.df()


@query(f"SELECT {_E} FROM e x WHERE rn < coalesce((SELECT min(rn) FROM e y WHERE y.user_id = x.user_id AND y.event_type = 'purchase' AND y.value > 90), 1000000000)")
def cascade_delete_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.fresh(spark, sf_dir, X.EVENTS)
    t.delete("event_type = 'purchase' AND value > 90")
    return t.df()


@query("SELECT conv_id, turn, role, text, rn::BIGINT AS _xp_seq FROM c WHERE rn < 3 UNION ALL SELECT conv_id, turn + 100, role, text, (CASE WHEN n >= 3 THEN 2 ELSE n END + rn)::BIGINT FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM c) WHERE rn <= 2")
def cascade_delete_then_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.fresh(spark, sf_dir, X.TALKS)
    again = t.df(seq=(1, 2)).drop(SEQUENCE).withColumn("turn", F.col("turn") + 100)
    before = again  # of the snapshot it was made from, which deletes leave alone
    t.delete("_xp_seq = 3")
    t.append(before, arrival=X.arrival(X.TALKS))
    return t.df()


@query("SELECT conv_id, turn, role, text, (rn * 2)::BIGINT AS _xp_seq FROM c")
def restore_explicit_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.empty(spark, sf_dir, X.TALKS)
    source = X.built(spark, sf_dir, X.TALKS).df()
    t.append(source.withColumn(SEQUENCE, F.col(SEQUENCE) * 2), arrival=X.arrival(X.TALKS))
    return t.df()


@query(f"SELECT {_E} FROM e")
def on_conflict_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.empty(spark, sf_dir, X.EVENTS)
    rows = X.rows(spark, sf_dir, X.EVENTS)
    t.append(rows.unionByName(rows.where("event_id % 4 = 0")), arrival=X.arrival(X.EVENTS), on_conflict=["event_id"])
    t.append(rows.where("event_id % 3 = 0"), arrival=X.arrival(X.EVENTS), on_conflict=["event_id"])
    return t.df()


@query("SELECT event_id, ts, user_id, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2, ts, event_id)::BIGINT AS _xp_seq FROM events")
def multi_batch_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.empty(spark, sf_dir, X.EVENTS)
    rows = X.rows(spark, sf_dir, X.EVENTS)
    for part in (0, 1):
        t.append(rows.where(F.col("event_id") % 2 == part), arrival=X.arrival(X.EVENTS))
    return t.df()


@query("SELECT conv_id, turn, role, text, rn::BIGINT AS _xp_seq FROM c WHERE conv_id % 2 = 0")
def snapshot_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.empty(spark, sf_dir, X.TALKS)
    rows = X.rows(spark, sf_dir, X.TALKS)
    t.append(rows.where("conv_id % 2 = 0"), arrival=X.arrival(X.TALKS))
    seen = t.version
    t.append(rows.where("conv_id % 2 = 1"), arrival=X.arrival(X.TALKS))
    t.delete("_xp_seq = 2")
    return t.at(seen).df()


@query(f"SELECT {_C} FROM c")
def truncate_reappend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.fresh(spark, sf_dir, X.TALKS)
    t.truncate()
    t.append(X.rows(spark, sf_dir, X.TALKS), arrival=X.arrival(X.TALKS))
    return t.df()


@query(f"SELECT {_C} FROM c")
def restore_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.fresh(spark, sf_dir, X.TALKS)
    before = t.version
    t.truncate()
    t.restore(before)
    t.vacuum()
    return t.df()


@query("SELECT conv_id, turn, role, text AS body, NULL::VARCHAR AS note, rn::BIGINT AS _xp_seq FROM c")
def alter_add_rename_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.fresh(spark, sf_dir, X.TALKS)
    t.add_column("note", T.StringType())
    t.rename_column("text", "body")
    return t.df()


@query("SELECT conv_id, turn, role, text, rn::BIGINT AS _xp_seq, CASE WHEN (CASE WHEN rn <= 2 THEN rn - 1 ELSE (rn - 3) % 2 END) = 0 THEN true ELSE false END AS key FROM c")
def reconfigured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of each chain under K = 3, the rest under K = 2: new settings begin with a keyframe."""
    t = X.empty(spark, sf_dir, X.TALKS)
    source = X.built(spark, sf_dir, X.TALKS)
    t.append(source.df(seq=(1, 2)).drop(SEQUENCE), arrival=X.arrival(X.TALKS))
    t.configure(t.config.with_values(keyframe_every=2))
    t.append(source.df(seq=(3, None)).drop(SEQUENCE), arrival=X.arrival(X.TALKS))
    keys = introspect.physical(t).where("column_name = 'text'").select(F.col("group_value").cast("long").alias("conv_id"), F.col("seq").alias(SEQUENCE), F.col("is_keyframe").alias("key"))
    return t.df().join(keys, ["conv_id", SEQUENCE])


@query(f"SELECT {_C} FROM c")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows arrive as a stream; a batch that is delivered twice counts once."""
    from ..streaming.sink import append_batches, write_stream

    t = X.empty(spark, sf_dir, X.TALKS)
    rows = X.rows(spark, sf_dir, X.TALKS)
    source = scratch_root(spark)
    rows.write.parquet(f"{source}/in")
    run = write_stream(spark.readStream.schema(rows.schema).parquet(f"{source}/in"), t, f"{source}/checkpoint", arrival=X.arrival(X.TALKS))
    run.trigger(availableNow=True).start().awaitTermination()
    append_batches(t, "stream")(rows, 0)
    return t.refresh().df()
