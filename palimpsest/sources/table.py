"""A versioned table: append-only rows in chains, read as an ordinary DataFrame.

Writes are set-based Spark jobs that make new files, and one commit in the log.  All state (sequence numbers, open
sections, counts) comes from the committed snapshot, so an aborted write leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..conf import TableConfig
from ..errors import ConfigurationError, DuplicateSequence, InvalidSequence, NullDelta, NullGroup, UnknownColumn, UnsupportedOperation, VersionedTableError
from ..operators import sections as S
from ..schema import SEQUENCE, Roles, resolve
from .store import Change, File, State, Store

#: Rows of one chain, or bytes of their values, beyond which an append numbers them over many tasks instead of in one window.
HOT_ROWS, HOT_BYTES = 1_000_000, 64 << 20
#: Characters of a text by which rows are dealt to the ranges of such a numbering.
RANGE_CHARS = 64
#: Age from which vacuum takes a file that no commit names for one of an aborted write.
ORPHAN_AGE_S = 7 * 86_400.0
_NULL_GROUP, _NULL_DELTA = "NULL value not allowed in group column", "NULL value not allowed in delta column"


class VersionedTable:
    """One table at one snapshot; its own writes move it on, ``refresh`` follows other writers."""

    def __init__(self, store: Store, state: State, pinned: bool = False) -> None:
        self.store, self.state, self.pinned = store, state, pinned
        self._scratch = ""
        self.spark: SparkSession = store.spark

    # Making and opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, config: TableConfig | None = None, name: str | None = None, buckets: int = 8) -> VersionedTable:
        """Make an empty table.  The sequence column is added, last, where the schema has none."""
        name = name or path.rstrip("/").rsplit("/", 1)[-1]
        for field in schema.fields:
            if field.name == SEQUENCE and not isinstance(field.dataType, T.IntegerType | T.LongType):
                raise InvalidSequence(f'column "{SEQUENCE}" must be INT or BIGINT')
        fields = [f for f in schema.fields if f.name != SEQUENCE]
        whole = T.StructType([*fields, T.StructField(SEQUENCE, T.LongType(), False)])
        resolve(whole, config or TableConfig(), name)
        state = State(0, uuid.uuid4().hex, name, whole, {f.name: f.name for f in fields}, config, 0, buckets)
        store = Store(spark, path)
        return cls(store, store.create(state))

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> VersionedTable:
        store = Store(spark, path)
        return cls(store, store.load(version), version is not None)

    def at(self, version: int) -> VersionedTable:
        """The table as of a commit."""
        return VersionedTable(self.store, self.store.load(version), True)

    def refresh(self) -> VersionedTable:
        self.state = self.store.load()
        return self

    @property
    def name(self) -> str:
        return self.state.name

    @property
    def config(self) -> TableConfig:
        return self.state.config or TableConfig()

    @property
    def schema(self) -> T.StructType:
        return self.state.schema

    @property
    def roles(self) -> Roles:
        return resolve(T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in (self.config.delta_columns or ())) for f in self.schema.fields]), self.config, self.name)

    @property
    def version(self) -> int:
        return self.state.version

    # Reading

    def _read(self, paths: list[str]) -> DataFrame:
        schema = S.physical_schema(self.schema, self.state.physical, self.roles)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{p}" for p in paths])

    def _group_key(self) -> Column:
        """The chain of a section row."""
        roles = self.roles
        return F.col(f"g_{self.state.physical[roles.group_by]}") if roles.group_by else F.lit(0)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.state.buckets)).cast("int") if self.roles.group_by else F.lit(0)

    def sections(self, group: object = None, seq: tuple[int | None, int | None] | None = None, kind: str | None = None, between: Mapping[str, tuple[object, object]] | None = None) -> DataFrame:
        """Physical rows, pruned to a group's bucket, to a range of sequence numbers and (between) to those that can hold
        values of an indexed column within inclusive bounds, of which either may be None."""
        buckets, roles = None, self.roles
        if group is not None:
            if not roles.group_by:
                raise UnknownColumn(f'table "{self.name}" has no group column')
            value = F.lit(group).cast(self.schema[roles.group_by].dataType)
            buckets = {self.spark.range(1).select(self._bucket(value)).first()[0]}
        out = self._read(self.state.paths(kind, buckets))
        if group is not None:
            out = out.where(self._group_key() == value)
        low, high = seq or (None, None)
        if low is not None:
            out = out.where(F.col("_hi") >= low)
        if high is not None:
            out = out.where(F.col("_lo") <= high)
        for name, (low, high) in (between or {}).items():
            if name not in roles.indexed:
                raise UnknownColumn(f'column "{name}" of table "{self.name}" is not indexed')
            kind_of, stored = self.schema[name].dataType, self.state.physical[name]
            for limit, test, bound in ((low, Column.__ge__, f"most_{stored}"), (high, Column.__le__, f"least_{stored}")):
                if limit is not None:  # a section without bounds is older than the index
                    out = out.where(test(F.col(bound), F.lit(limit).cast(kind_of)) | F.col(bound).isNull())
        return out

    def df(self, group: object = None, seq: int | tuple[int | None, int | None] | None = None, between: Mapping[str, tuple[object, object]] | None = None) -> DataFrame:
        """All versions with full values, lazily.  ``group``, ``seq`` (one number, or inclusive bounds) and ``between``
        (inclusive bounds of indexed columns, the order column among them) also prune files, row groups and sections.

        Rows that ``warm_cache`` holds are taken from there."""
        from ..operators import cache

        bounds = (seq, seq) if isinstance(seq, int) else seq
        out = cache.warmed(self, group)
        if out is None:
            out = S.explode(self.sections(group, bounds, between=between), self.schema, self.state.physical, self.roles)
        for name, (low, high) in (between or {}).items():
            if name not in self.roles.indexed:
                raise UnknownColumn(f'column "{name}" of table "{self.name}" is not indexed')
            for limit, test in ((low, F.col(f"`{name}`").__ge__), (high, F.col(f"`{name}`").__le__)):
                out = out.where(test(F.lit(limit).cast(self.schema[name].dataType))) if limit is not None else out
        if bounds is not None:
            for limit, test in ((bounds[0], F.col(SEQUENCE).__ge__), (bounds[1], F.col(SEQUENCE).__le__)):
                out = out.where(test(limit)) if limit is not None else out
        return out

    def create_view(self, name: str) -> None:
        self.df().createOrReplaceTempView(name)

    def count(self) -> int:
        """The number of rows, from the sections' counts."""
        return self._read(self.state.paths()).agg(F.sum("_rows")).first()[0] or 0

    def sample(self, *_: object, **__: object) -> DataFrame:
        raise UnsupportedOperation("TABLESAMPLE is not supported on versioned tables", "sample the DataFrame instead")

    # Appending

    def append(self, rows: DataFrame, arrival: Sequence[str | Column] | None = None, on_conflict: Sequence[str] | None = None, action: str = "nothing", returning: bool = False, batch: tuple[str, int] | None = None) -> DataFrame | None:
        """Add versions.  Those of a chain are numbered in ``arrival`` order: by default the order column, nulls last,
        then the input's own order.  A column of sequence numbers is honoured where it is positive.

        on_conflict: columns whose equal values make a row a repetition, which is left out (``action="nothing"``).
        batch: (writer, number); a number that the writer has committed already is skipped."""
        self._writable()
        if action != "nothing":
            raise UnsupportedOperation("UPDATE is not supported on versioned tables", "use ON CONFLICT DO NOTHING, or append a new version")
        if batch and self.state.batches.get(batch[0], -1) >= batch[1]:
            return self.df().limit(0) if returning else None
        try:
            with self._writing():
                return self._append(rows, arrival, on_conflict, returning, batch)
        except VersionedTableError:
            raise
        except Exception as e:
            text = str(e)
            for mark, kind in ((_NULL_GROUP, NullGroup), (_NULL_DELTA, NullDelta)):
                if mark in text:
                    at = text.index(mark)
                    name = text[at + len(mark) :].split('"')[1]
                    raise kind(f'{mark} "{name}"', "every version belongs to a group" if kind is NullGroup else "") from e
            if "DuplicateSequence" in text:
                number = text.split("sequence number ", 1)[-1].split(" ", 1)[0]
                raise DuplicateSequence(f"sequence number {number} is taken") from e
            raise

    def _writable(self) -> None:
        if self.pinned:
            raise UnsupportedOperation("a past version is read-only", "open the table without a version")

    def _conform(self, rows: DataFrame) -> DataFrame:
        """Logical columns in order, with null checks that fail the job itself; missing columns are null."""
        roles, out = self.roles, []
        unknown = [c for c in rows.columns if c not in self.schema.names]
        if unknown:
            raise UnknownColumn(f'Column "{unknown[0]}" does not exist in table "{self.name}"')
        for f in self.schema.fields:
            if f.name == SEQUENCE:
                continue
            c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
            strict = f.name == roles.group_by or f.name in roles.delta and (not f.nullable or f.name in (self.config.delta_columns or ()))
            if strict:
                mark = _NULL_GROUP if f.name == roles.group_by else _NULL_DELTA
                c = F.when(c.isNull(), F.raise_error(f'{mark} "{f.name}"')).otherwise(c)
            out.append(c.alias(f.name))
        if SEQUENCE in rows.columns:
            out.append(F.col(SEQUENCE).cast("long").alias("__given"))
        return rows.select(*out)

    def _folder(self, kind: str) -> str:
        return f"{kind}/{uuid.uuid4().hex}"

    def _stash(self, df: DataFrame) -> DataFrame:
        """Write an intermediate table beside the data, in this write's own folder, which goes when the write ends."""
        path = f"{self.store.root}/{self._folder(self._scratch)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _append(self, rows: DataFrame, arrival: Sequence[str | Column] | None, on_conflict: Sequence[str] | None, returning: bool, batch: tuple[str, int] | None) -> DataFrame | None:
        state, roles = self.state, self.roles
        config = self.config
        k = config.keyframe_every
        given = SEQUENCE in rows.columns
        order = [F.col(f"`{c}`") if isinstance(c, str) else c for c in arrival] if arrival else [F.col(f"`{roles.order_by}`").asc_nulls_last()]
        new = self._conform(rows)
        key = F.col(f"`{roles.group_by}`") if roles.group_by else F.lit(0)
        new = new.withColumns({"__g": key, "__at": F.monotonically_increasing_id()})
        new = self._stash(new)  # read several times: the rows and their arrival ids must stay what they are
        if on_conflict:
            new = self._stash(self._without_conflicts(new, list(on_conflict), [*order, "__at"]))
        tails = self._read(state.paths("tail")).withColumn("__g", self._group_key())
        before = tails.select("__g", F.col("_hi").alias("__hi"), F.col("_base").alias("__tail_base"), (F.col("_epoch") == state.epoch).alias("__same"))
        counted = new.groupBy("__g").agg(F.count("*").alias("__n"), F.sum(self._width(new.schema)).alias("__bytes")).join(before, "__g", "left")
        hi = F.coalesce("__hi", F.lit(0).cast("long"))
        base = F.when(F.col("__hi").isNull(), 1).when(F.col("__same"), F.col("__tail_base")).otherwise(F.col("__hi") + 1).cast("long")
        chains = self._stash(counted.select("__g", "__n", hi.alias("__hi"), base.alias("__base"), (hi + F.col("__n")).alias("__last"), ((F.col("__n") > HOT_ROWS) | (F.col("__bytes") > HOT_BYTES)).alias("__hot")))
        facts = chains.agg(F.count_if("__hot"), F.count("*"), F.collect_set(self._bucket(F.col("__g")))).first()
        if not facts[1]:
            return self.df().limit(0) if returning else None
        buckets, hot = set(facts[2]), chains.where("__hot")
        chains = chains.drop("__hot")
        if given:
            new, chains = self._numbered_as_given(new, chains, order)
        else:
            numbered = []
            if facts[0]:  # hot chains are few: each has its share of the batch's rows or bytes
                numbered.append(self._numbered_over_tasks(new.join(F.broadcast(hot.select("__g")), "__g", "left_semi"), arrival, order).join(F.broadcast(hot.drop("__hot")), "__g"))
            if facts[0] < facts[1]:
                rank = F.row_number().over(Window.partitionBy("__g").orderBy(*order, "__at"))
                rest = new.join(F.broadcast(hot.select("__g")), "__g", "left_anti") if facts[0] else new
                numbered.append(rest.withColumn("__rn", rank).join(chains, "__g"))
            new = reduce(DataFrame.unionByName, numbered).withColumn("__seq", F.col("__hi") + F.col("__rn"))
        gaps = given and bool(chains.where("__least <= __hi").limit(1).count())
        if gaps and chains.where("__least < __base").limit(1).count():
            raise InvalidSequence("sequence numbers before a change of settings are closed")
        old_paths = self._holding(state.paths(None if gaps else "tail", buckets), chains)
        old = self._read(old_paths).withColumn("__g", self._group_key())
        if gaps:
            tail_of = old.groupBy("__g").agg(F.max("_lo").alias("__tail_lo"))
            old = old.join(tail_of, "__g").withColumn("__was_tail", F.col("_lo") == F.col("__tail_lo")).drop("__tail_lo")
        else:
            old = old.withColumn("__was_tail", F.lit(True))
        sec = F.floor((F.col("__seq") - F.col("__base")) / k).cast("long")
        new = new.withColumn("_sec", sec).withColumn("_base", F.col("__base"))
        first = F.floor((F.col("__hi") + 1 - F.col("__base")) / k).cast("long")  # unless numbers are given, a chain is open from there on
        touched = new.select("__g", "_base", "_sec").distinct() if given else chains.select("__g", F.col("__base").alias("_base"), first.alias("_sec"))
        touched = touched.withColumn("__touched", F.lit(True))
        old = old.join(touched, ["__g", "_base", "_sec"], "left").join(chains.select("__g", "__last"), "__g", "left")
        again = F.col("__touched") & (F.col("_epoch") == state.epoch)
        reopened = S.explode(old.where(again), self.schema, state.physical, roles, ("_base", "_sec", "__last"))
        versions = new.withColumn(SEQUENCE, F.col("__seq")).select(*reopened.columns).unionByName(reopened)
        made = S.encode(versions, self.schema, state.physical, roles, k, config.compress_depth, config.enable_zstd, state.epoch, "__last")
        made = made.withColumn("kind", F.when(F.col("_hi") == F.col("__last"), "tail").otherwise("sealed")).drop("__last")
        still = F.col("__was_tail") & (F.col("__last").isNull() | (F.col("_hi") == F.col("__last")))
        kept = old.where(~F.coalesce(again, F.lit(False))).withColumn("kind", F.when(still, "tail").otherwise("sealed"))
        kept = kept.select(*made.columns)
        add = self._write(made.unionByName(kept))
        self.state = self.store.commit(state, Change(add, tuple(old_paths), frozenset(buckets), batch=batch))
        return self._appended(sorted(add), old_paths, state, roles) if returning else None

    def _appended(self, added: list[str], replaced: list[str], state: State, roles: Roles) -> DataFrame:
        """The rows of the added files that the files they replace had not: both stay what they are whatever is appended."""
        key = F.col(f"`{roles.group_by}`") if roles.group_by else F.lit(0)
        before = self._read(replaced).select(self._group_key().alias("__g"), F.explode("_seqs").alias("__s"))
        now = S.explode(self._read(added), self.schema, state.physical, roles).withColumn("__k", key)
        return now.join(before, (F.col("__k") == F.col("__g")) & (F.col(SEQUENCE) == F.col("__s")), "left_anti").drop("__k")

    def _holding(self, paths: list[str], chains: DataFrame) -> list[str]:
        """Those of ``paths`` that hold a section of one of the chains (__g).  Only the group column is read."""
        if len(paths) < 2 or not self.roles.group_by:
            return paths
        files = self._read(paths).select(self._group_key().alias("__g"), F.col("_metadata.file_path").alias("__file"))
        names = {r[0] for r in files.join(chains.select("__g"), "__g", "left_semi").select("__file").distinct().collect()}  # files, as the log lists them
        ends = {unquote(n).rsplit("/data/", 1)[-1] for n in names}
        return [p for p in paths if unquote(p).split("data/", 1)[-1] in ends]

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """One write: its scratch folder is its own, whoever else writes."""
        before, self._scratch = self._scratch, f"_tmp/{uuid.uuid4().hex}"
        try:
            yield
        finally:
            self.store.files.delete(self._scratch)
            self._scratch = before

    def _without_conflicts(self, new: DataFrame, keys: list[str], order: list) -> DataFrame:
        """Rows whose key no stored row has, the first of each key; a null in the key conflicts with nothing.

        A key with the group column can only be in files that hold one of the rows' chains: no other is read."""
        for name in keys:
            if name not in self.schema.names:
                raise UnknownColumn(f'Column "{name}" does not exist in table "{self.name}"')
        paths = self.state.paths()
        if self.roles.group_by in keys:
            buckets = set(new.agg(F.collect_set(self._bucket(F.col("__g")))).first()[0])
            paths = self._holding(self.state.paths(None, buckets), new.select("__g"))
        stored = S.explode(self._read(paths), self.schema, self.state.physical, self.roles)
        stored = stored.select(*[F.col(f"`{n}`").alias(f"__k{i}") for i, n in enumerate(keys)])
        equal = reduce(lambda a, b: a & b, [F.col(f"`{n}`") == F.col(f"__k{i}") for i, n in enumerate(keys)])
        fresh = new.join(stored, equal, "left_anti")
        some_null = reduce(lambda a, b: a | b, [F.col(f"`{n}`").isNull() for n in keys])
        first = F.row_number().over(Window.partitionBy(*[f"`{n}`" for n in keys]).orderBy(*order))
        whole = fresh.where(~some_null).withColumn("__nth", first).where("__nth = 1").drop("__nth")
        return whole.unionByName(fresh.where(some_null))

    def _width(self, schema: T.StructType) -> Column:
        """About how many bytes a row's values take."""
        fixed = lambda kind: not isinstance(kind, T.StringType | T.BinaryType | T.ArrayType | T.MapType | T.StructType)
        sizes = [F.coalesce(F.octet_length(c if isinstance(f.dataType, T.BinaryType) else c.cast("string")), F.lit(0)) for f in schema.fields if not fixed(f.dataType) for c in [F.col(f"`{f.name}`")]]
        return reduce(lambda a, b: a + b, sizes, F.lit(8 * len(schema.fields)).cast("long"))

    def _ranges(self, new: DataFrame, arrival: Sequence[str | Column] | None, order: list[Column]) -> list[Column]:
        """What deals rows to ranges that follow ``order``: whole values of the columns before the first text, and its
        beginning, as a sample of these values goes to the driver."""
        by = [F.col("__g")]
        for name, c in zip(arrival or [None] * len(order), order, strict=True):
            if isinstance(name, str) and new.schema[name].dataType == T.StringType():
                return [*by, F.substring(c, 1, RANGE_CHARS)]
            by.append(c)
        return [*by, F.col("__at")]

    def _numbered_over_tasks(self, new: DataFrame, arrival: Sequence[str | Column] | None, order: list[Column]) -> DataFrame:
        """__rn without bringing a chain into one task: sorted ranges, their counts, and a place in the range."""
        by = ["__g", *order, "__at"]
        dealt = new.repartitionByRange(*self._ranges(new, arrival, order)).sortWithinPartitions(*by)
        placed = dealt.withColumns({"__part": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()})
        placed = self._stash(placed)
        pieces = placed.groupBy("__g", "__part").agg(F.min("__pos").alias("__first"), F.count("*").alias("__size"))
        earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
        joined = placed.join(F.broadcast(pieces), ["__g", "__part"])  # no more than there are ranges and hot chains
        return joined.withColumn("__rn", F.col("__before") + F.col("__pos") - F.col("__first") + 1).drop("__part", "__pos", "__first", "__before")

    def _numbered_as_given(self, new: DataFrame, chains: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
        """Positive given numbers are kept; the others follow the largest so far, as row by row inserts would."""
        upto = Window.partitionBy("__g").orderBy(*order, "__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.col("__given") > 0
        rows = new.join(chains.select("__g", "__hi", "__base"), "__g")
        rows = rows.withColumn("__auto", F.sum(F.when(own, 0).otherwise(1)).over(upto))
        rows = rows.withColumn("__lead", F.max(F.when(own, F.col("__given") - F.col("__auto"))).over(upto))
        seq = F.when(own, F.col("__given")).otherwise(F.col("__auto") + F.greatest("__hi", "__lead"))
        rows = self._stash(rows.withColumn("__seq", seq.cast("long")).drop("__auto", "__lead", "__hi", "__base"))
        ends = rows.groupBy("__g").agg(F.max("__seq").alias("__most"), F.min("__seq").alias("__least"))
        chains = self._stash(chains.drop("__last").join(ends, "__g").withColumn("__last", F.greatest("__most", "__hi")).drop("__most"))
        return rows.join(chains, "__g"), chains

    def _write(self, made: DataFrame) -> dict[str, File]:
        folder = self._folder("data")
        key = [f"g_{self.state.physical[self.roles.group_by]}"] if self.roles.group_by else []
        made = made.withColumn("bucket", self._bucket(F.col(key[0])) if key else F.lit(0))
        dealt = made.hint("rebalance", "bucket", "kind").sortWithinPartitions("bucket", "kind", *key, "_lo")
        dealt.write.partitionBy("bucket", "kind").parquet(f"{self.store.root}/{folder}")
        found = {}
        for path, size in self.store.files.tree(folder):
            if path.endswith(".parquet"):
                parts = dict(p.split("=", 1) for p in path.split("/") if "=" in p)
                found[path] = File(int(parts["bucket"]), parts["kind"], size)
        return found

    # Removing

    def delete(self, condition: str | Column) -> int:
        """Remove every matching version and all later ones of its chain; the number of versions removed."""
        self._writable()
        with self._writing():
            return self._delete(condition)

    def _delete(self, condition: str | Column) -> int:
        state, roles = self.state, self.roles
        matched = self.df().where(condition).withColumn("__g", F.col(f"`{roles.group_by}`") if roles.group_by else F.lit(0))
        cuts = self._stash(matched.groupBy("__g").agg(F.min(SEQUENCE).alias("__cut")))
        buckets = set(cuts.agg(F.collect_set(self._bucket(F.col("__g")))).first()[0])
        if not buckets:
            return 0
        before = self.count()
        paths = self._holding(state.paths(None, buckets), cuts)  # files without one of the chains stay as they are
        kinds = [self._read(p).withColumns({"__g": self._group_key(), "kind": F.lit(kind)}) for kind in ("sealed", "tail") if (p := [x for x in paths if state.files[x].kind == kind])]
        old = reduce(DataFrame.unionByName, kinds)
        last = old.select("__g", "_lo").join(cuts, "__g").where("_lo < __cut").groupBy("__g").agg(F.max("_lo").alias("__tail"))
        marked = old.join(cuts, "__g", "left").join(last, "__g", "left")
        kept = S.cut_before(marked, F.col("__cut"), roles, state.physical)
        kind = F.when(F.col("__cut").isNull(), F.col("kind")).when(F.col("_lo") == F.col("__tail"), "tail").otherwise("sealed")
        columns = S.physical_schema(self.schema, state.physical, roles).names
        add = self._write(kept.withColumn("kind", kind).select(*columns, "kind"))
        self.state = self.store.commit(state, Change(add, tuple(paths), frozenset(buckets)))
        return before - self.count()

    def compact(self, most: int = 1) -> int:
        """Write anew the files of each bucket and kind that has more than ``most`` of them; the number of files replaced."""
        self._writable()
        state = self.state
        of: dict[tuple[int, str], list[str]] = {}
        for path, f in state.files.items():
            of.setdefault((f.bucket, f.kind), []).append(path)
        many = {key: paths for key, paths in of.items() if len(paths) > most}
        if not many:
            return 0
        kinds = [self._read(p).withColumn("kind", F.lit(kind)) for kind in ("sealed", "tail") if (p := sorted(x for (_, k), paths in many.items() if k == kind for x in paths))]
        paths = sorted(p for some in many.values() for p in some)
        add = self._write(reduce(DataFrame.unionByName, kinds))
        self.state = self.store.commit(state, Change(add, tuple(paths), frozenset(b for b, _ in many)))
        return len(paths)

    def truncate(self) -> None:
        self._writable()
        self.state = self.store.commit(self.state, Change({}, tuple(self.state.files), None))

    def restore(self, version: int) -> None:
        """Commit a past snapshot's rows as the newest version."""
        self._writable()
        past = self.store.load(version)
        if (past.schema, past.physical) != (self.state.schema, self.state.physical):
            raise ConfigurationError(f"version {version} has other columns")
        gone = tuple(p for p in self.state.files if p not in past.files)
        self.state = self.store.commit(self.state, Change({p: f for p, f in past.files.items() if p not in self.state.files}, gone, None))

    def vacuum(self, keep_versions: int = 1, orphan_age_s: float = ORPHAN_AGE_S) -> int:
        """Delete files that none of the newest ``keep_versions`` snapshots holds; the number of files deleted.

        A file that no commit names may belong to a writer at work: it goes once it is ``orphan_age_s`` old."""
        self._writable()
        self.refresh()
        oldest = max(self.state.oldest, self.state.version - keep_versions + 1, 0)
        held: set[str] = set()
        for v in range(oldest, self.state.version + 1):
            held |= set(self.store.load(v).files)
        self.state = self.store.commit(self.state, Change(buckets=None, settings={"oldest": json.dumps(oldest)}))
        committed = {p for _, c in self.store.history() for p in c.add} | set(self.store.load(oldest).files)
        stamped = [x for x in self.store.files.stamped("data") if x[0].endswith(".parquet") and x[0] not in held]
        gone = [p for p, _, age in stamped if p in committed or age >= orphan_age_s]
        for p in gone:
            self.store.files.delete(p)
        for p, _, age in self.store.files.stamped("_tmp"):
            if age >= orphan_age_s:
                self.store.files.delete(p)
        return len(gone)

    def size_estimate(self) -> DataFrame:
        """files, bytes and rows of the snapshot: sizes from the log, rows from the sections' counts."""
        files = self.state.files.values()
        return self.spark.createDataFrame([(len(files), sum(f.size for f in files), self.count())], "files long, bytes long, rows long")

    def copy_out(self, path: str, kind: str = "parquet", **options: str) -> None:
        """Write all versions with whole values as files of a format that Spark knows."""
        self.df().write.format(kind).options(**options).save(path)

    def cursor(self, *order: str) -> Iterator[Row]:
        """Rows one by one, a partition at a time in the driver's memory."""
        rows = self.df().orderBy(*[f"`{n}`" for n in order]) if order else self.df()
        return rows.toLocalIterator()

    def update(self, *_: object, **__: object) -> None:
        raise UnsupportedOperation("UPDATE is not supported on versioned tables", "append a new version instead")

    def cluster(self, *_: object, **__: object) -> None:
        raise UnsupportedOperation("CLUSTER is not supported on versioned tables", "use vacuum()")

    def copy_to(self, path: str) -> VersionedTable:
        """A copy of all files, log included."""
        self.store.files.copy_to(path)
        return VersionedTable.open(self.spark, path)

    # Settings and columns

    def configure(self, config: TableConfig) -> None:
        """Check and set; holds for rows appended from now on.  The open section of each chain is closed."""
        self._writable()
        roles = resolve(self.schema, config, self.name)
        if self.state.files and (roles.group_by, set(roles.delta)) != (self.roles.group_by, set(self.roles.delta)):
            raise ConfigurationError("group and delta columns of a table with rows cannot change")
        settings = {"config": config.to_json(), "epoch": json.dumps(self.state.epoch + 1)}
        self.state = self.store.commit(self.state, Change(buckets=None, settings=settings))

    def _set_columns(self, fields: list[T.StructField], physical: dict[str, str], config: TableConfig | None) -> None:
        self._writable()
        schema = T.StructType(fields)
        roles = resolve(T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in ((config and config.delta_columns) or ())) for f in fields]), config or TableConfig(), self.name)
        del roles
        settings = {"schema": schema.json(), "physical": json.dumps(physical), "config": config.to_json() if config else ""}
        self.state = self.store.commit(self.state, Change(buckets=None, settings=settings))

    def _fixed_roles(self) -> TableConfig:
        """The roles in force, named: a new column must not change what older files mean."""
        roles = self.roles
        return self.config.with_values(group_by=roles.group_by, order_by=roles.order_by, delta_columns=roles.delta)

    def add_column(self, name: str, kind: T.DataType) -> None:
        """A plain column; older versions have null."""
        if name in self.schema.names:
            raise ConfigurationError(f'column "{name}" of table "{self.name}" already exists')
        stored = name if name not in self.state.physical.values() and not self._ever(name) else f"{name}_{uuid.uuid4().hex[:8]}"
        fields = [*self.schema.fields[:-1], T.StructField(name, kind), self.schema.fields[-1]]
        self._set_columns(fields, self.state.physical | {name: stored}, self._fixed_roles())

    def _ever(self, stored: str) -> bool:
        names = {n for _, c in self.store.history() if "physical" in c.settings for n in json.loads(c.settings["physical"]).values()}
        return stored in names or stored in self.store.load(0).physical.values() if self.state.oldest == 0 else True

    def rename_column(self, old: str, new: str) -> None:
        self._known(old)
        if new in self.schema.names:
            raise ConfigurationError(f'column "{new}" of table "{self.name}" already exists')
        swap = lambda n: new if n == old else n
        fields = [T.StructField(swap(f.name), f.dataType, f.nullable) for f in self.schema.fields]
        config = self._fixed_roles()
        config = config.with_values(group_by=config.group_by and swap(config.group_by), order_by=swap(config.order_by), delta_columns=tuple(map(swap, config.delta_columns)), index_columns=tuple(map(swap, config.index_columns)))
        self._set_columns(fields, {swap(n): p for n, p in self.state.physical.items()}, config)

    def drop_column(self, name: str) -> None:
        self._known(name)
        config = self._fixed_roles()
        if name in (config.group_by, config.order_by):
            raise ConfigurationError(f'column "{name}" orders or groups the table')
        config = config.with_values(delta_columns=tuple(n for n in config.delta_columns if n != name), index_columns=tuple(n for n in config.index_columns if n != name))
        if not config.delta_columns:
            raise ConfigurationError("versioned tables require at least one delta column")
        fields = [f for f in self.schema.fields if f.name != name]
        self._set_columns(fields, {n: p for n, p in self.state.physical.items() if n != name}, config)

    def _known(self, name: str) -> None:
        if name not in self.schema.names or name == SEQUENCE:
            raise UnknownColumn(f'Column "{name}" does not exist in table "{self.name}"')

    def renamed(self, name: str) -> None:
        self._writable()
        self.state = self.store.commit(self.state, Change(buckets=None, settings={"name": json.dumps(name)}))

    def with_state(self, **values: object) -> VersionedTable:
        return VersionedTable(self.store, replace(self.state, **values), True)
