"""Sections: the rows of one group from one keyframe to before the next, as one physical row of arrays.

Physical columns: g_<group>, the section's bounds and counts (_lo, _hi, _base, _sec, _k, _epoch, _rows, _keys, _raw,
_stored, _tags), least_ and most_<column> of the order column and the indexed ones, _seqs, p_<plain> arrays, and for each delta column d_ (blobs), t_ (tags) and r_ (raw sizes) arrays.
Filters on the group reach the Parquet scan; columns that a query does not use are neither read nor decoded.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptChain, DuplicateSequence, VersionedTableError
from ..functions import codec
from ..schema import SEQUENCE, Roles

#: Bytes that a worker holds as Python objects at a time, besides one section.
PIECE = 4 << 20
#: Bytes of an Arrow array of strings.
MOST = (1 << 31) - 1

COUNTS = ("_lo", "_hi", "_base", "_sec", "_k", "_epoch", "_rows", "_keys", "_raw", "_stored")


def physical_schema(schema: T.StructType, physical: dict[str, str], roles: Roles) -> T.StructType:
    out = []
    if roles.group_by:
        out.append(T.StructField(f"g_{physical[roles.group_by]}", schema[roles.group_by].dataType))
    out += [T.StructField(n, T.LongType()) for n in COUNTS] + [T.StructField("_tags", T.DoubleType()), T.StructField("_seqs", T.ArrayType(T.LongType()))]
    out += [T.StructField(f"{x}_{physical[n]}", schema[n].dataType) for n in roles.indexed for x in ("least", "most")]
    out += [T.StructField(f"p_{physical[n]}", T.ArrayType(schema[n].dataType)) for n in roles.plain]
    for n in roles.delta:
        out += [T.StructField(f"d_{physical[n]}", T.ArrayType(T.BinaryType())), T.StructField(f"t_{physical[n]}", T.ArrayType(T.IntegerType())), T.StructField(f"r_{physical[n]}", T.ArrayType(T.LongType()))]
    return T.StructType(out)


# Decoding


def _give_back() -> None:
    """Return what this worker freed to the system: an idle one stays beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _pieces(ends: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of sections of at most PIECE bytes, or of one section.  ends: where in ``size``, the sum of bytes up to each row,
    each section begins, and the last one ends."""
    at, start = size[ends], 0
    while start < len(ends) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + PIECE, "right")) - 1)
        yield start, end
        start = end


def _upto(values: pa.Array) -> np.ndarray:
    """The sum of the bytes of binary or string values before each row, and of all."""
    return np.append(0, np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64))


def _decode_lists(blobs: pa.ListArray, seqs: pa.ListArray, kind: pa.DataType) -> pa.Array:
    """Values go, piece by piece, from Python's objects to the one buffer that the answer is made of."""
    decode = codec.decode
    offsets, at = np.asarray(blobs.offsets).astype(np.int64), np.asarray(seqs.offsets).astype(np.int64)
    numbers, flat = seqs.values.to_numpy(), blobs.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    data, sizes, known = bytearray(), np.zeros(len(flat), np.int64), np.ones(len(flat), bool)
    for first, last in _pieces(offsets, _upto(flat)):
        begin = int(offsets[first])
        held = flat.slice(begin, int(offsets[last]) - begin).to_pylist()
        for i in range(first, last):
            start, end = int(offsets[i]), int(offsets[i + 1])
            if start == end:
                continue
            own = numbers[at[i] : at[i + 1]]
            place = None if own[-1] - own[0] == len(own) - 1 else {s: j for j, s in enumerate(own.tolist())}
            values: list[bytes | None] = []
            for j, blob in enumerate(held[start - begin : end - begin]):
                if blob is None:
                    values.append(None)
                    known[start + j] = False
                    continue
                tag = codec.tag_of(blob)
                base = None
                if tag:
                    b = j - tag if place is None else place.get(int(own[j]) - tag, -1)
                    if b < 0 or b >= j or values[b] is None:
                        raise CorruptChain(f"invalid base sequence {int(own[j]) - tag} of sequence {int(own[j])}")
                    base = values[b]
                value = decode(base, blob)
                values.append(value)
                data += value
                sizes[start + j] = len(value)
            if len(data) > MOST:
                raise VersionedTableError("a batch of sections has more than 2 GB of values", "lower spark.sql.execution.arrow.maxRecordsPerBatch")
    _give_back()
    valid = None if known.all() else pa.py_buffer(np.packbits(known, bitorder="little"))
    bounds = pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32))
    values = pa.Array.from_buffers(kind, len(flat), [valid, bounds, pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pc.is_null(blobs) if blobs.null_count else None)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _decode_strings(blobs: pa.Array, seqs: pa.Array) -> pa.Array:
    return _decode_lists(blobs, seqs, pa.string())


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _decode_binaries(blobs: pa.Array, seqs: pa.Array) -> pa.Array:
    return _decode_lists(blobs, seqs, pa.binary())


def decoded(name: str, kind: T.DataType) -> Column:
    """The values of a delta column of a section.  Never null, so a filter on a value does not decode twice."""
    udf, empty = (_decode_binaries, "array<binary>") if isinstance(kind, T.BinaryType) else (_decode_strings, "array<string>")
    return F.coalesce(udf(F.col(f"d_{name}"), F.col("_seqs")), F.array().cast(empty))


def explode(sections: DataFrame, schema: T.StructType, physical: dict[str, str], roles: Roles, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per version: the logical columns, the sequence number last, before that the section columns ``keep``."""
    group = [F.col(f"g_{physical[roles.group_by]}").alias("__g")] if roles.group_by else []
    arrays = [F.col(f"p_{physical[n]}").alias(f"__p{i}") for i, n in enumerate(roles.plain)]
    arrays += [decoded(physical[n], schema[n].dataType).alias(f"__d{i}") for i, n in enumerate(roles.delta)]
    ready = sections.select(*group, *keep, "_seqs", *arrays)
    rows = ready.select("*", F.posexplode("_seqs").alias("__i", SEQUENCE))
    at = {roles.group_by: F.col("__g")} if roles.group_by else {}
    at |= {n: F.get(f"__p{i}", F.col("__i")) for i, n in enumerate(roles.plain)}
    at |= {n: F.get(f"__d{i}", F.col("__i")) for i, n in enumerate(roles.delta)}
    return rows.select(*[at[f.name].alias(f.name) for f in schema.fields if f.name != SEQUENCE], *keep, SEQUENCE)


# Encoding


def _section_edges(columns: list[pa.Array]) -> np.ndarray:
    """Rows at which a new section begins: where one of the key columns changes."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        try:
            changed = pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        except pa.ArrowNotImplementedError:
            values = c.to_pylist()
            changed = np.array([a != b for a, b in zip(values[1:], values[:-1], strict=True)], bool)
        new[1:] |= changed.astype(bool)
    return np.flatnonzero(new)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def encode_values(seqs: list[int], values: list[bytes | None], start: int, depth: int, zstd: bool) -> tuple[list[bytes | None], list[int | None]]:
    """Blobs and tags of one section's values: the smallest encoding, ties to the lowest tag."""
    blobs: list[bytes | None] = []
    tags: list[int | None] = []
    gaps = seqs[-1] - seqs[0] != len(seqs) - 1
    place: dict[int, int] = {}
    for j, (seq, value) in enumerate(zip(seqs, values, strict=True)):
        best, tag = None, 0
        if value is not None and seq != start:
            for t in range(1, min(depth, seq - start, codec.MAX_TAG) + 1):
                b = place.get(seq - t, -1) if gaps else j - t
                if b < 0:
                    if gaps:
                        continue
                    break
                if values[b] is None:
                    continue
                blob = codec.encode_delta(t, values[b], value, zstd)
                if best is None or len(blob) < len(best):
                    best, tag = blob, t
        if value is None:
            blobs.append(None), tags.append(None)
        else:
            blobs.append(codec.encode_keyframe(value, zstd) if best is None else best)
            tags.append(tag)
        place[seq] = j
    return blobs, tags


def encode(rows: DataFrame, schema: T.StructType, physical: dict[str, str], roles: Roles, k: int, depth: int, zstd: bool, epoch: int, carry: str | None = None) -> DataFrame:
    """Section rows from version rows with _base, _sec and the sequence number.  carry: a long column, the same for all
    rows of a section, that is kept.

    Sections are independent, so they, not groups, are what is dealt to tasks."""
    group = f"g_{physical[roles.group_by]}" if roles.group_by else None
    key = ([group] if group else []) + ["_base", "_sec"]
    names = [roles.group_by] if group else []
    flat = rows.select(*[F.col(f"`{n}`").alias(group) for n in names], "_base", "_sec", F.col(SEQUENCE).alias("_seq"), *[F.col(f"`{n}`").alias(f"p_{physical[n]}") for n in roles.plain], *[F.col(f"`{n}`").alias(f"d_{physical[n]}") for n in roles.delta], *[carry] * bool(carry))
    whole = physical_schema(schema, physical, roles)
    bounds = {f"{x}_{physical[n]}": f"p_{physical[n]}" for n in roles.indexed for x in ("least", "most")}
    out = T.StructType([f for f in whole.fields if f.name not in bounds])
    if carry:
        out = out.add(carry, T.LongType())
    first = len(key)
    n_plain = len(roles.plain)

    def sections(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(i).combine_chunks() for i in range(table.num_columns)]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        heads = _section_edges(columns[:first])
        cuts = np.append(heads, table.num_rows)
        seqs = columns[first].to_numpy()
        base, sec = columns[first - 2].to_numpy()[heads], columns[first - 1].to_numpy()[heads]
        twice = np.flatnonzero((np.diff(seqs) == 0) & ~np.isin(np.arange(1, len(seqs)), heads))
        if len(twice):
            raise DuplicateSequence(f"sequence number {seqs[twice[0]]} is taken")
        offsets = pa.array(cuts, pa.int32())
        lists = lambda values: pa.ListArray.from_arrays(offsets, values)
        start = base + sec * k
        numbers = seqs.tolist()
        keyed = seqs == np.repeat(start, np.diff(cuts))
        tag_sum, tag_n = np.zeros(len(seqs)), np.zeros(len(seqs))
        raw_sum, stored_sum = np.zeros(len(seqs), np.int64), np.zeros(len(seqs), np.int64)
        deltas = []
        for c in columns[first + 1 + n_plain :][: len(roles.delta)]:
            values, blobs, tags = _bytes(c), [], []
            for s, a, b in zip(start.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                x, y = encode_values(numbers[a:b], values[a:b], s, depth, zstd)
                blobs += x
                tags += y
            raw = [None if v is None else len(v) for v in values]
            known = np.array([t is not None for t in tags])
            tag = np.array([t or 0 for t in tags])
            keyed |= known & (tag == 0)
            tag_sum += tag
            tag_n += known
            raw_sum += np.array([r or 0 for r in raw], np.int64)
            stored_sum += np.array([0 if b is None else len(b) + 4 for b in blobs], np.int64)
            deltas += [lists(pa.array(blobs, pa.binary())), lists(pa.array(tags, pa.int32())), lists(pa.array(raw, pa.int64()))]
        total = lambda x: np.add.reduceat(x, heads)
        each = np.divide(tag_sum, tag_n, out=np.zeros(len(seqs)), where=tag_n > 0)
        full = np.full(len(heads), k), np.full(len(heads), epoch)
        counts = [seqs[heads], seqs[cuts[1:] - 1], base, sec, *full, np.diff(cuts), total(keyed.astype(np.int64)), total(raw_sum), total(stored_sum)]
        arrays = [columns[0].take(pa.array(heads))] if group else []
        arrays += [pa.array(np.asarray(x, np.int64)) for x in counts] + [pa.array(total(each)), lists(columns[first])]
        arrays += [lists(c) for c in columns[first + 1 : first + 1 + n_plain]] + deltas
        arrays += [columns[-1].take(pa.array(heads))] if carry else []
        return pa.RecordBatch.from_arrays(arrays, out.names)

    def whole_sections(done: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(done).combine_chunks() if len(done) > 1 else pa.Table.from_batches(done)
        if not table.num_rows:
            return
        batch = table.to_batches()[0]
        size = sum(_upto(batch.column(i)) for i in range(first + 1 + n_plain, first + 1 + n_plain + len(roles.delta)))
        edges = np.append(_section_edges(batch.columns[:first]), batch.num_rows)
        for a, b in _pieces(edges, size):
            yield sections(pa.Table.from_batches([batch.slice(int(edges[a]), int(edges[b] - edges[a]))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the section that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = _section_edges(batch.columns[:first])
            if held:
                last = [pa.concat_arrays([held[-1].column(i).slice(held[-1].num_rows - 1), batch.column(i).slice(0, 1)]) for i in range(first)]
                if len(_section_edges(last)) < 2:
                    edges = edges[1:]
            if len(edges):
                cut = int(edges[-1])
                if held:  # the section that went on is whole
                    yield from whole_sections([*held, batch.slice(0, int(edges[0]))])
                    held = []
                yield from whole_sections([batch.slice(int(edges[0]), cut - int(edges[0]))])
            else:
                cut = 0
            held.append(batch.take(pa.array(np.arange(cut, batch.num_rows))))  # a copy: a slice would hold the whole batch
            del batch
        if held:
            yield from whole_sections(held)
        held.clear()
        _give_back()

    dealt = flat.repartition(*key).sortWithinPartitions(*key, "_seq")
    made = dealt.mapInArrow(run, out)
    return made.withColumns(_bounds(roles, physical)).select(*whole.names, *[carry] * bool(carry))


def _bounds(roles: Roles, physical: dict[str, str]) -> dict[str, Column]:
    """least_ and most_ columns of sections from their arrays; nulls have no part in them."""
    least = {f"least_{physical[n]}": F.array_min(f"p_{physical[n]}") for n in roles.indexed}
    return least | {f"most_{physical[n]}": F.array_max(f"p_{physical[n]}") for n in roles.indexed}


def cut_before(sections: DataFrame, limit: Column, roles: Roles, physical: dict[str, str]) -> DataFrame:
    """Sections without the versions from ``limit`` on.  What remains of a section needs no new encoding."""
    some = F.col("_hi") >= limit
    left = F.size(F.filter("_seqs", lambda s: s < limit))
    names = [physical[n] for n in roles.delta]
    arrays = ["_seqs", *[f"p_{physical[n]}" for n in roles.plain], *[f"{x}_{n}" for n in names for x in "dtr"]]
    cut = sections.where(F.coalesce(F.col("_lo") < limit, F.lit(True))).withColumn("__n", F.when(some, left).otherwise(F.col("_rows")).cast("int"))
    cut = cut.withColumns({a: F.when(F.col("__n") < F.col("_rows"), F.slice(a, F.lit(1), F.col("__n"))).otherwise(F.col(a)) for a in arrays})
    return recounted(cut.drop("__n"), names).withColumns(_bounds(roles, physical))


def recounted(sections: DataFrame, names: list[str]) -> DataFrame:
    """The counts of sections from their arrays alone."""
    add = lambda array, start="bigint": F.aggregate(array, F.lit(0).cast(start), lambda a, x: a + F.coalesce(x, F.lit(0)))
    index = F.sequence(F.lit(0), F.size("_seqs") - 1)
    tag = lambda n, i: F.get(f"t_{n}", i)
    zero = lambda i: reduce(lambda a, b: a | b, [F.coalesce(tag(n, i) == 0, F.lit(False)) for n in names])
    start = F.col("_base") + F.col("_sec") * F.col("_k")
    known = lambda i: reduce(lambda a, b: a + b, [tag(n, i).isNotNull().cast("int") for n in names])
    total = lambda i: reduce(lambda a, b: a + b, [F.coalesce(tag(n, i), F.lit(0)) for n in names])
    mean = lambda i: F.when(known(i) > 0, total(i).cast("double") / known(i)).otherwise(0.0)
    return sections.withColumns({
        "_lo": F.array_min("_seqs"),
        "_hi": F.array_max("_seqs"),
        "_rows": F.size("_seqs").cast("long"),
        "_keys": F.size(F.filter(index, lambda i: zero(i) | (F.get("_seqs", i) == start))).cast("long"),
        "_raw": reduce(lambda a, b: a + b, [add(F.col(f"r_{n}")) for n in names]),
        "_stored": reduce(lambda a, b: a + b, [add(F.transform(f"d_{n}", lambda x: F.octet_length(x).cast("long") + 4)) for n in names]),
        "_tags": F.aggregate(F.transform(index, mean), F.lit(0.0), lambda a, x: a + x),
    })
