"""Near-duplicate documents by improved consistent weighted sampling (operator 1).

A document is the multiset of its runs of five words; the n-th occurrence of a run is an element of its own, so the
weight of a run is its frequency times its IDF.  The IDF comes from document counts of hashed runs over the whole
corpus, in a table of fixed size, and is damped to [0.8, 1]: runs in under 1/128 of all documents weigh 1.  So large
groups of copies, whose runs are frequent for that very reason, are still found, and weighted and plain similarity
stay close.

Consistent weighted samples (Ioffe's scheme: per element and sample r, c ~ Gamma(2, 1), b ~ U(0, 1); the element with
the smallest c / exp(r (t - b + 1)), t = floor(ln w / r + b)) are banded.  Random numbers are drawn once into a table
that an element's hash indexes; equal numbers are told apart by the hash.  Inside a band's bucket, in an order of that
bucket's own, each document is paired with the bucket's smallest and with a few neighbours: linear in the bucket.
Pairs are verified by exact weighted Jaccard similarity, first those with the smallest, then only those whose ends are
not yet connected.  Equal texts are one node from the start.

That settles every bucket of up to NEIGHBOURS + 1 documents and every one whose members became one component.  The
members of all other buckets (large ones, or cut by a range partition) are open and are joined exactly, by a prefix
filter (PPJoin's, with weights): in one order of all elements, the rarest first, a similar pair's first common element
lies in a prefix of both, as what follows must still hold the overlap that the similarity needs.  So pairs are sought
by the elements of prefixes, first each with a posting list's smallest, then all that are not yet connected, in blocks
of a list.  No pair of open documents is left out, whatever bands they share.

Defined results: a null, empty or wordless text is its own group; a very long text is handled whole, alone in its chunk; a text under five words only matches equal word sequences;
rows that share a ``doc_id`` are one document; a null ``doc_id`` is in no group and is kept; an empty table gives no
rows; other columns, whatever their names, are carried along or ignored; the smallest ``doc_id`` of a group stays.  A pair of similarity s shares no band with probability
(1 - s**4)**16: 0.0002 at 0.8.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .storage import few, map_batches, materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: log2 of the hashed document counts; weights are TOP-SPAN .. TOP; a share of documents below RARE weighs TOP.
IDF_BITS, TOP, SPAN, RARE = 16, 40, 8, 1 / 128
#: Neighbours in a bucket's order that a document is paired with, besides the bucket's smallest.
NEIGHBOURS = 4
#: log2 of the hashed counts that order elements, and a posting list's rows in one block of the open documents' join.
ORDER_BITS, POSTINGS = 20, 1000
_ELEMENTS = 1 << 16
#: Sums of counts are added in two steps; the second adds at most so many.
FAN_IN = 1024


def elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements as 32-bit bucket and check, 64-bit hashes, each text's place in them, words, and two sequence hashes.

    An element's top 16 bits are its run's IDF bucket; elements of a text ascend."""
    starts, ends, upto = W.split(data, offsets)
    h = W.hash_spans(data, starts, ends)
    n, texts = len(h), len(offsets) - 1
    of = np.repeat(np.arange(texts), np.diff(upto))
    runs = W.rolling(h, SHINGLE, 7)
    inside = of[: len(runs)] == of[SHINGLE - 1 :][: len(runs)] if len(runs) else np.zeros(0, bool)
    runs, own = runs[inside], of[: len(inside)][inside]
    order = np.lexsort((runs, own))
    runs, own = runs[order], own[order]
    if len(runs):
        at = np.arange(len(runs))
        new = np.append(True, (runs[1:] != runs[:-1]) | (own[1:] != own[:-1]))
        nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        again = nth > 0
        low = np.uint64((1 << (64 - IDF_BITS)) - 1)
        runs = runs.copy()
        runs[again] = (runs[again] & ~low) | (W.mix(runs[again] + nth[again] * np.uint64(0x9E3779B97F4A7C15)) & low)
        order = np.lexsort((runs, own))
        runs, own = runs[order], own[order]
    sequence = []
    for base in (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9):
        total = np.append(np.uint64(0), np.cumsum(h * W.powers(base, n))) if n else np.zeros(1, np.uint64)
        back = np.append(W.powers(pow(base, -1, 2**64), n), np.uint64(0))
        sequence.append(W.mix((total[upto[1:]] - total[upto[:-1]]) * back[upto[:-1]] ^ np.diff(upto).astype(np.uint64)))
    return runs, np.searchsorted(own, np.arange(texts + 1)), np.diff(upto), *sequence


def idf_weights(docs: DataFrame) -> np.ndarray:
    """The integer weight of each IDF bucket, from counts over all documents."""
    size, block = 1 << IDF_BITS, 1 << 12
    names = ["block", "salt", "n", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in W.text_chunks(batch.column(0)):
                runs, at, words, *_ = elements(data, offsets)
                n += int((words > 0).sum())
                key = np.repeat(np.arange(len(at) - 1), np.diff(at)) << IDF_BITS | (runs >> np.uint64(64 - IDF_BITS)).astype(np.int64)
                if len(key):  # ascending, as elements of a text do
                    counts += np.bincount(key[np.append(True, key[1:] != key[:-1])] & (size - 1), minlength=size)
        cells = [zlib.compress(counts[i : i + block].astype("<i8").tobytes(), 1) for i in range(0, size, block)]
        salt = [TaskContext.get().partitionId() % FAN_IN] * (len(cells) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(cells)), pa.int64()), pa.array(salt, pa.int64()), pa.array([n] + [0] * len(cells), pa.int64()), pa.array([b"", *cells], pa.binary())], names)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(block, np.int64)
        for cell in table.column("counts").to_pylist():
            if cell:
                total += np.frombuffer(zlib.decompress(cell), "<i8")
        return pa.table([[table.column("block")[0].as_py()], [table.column("salt")[0].as_py()], [sum(table.column("n").to_pylist())], [zlib.compress(total.astype("<i8").tobytes(), 1)]], names)

    schema = "block long, salt long, n long, counts binary"
    part = map_batches(docs.select("text"), count, schema).groupBy("block", "salt").applyInArrow(add, schema)
    rows = sorted(part.groupBy("block").applyInArrow(add, schema).collect())
    if not rows:
        return np.full(size, TOP, np.uint8)
    counts = np.concatenate([np.frombuffer(zlib.decompress(bytes(r.counts)), "<i8") for r in rows if r.block >= 0])
    share = np.maximum(counts, 1) / max(1, rows[0].n)
    idf = np.clip(np.log(np.maximum(1 / share, 1)) / np.log(1 / RARE), 0, 1)
    return (TOP - SPAN + np.round(SPAN * idf)).astype(np.uint8)


@cache
def _sample_table() -> np.ndarray:
    """For each weight and table row the sample's rank, shifted to the top 20 bits."""
    rng = np.random.default_rng(11)
    r, c, b = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.uniform(0, 1, 1 << 16)
    rows = []
    for weight in range(TOP - SPAN, TOP + 1):
        t = np.floor(np.log(weight / TOP) / r + b)
        rows.append(np.log(c) - r * (t - b + 1))
    rank = np.unique(np.concatenate(rows), return_inverse=True)[1].reshape(-1)
    return rank.astype(np.uint64) << np.uint64(44)


@cache
def _factors() -> np.ndarray:
    return np.random.default_rng(12).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(runs: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Band hashes of the texts that have elements, by text."""
    table, factors = _sample_table(), _factors()
    bands = np.zeros((len(at) - 1, BANDS), np.uint64)
    full = np.flatnonzero(np.diff(at))
    level = (weights[(runs >> np.uint64(64 - IDF_BITS)).astype(np.int64)].astype(np.int64) - (TOP - SPAN)) << 16
    mixed, low = W.mix(runs), np.uint64((1 << 44) - 1)
    i = 0
    while i < len(full):  # some texts at a time, so that the arrays stay in the cache
        begin = at[full[i]]
        j = max(i + 1, int(np.searchsorted(at[full], begin + _ELEMENTS)))
        j = min(j, len(full))
        stop = at[full[j - 1] + 1]
        some, base, heads = mixed[begin:stop], level[begin:stop], at[full[i:j]] - begin
        for band in range(BANDS):
            total = np.full(j - i, band + 1, np.uint64)
            for factor in factors[band * ROWS : (band + 1) * ROWS]:
                m = some * factor
                key = table[(m >> np.uint64(48)).astype(np.int64) + base] | (m & low)
                total = W.mix(total * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(key, heads))
            bands[full[i:j], band] = total
        i = j
    return bands


def _signed(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """d, s1, s2 (hashes of the word sequence), bands (null under five words), of every text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in W.text_chunks(batch.column(1)):
                runs, at, words, one, two = elements(data, offsets)
                keep = words > 0
                bands, has = signatures(runs, at, weights)[keep], np.diff(at)[keep] > 0
                ids = batch.column(0).slice(begin, end - begin).filter(pa.array(keep))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * BANDS)), pa.int32()), pa.array(bands[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64)), lists], ["d", "s1", "s2", "bands"])

    return map_batches(docs.select("d", "text").where("d is not null and text is not null"), run, "d long, s1 long, s2 long, bands array<long>")


def candidate_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes: d, bands.  a < b and whether a is the smallest of a bucket, linear in the number of nodes; and the keys of
    the buckets in which not every pair is one of these.

    Buckets are sorted over range partitions, which may cut one; the pieces are then linked through their smallest."""
    rows = nodes.select("d", F.explode("bands").alias("key")).withColumn("o", F.xxhash64("key", "d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_key, tail_ids, least = np.zeros(0, np.int64), np.zeros(0, np.int64), {}
        first_key = last_key = last_least = None
        out: list[np.ndarray] = []
        for batch in batches:
            key = np.concatenate([tail_key, batch.column(0).to_numpy()])
            ids = np.concatenate([tail_ids, batch.column(1).to_numpy()])
            old = len(tail_key)
            if not len(key):
                continue
            for back in range(1, NEIGHBOURS + 1):
                later = np.arange(max(old, back), len(key))
                later = later[key[later] == key[later - back]]
                out.append(np.stack([ids[later], ids[later - back], np.zeros(len(later), np.int64)]))
            heads = np.flatnonzero(np.append(True, key[old + 1 :] != key[old:-1])) + old if len(key) > old else np.zeros(0, np.int64)
            if len(heads):
                low = np.minimum.reduceat(ids[old:], heads - old)
                if last_key is not None and key[heads[0]] == last_key:  # the bucket began in an earlier batch
                    out.append(np.array([[last_least], [low[0]], [1]]))
                    low[0] = min(low[0], last_least)
                else:
                    first_key = key[heads[0]] if first_key is None else first_key
                size = np.diff(np.append(heads, len(key)))
                out.append(np.stack([ids[old:], np.repeat(low, size), np.ones(len(key) - old, np.int64)]))
                for k, v in ((key[heads[0]], low[0]), (key[heads[-1]], low[-1])):
                    least[int(k)] = int(v)
                least = {k: v for k, v in least.items() if k in (int(first_key), int(key[-1]))}
                last_key, last_least = key[-1], low[-1]
            tail_key, tail_ids = key[-NEIGHBOURS:], ids[-NEIGHBOURS:]
            yield pack(out, None)
            out = []
        yield pack([], least)

    def pack(parts: list[np.ndarray], least: dict[int, int] | None) -> pa.RecordBatch:
        found = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        found = np.stack([np.minimum(found[0], found[1]), np.maximum(found[0], found[1]), found[2]])
        found = np.unique(found[:, found[0] < found[1]], axis=1)
        key = np.zeros(found.shape[1], np.int64)
        if least:
            found = np.concatenate([found, np.array([[v, v, 2] for v in least.values()]).T], axis=1)
            key = np.append(key, np.array(list(least)))
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2]), pa.array(key)], ["a", "b", "kind", "key"])

    dealt = rows.repartitionByRange("key", "o").sortWithinPartitions("key", "o").select("key", "d")
    found = materialize(map_batches(dealt, run, "a long, b long, kind long, key long"), "pairs")
    edge = found.where("kind = 2").groupBy("key").agg(F.min("a").alias("low"))
    pieces = found.where("kind = 2").select("key", "a").join(edge, "key").where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"), F.lit(1).cast("long").alias("kind"))
    pairs = found.where("kind < 2").select("a", "b", "kind").unionByName(pieces)
    cut = found.where("kind = 2").groupBy("key").count().where("count > 1")
    large = rows.groupBy("key").count().where(F.col("count") > NEIGHBOURS + 1)
    return pairs.groupBy("a", "b").agg((F.max("kind") == 1).alias("least")), large.unionByName(cut).select("key").distinct()


def open_nodes(nodes: DataFrame, buckets: DataFrame, known: DataFrame) -> DataFrame:
    """d: members of those of the buckets (key) whose members are not all of one component.  known: id, root."""
    rows = nodes.select("d", F.explode("bands").alias("key")).join(few(buckets) or buckets, "key")
    rows = rows.join(known.withColumnRenamed("id", "d"), "d", "left").select("d", "key", F.coalesce("root", "d").alias("root"))
    unlike = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return rows.join(unlike, "key", "left_semi").select("d").distinct()


def postings(vectors: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """vectors: d, v.  Per document and element of its prefix: e, d, w (the document's weight), rest (the weight from the
    element on), first (whether also in the shorter prefix, in which a document meets those that weigh as much or more).

    Elements that no other document can hold are left out: their hashed count is 1."""
    size = 1 << ORDER_BITS
    cell = lambda e: (W.mix(e) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                np.add.at(total, cell(np.frombuffer(v, "<u8")), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    found = map_batches(vectors.select("v"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.ones(size, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                e = np.frombuffer(v, "<u8")
                n = counts[cell(e)]
                order = np.lexsort((e, n))
                e, n = e[order], n[order]
                rest = np.cumsum(weights[(e >> np.uint64(64 - IDF_BITS)).astype(np.int64)][::-1].astype(np.int64))[::-1]
                total = int(rest[0]) if len(rest) else 0
                keep = (n > 1) & (rest >= SLACK * similarity * total)
                first = rest >= SLACK * 2 * similarity / (1 + similarity) * total
                many = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array(e[keep].view(np.int64)), pa.array([d] * many, pa.int64()), pa.array([total] * many, pa.int64()), pa.array(rest[keep]), pa.array(first[keep])], ["e", "d", "w", "rest", "first"])

    return map_batches(vectors.select("d", "v"), run, "e long, d long, w long, rest long, first boolean")


#: The prefix filter's bounds are lower by this, so that rounding drops no pair.
SLACK = 1 - 1e-9


def prefix_pairs(lists: DataFrame, known: DataFrame, similarity: float, stars: bool) -> DataFrame:
    """lists: as ``postings`` gives them.  a < b, not of one component, that may be similar: all, or (stars) of each list
    only those with its smallest."""
    lists = lists.join(known.withColumnRenamed("id", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    x = lambda cells: cells.select("e", *[F.col(c).alias(f"x_{c}") for c in ("d", "w", "rest", "first", "root")], *(["salt"] if "salt" in cells.columns else []))
    if stars:
        least = lists.groupBy("e").agg(F.min(F.struct("d", "w", "rest", "first", "root")).alias("s")).select("e", "s.*")
        both = lists.join(x(least), "e")
        meets = F.col("d") != F.col("x_d")
    else:
        sizes = lists.groupBy("e").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        sized = lists.join(sizes.select("e", F.ceil(F.col("n") / POSTINGS).cast("int").alias("blocks")), "e")
        probe = sized.withColumn("salt", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
        index = sized.where("first").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = probe.join(x(index), ["e", "salt"])
        meets = F.struct("x_w", "x_d") < F.struct(F.col("w").alias("x_w"), F.col("d").alias("x_d"))
    enough = F.least("rest", "x_rest") * (1 + similarity) >= SLACK * similarity * (F.col("w") + F.col("x_w"))
    both = both.where(meets & (F.col("root") != F.col("x_root")) & enough)
    return both.select(F.least("d", "x_d").alias("a"), F.greatest("d", "x_d").alias("b")).distinct()


def similar(vectors: DataFrame, pairs: DataFrame, weights: np.ndarray, similarity: float) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is high enough.  vectors: d, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                weigh = lambda e: int(weights[(e >> np.uint64(64 - IDF_BITS)).astype(np.int64)].sum(dtype=np.int64))
                both = weigh(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (weigh(x) + weigh(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    right = pairs.join(vectors.select(F.col("d").alias("b"), F.col("v").alias("y")), "b")
    both = right.join(vectors.select(F.col("d").alias("a"), F.col("v").alias("x")), "a")
    return map_batches(both.select("a", "b", "x", "y"), run, "a long, b long")


def _vectors(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """d, v: the distinct elements of the asked documents, 64 bits each, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in W.text_chunks(batch.column(1)):
                runs, at, *_ = elements(data, offsets)
                cells = [np.unique(runs[a:b]).astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(cells, pa.binary())], ["d", "v"])

    return map_batches(docs.select("d", "text").join(ids, "d", "left_semi"), run, "d long, v binary")


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """d, root for every document with an id and words: root is the smallest id of its group."""
    docs = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    weights = idf_weights(docs)
    signed = materialize(_signed(docs, weights), "signatures")
    alike = materialize(signed.groupBy("s1", "s2").agg(F.min("d").alias("node"), F.first("bands").alias("bands")), "nodes")
    nodes = alike.select(F.col("node").alias("d"), "bands")
    pairs, buckets = (materialize(df, "candidates") for df in candidate_pairs(nodes))
    ids = materialize(pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).distinct(), "ids")
    vectors = materialize(_vectors(docs, few(ids) or ids).groupBy("d").agg(F.min("v").alias("v")), "elements")
    links = materialize(similar(vectors, pairs.where("least").select("a", "b"), weights, similarity), "links")
    known = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    of = lambda name: known.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
    rest = pairs.where("not least").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")
    more = materialize(similar(vectors, rest, weights, similarity), "links")
    members = signed.join(alike.select("s1", "s2", "node"), ["s1", "s2"]).where("d != node").select("d", "node")
    edges = lambda known, more: known.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    joined = edges(known, more)
    if not buckets.isEmpty() and not (wide := materialize(open_nodes(nodes, buckets, known), "open")).isEmpty():
        known = components(joined)
        wide = materialize(open_nodes(nodes, buckets, known), "open")
        lists = materialize(postings(vectors.join(few(wide) or wide, "d", "left_semi"), weights, similarity), "postings")
        for stars in (True, False):
            found = materialize(prefix_pairs(lists, known, similarity, stars), "candidates")
            joined = edges(known, materialize(similar(vectors, found, weights, similarity), "links"))
            known = components(joined) if stars else known
    roots = components(joined.unionByName(members.select(F.col("d").alias("u"), F.col("node").alias("v"))))
    everyone = signed.select("d").distinct()
    return everyone.join(roots.select(F.col("id").alias("d"), "root"), "d", "left").select("d", F.coalesce("root", "d").alias("root"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, group_id, kept."""
    found = groups(docs, similarity).select("d", "root")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, F.col("doc_id") == F.col("d"), "left")
    group = F.coalesce("root", "doc_id")
    return rows.select("doc_id", group.alias("group_id"), F.coalesce(group == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, unchanged, of one document of each group."""
    gone = materialize(groups(docs, similarity).where("d != root").select(F.col("d").alias("__gone")), "gone")
    gone = few(gone) or gone
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
