"""Exact top-k inner products by a three-phase uniform threshold (operator 4).

The components are dealt to two slices; a slice's inner products of a query with the rows of a block are its score
list there.  Phase one gathers the best entries of every local list, resolves these alone, and keeps of each block the
sum of its lists' last gathered scores: no entry that it left out scores more.  The k-th best of all resolved scores is
a cutoff that no result is below.  Only a block whose left-out entries may reach a query's cutoff is asked again:
phase two sends that query's cutoff to it and collects the rows that reach the cutoff divided by the number of slices in
some slice, as every result must; phase three adds up their scores exactly and keeps the k best of all.  Queries are
taken in blocks of bounded size, and a block is what is sent to the tasks.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id; rows of one id are rows of their own, each a candidate of the other, and each a query with its own ranks; vectors
of other lengths than the query's are no candidates; ties go to the smaller id; a query with fewer candidates gets all;
an empty table gives no rows; other columns, whatever their names, are ignored.  Scores are exact for components of any
size; beyond 64 bits a score is shown as the end of that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .storage import FEW, map_batches, materialize

SCALE, SLICES = 1024.0, 2
#: Queries of a block, log2 of the rows of one, queries of one matrix product, and the share of a list that is gathered.
BLOCK, ROW_BITS, QUERIES, GATHERED = 8192, 12, 512, 1 / 32
_MOST, _EXACT = 2**63 - 1, 2.0**53
_RESULT = ["query", "query_id", "vec_id", "row", "score", "block"]

Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # scores, ids, rows, indices of queries


def packed(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """id, row, wide, v: the scaled and floored components as little-endian 32-bit integers, or (wide) as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in vectors.by_dimension(batch.column(1)):
                whole = np.floor(scale * matrix)
                wide = ~(np.abs(whole) < 2**31).all(axis=1)
                for some, kind in ((~wide, "<i4"), (wide & np.isfinite(whole).all(axis=1), "<f8")):
                    body, width = whole[some].astype(kind).tobytes(), whole.shape[1] * int(kind[2])
                    cells = [body[i : i + width] for i in range(0, len(body), width)]
                    ids = batch.column(0).take(pa.array(rows[some]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([kind == "<f8"] * len(cells), pa.bool_()), pa.array(cells, pa.binary())], ["id", "wide", "v"])

    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e")).where("id is not null")
    rows = map_batches(rows, run, "id long, wide boolean, v binary").withColumn("row", F.monotonically_increasing_id())
    return materialize(rows.select("id", "row", "wide", "v"), "vectors")


def _matrices(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, rows, components) for each length of vectors."""
    ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cells = [np.frombuffer(v, "<f8" if w else "<i4") for w, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    sizes = np.array([len(c) for c in cells])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], rows[at], np.stack([cells[i] for i in at]).astype(np.float64)


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, k: int) -> Entries:
    """Of each query the k highest scores, ties to the smaller id; by query, then from the highest."""
    order = np.lexsort((rows, ids, -score, query))
    query = query[order]
    heads = np.append(True, query[1:] != query[:-1]) if len(query) else np.zeros(0, bool)
    nth = np.arange(len(query)) - np.maximum.accumulate(np.where(heads, np.arange(len(query)), 0))
    order = order[nth < k]
    return score[order], ids[order], rows[order], query[nth < k]


def _exactly(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size, within 64 bits."""
    whole = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in r], object).T
    return np.array([[max(-_MOST, min(_MOST, x)) for x in row] for row in whole], np.int64)


def _entries(queries: np.ndarray, own: np.ndarray, matrix: np.ndarray, k: int, cutoffs: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(queries, rows, scores, bounds) of one block.  Without cutoffs those in a slice's gathered list, else those that the
    uniform threshold lets by; bounds: no other entry of the query scores more."""
    large = np.abs(matrix).max(axis=1) * np.abs(queries).max(initial=0) * matrix.shape[1] >= _EXACT
    bound = np.full(len(queries), -np.inf)
    found = []
    if large.any():  # sums may pass what doubles hold: these rows are resolved at once
        at = np.flatnonzero(large)
        q, r = np.nonzero(~own[:, at])
        found.append((q, at[r], _exactly(queries, matrix[at])[q, r]))
    rest = np.flatnonzero(~large)
    if len(rest):
        slices = [s for s in np.array_split(np.arange(matrix.shape[1]), SLICES) if len(s)]
        lists = [queries[:, s] @ matrix[rest][:, s].T for s in slices]
        chosen = np.zeros(lists[0].shape, bool)
        if cutoffs is None:
            many = max(k + 1, int(len(rest) * GATHERED))
            if many < len(rest):
                bound = np.zeros(len(queries))
                for scores in lists:
                    top = np.argpartition(-scores, many - 1, axis=1)[:, :many]
                    np.put_along_axis(chosen, top, True, axis=1)
                    bound += np.take_along_axis(scores, top, axis=1).min(axis=1)
            else:
                chosen[:] = True
        else:
            for scores in lists:
                chosen |= scores * len(slices) >= cutoffs[:, None]
        q, r = np.nonzero(chosen & ~own[:, rest])
        found.append((q, rest[r], sum(scores[q, r] for scores in lists).astype(np.int64)))
    q, r, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return q, r, score, bound


def _scan(rows: DataFrame, block: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, cutoffs: dict[int, int] | None, asked: dict[int, set[int]] | None) -> DataFrame:
    """Phase one (no cutoffs), or phases two and three over the asked blocks and queries: the k best entries of each
    partition, and (vec_id null) the bound of each block and query that may hold more."""
    numbered, upto = [], 0
    for _, query_rows, queries in block:
        numbered.append((upto, query_rows, queries))
        upto += len(query_rows)
    query_ids = np.concatenate([x[0] for x in block]) if block else np.zeros(0, np.int64)
    all_rows = np.concatenate([x[1] for x in block]) if block else np.zeros(0, np.int64)
    limit = None if cutoffs is None else np.array([cutoffs.get(r, -_MOST) for r in all_rows.tolist()], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        kept: Entries = (none, none, none, none)
        bounds: list[tuple[np.ndarray, np.ndarray, int]] = []
        held: list[pa.RecordBatch] = []
        at = None

        def close() -> None:
            nonlocal kept
            for ids, own_rows, matrix in _matrices(pa.Table.from_batches(held).combine_chunks()):
                found = [kept]
                for first, query_rows, queries in numbered:
                    if queries.shape[1] != matrix.shape[1]:
                        continue
                    wanted = np.arange(len(query_rows))
                    if asked is not None:
                        wanted = wanted[np.isin(query_rows, list(asked.get(at, ())))]
                    for i in range(0, len(wanted), QUERIES):
                        some = wanted[i : i + QUERIES]
                        own = query_rows[some][:, None] == own_rows[None, :]
                        q, r, score, bound = _entries(queries[some], own, matrix, k, None if limit is None else limit[first + some])
                        found.append(_best(score, ids[r], own_rows[r], first + some[q], k))
                        if limit is None and (may := bound > -np.inf).any():
                            bounds.append((first + some[may], bound[may].astype(np.int64), at))
                kept = _best(*map(np.concatenate, zip(*found, strict=True)), k)
            held.clear()

        for batch in batches:
            blocks = batch.column(1).to_numpy() >> ROW_BITS
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and at != blocks[a]:
                    close()
                at = int(blocks[a])
                held.append(batch.slice(a, b - a))
        if held:
            close()
        score, ids, found_rows, query = kept
        columns = [all_rows[query], query_ids[query], ids, found_rows, score, np.full(len(ids), -1)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], _RESULT)
        # what this partition has found already is a lower bound of the cutoff: most blocks need not be told of
        full = np.flatnonzero(np.bincount(query, minlength=len(all_rows)) == k)
        least = np.full(len(all_rows), -_MOST, np.int64)
        ends = np.searchsorted(query, full, "right") - 1
        least[full] = score[ends]
        for of, bound, b in bounds:
            some = bound >= least[of]
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays([pa.array(all_rows[of[some]]), pa.array(query_ids[of[some]]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(bound[some]), pa.array(np.full(n, b), pa.int64())], _RESULT)

    return map_batches(rows.select("id", "row", "wide", "v"), run, "query long, query_id long, vec_id long, row long, score long, block long")


def _search(rows: DataFrame, held: list, k: int) -> DataFrame:
    place = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    first = materialize(_scan(rows, held, k, None, None), "gathered")
    found = first.where("vec_id is not null").drop("block")
    ranked = found.withColumn("nth", F.row_number().over(place))
    cut = ranked.where(F.col("nth") == k).select("query", F.col("score").alias("cut"))
    cutoffs = dict(zip(*[c.to_pylist() for c in cut.toArrow().columns], strict=True))  # a row per query of the block
    may = first.where("vec_id is null").join(cut, "query", "left").where("cut is null or score >= cut").select("block", "query")
    n = may.count()
    if n:
        asked, again = None, rows
        if n <= FEW:
            asked = {}
            for b, q in zip(*[c.to_pylist() for c in may.toArrow().columns], strict=True):
                asked.setdefault(b, set()).add(q)
            of = F.broadcast(may.select("block").distinct())
            again = rows.join(of, F.shiftright("row", ROW_BITS) == F.col("block"), "left_semi")
        second = _scan(again, held, k, cutoffs, asked).where("vec_id is not null").drop("block")
        found = found.unionByName(second).dropDuplicates(["query", "row"])
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """rows, queries: as ``packed`` gives them.  Result: query_id, rank, vec_id, score."""
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("id", "row", "wide", "v").toArrow()
        if b and not own.num_rows:
            continue
        best = _search(rows, list(_matrices(own)), k)
        if blocks > 1:
            best = materialize(best, "top-k")
        out = best if out is None else out.unionByName(best)
    return out


def top_products(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k best of every row whose id is divisible by ``every``."""
    rows = packed(embeddings)
    return search(rows, rows.where(F.pmod("id", F.lit(every)) == 0), k)
