"""Near-duplicate vectors by spherical k-means cells and blocked cosine products (operator 10).

Equal vectors of a label are one, with a weight.  A label's vectors are dealt into blocks of bounded size, and a task
compares two blocks.  There spherical k-means splits one of them into cells, again and again, until a cell is small or
so tight that all its vectors link.  A vector's angle to a cell's center says, by the triangle inequality, whether it
links with all of the cell (which is then counted without a product), may link with some, or can't: only the second kind
is compared, cell by cell, in one product each.  No link is lost, and a group of near copies costs one product with each
center, not one for each pair.  A task returns link counts and the smallest id of each local component, never pairs; the
smallest id of a whole component is the group's representative.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
link with nothing and are their own component; so are vectors of different lengths; a row without an id has no
component and is not kept; equal rows link with one another; ties don't matter, as a link either holds or not; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .components import components
from .storage import map_batches, materialize

COSINE = 0.93
#: Vectors of a cell that is not split further, parts and sampled vectors of one split, bytes of a block, rows at a time.
PER_CELL, PARTS, SAMPLE, BLOCK_BYTES, CHUNK = 8, 64, 4096, 16 << 20, 4096
#: Vectors about one of them that make a cell of their own, of more vectors than that.
CROWD = 64
#: Angles are taken to be so far off at most.
SLACK = 1e-6


def _cleaned(embeddings: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, digest, v: v (float64 bytes) and digest are null for rows that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[bytes | None] = [None] * batch.num_rows
            keys: list[bytes | None] = [None] * batch.num_rows
            for rows, matrix in vectors.by_dimension(batch.column(2)):
                matrix += 0.0  # one zero only
                largest = np.abs(matrix).max(axis=1)
                for i, r in zip(np.flatnonzero(largest > 0).tolist(), rows[largest > 0].tolist(), strict=True):
                    cells[r] = matrix[i].tobytes()
                    keys[r] = hashlib.md5(cells[r]).digest()
            known = batch.column(0).is_valid().to_pylist(), batch.column(1).is_valid().to_pylist()
            for r, (a, b) in enumerate(zip(*known, strict=True)):
                if not (a and b):
                    cells[r] = keys[r] = None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(cells, pa.binary())], ["vec_id", "label", "digest", "v"])

    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("e"))
    return materialize(map_batches(rows, run, "vec_id long, label string, digest binary, v binary"), "vectors")


def _units(cells: list[bytes]) -> np.ndarray:
    matrix = np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # neither squares nor sums overflow
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def spherical_kmeans(units: np.ndarray, k: int, rounds: int = 4, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = units[rng.choice(len(units), min(k, len(units)), replace=False)]
    for _ in range(rounds):
        cell = (units @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, units)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centers)
    return centers


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


@dataclass
class Cells:
    """Cells of unit vectors: each one's members, and all centers with the members' smallest and largest angle to them."""

    members: list[np.ndarray]
    centers: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray


def split(units: np.ndarray, reach: float) -> Cells:
    rng = np.random.default_rng(6)
    done, stack = [], [np.arange(len(units))]
    while stack:
        at = stack.pop()
        own = units[at]
        if len(at) > CROWD:  # a large group of near copies is one cell, not many
            picked = own[rng.choice(len(own), 8, replace=False)]
            near = _angle(own @ picked.T)
            crowd = (near <= reach / 3).sum(axis=0)
            best = crowd.argmax()
            if crowd[best] >= max(CROWD, len(at) / PARTS):
                inside = near[:, best] <= reach / 3
                done.append((at[inside], picked[best], near[inside, best].min(), near[inside, best].max()))
                stack += [at[~inside]] * bool((~inside).any())
                continue
        center = own.sum(axis=0)
        size = np.sqrt(center @ center)
        center = center / size if size > 1e-9 else own[0]
        angles = _angle(own @ center)
        parts = []
        if len(at) > PER_CELL and angles.max() > reach / 3:
            some = own if len(own) <= SAMPLE else own[rng.choice(len(own), SAMPLE, replace=False)]
            centers = spherical_kmeans(some, max(2, min(PARTS, -(-len(at) // PER_CELL))))
            cell = np.concatenate([(own[i : i + CHUNK] @ centers.T).argmax(axis=1) for i in range(0, len(own), CHUNK)])
            order = np.argsort(cell, kind="stable")
            parts = np.split(at[order], np.flatnonzero(np.diff(cell[order])) + 1)
        if len(parts) > 1:
            stack += parts
        else:
            done.append((at, center, angles.min(), angles.max()))
    members, centers, nearest, farthest = zip(*done, strict=True)
    return Cells(list(members), np.stack(centers), np.array(nearest), np.array(farthest))


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0 .. n-1 reaches by edges."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (further := root[root]) is not root and (further != root).any():
            root = further


@dataclass
class Compared:
    """Weighed links of the vectors that asked and of those that were asked, edges between the two and among the asked
    that connect whatever is linked, and the share of cells in which vectors were compared."""

    links: np.ndarray
    others: np.ndarray
    between: tuple[np.ndarray, np.ndarray]
    among: tuple[np.ndarray, np.ndarray]
    visited: float


def compare(asking: np.ndarray, asking_weight: np.ndarray, units: np.ndarray, weight: np.ndarray, cosine: float, same: bool) -> Compared:
    """same: both are the same vectors, and none links with itself."""
    reach = float(np.arccos(cosine))
    cells = split(units, reach)
    links, others, visited = np.zeros(len(asking), np.int64), np.zeros(len(units), np.int64), 0
    left, right, low, high = [], [], [], []
    home, total = np.empty(len(units), np.int64), np.zeros(len(cells.members), np.int64)
    for c, m in enumerate(cells.members):
        home[m], total[c] = c, weight[m].sum()
    for i in range(0, len(asking), CHUNK):
        rows, mine = asking[i : i + CHUNK], asking_weight[i : i + CHUNK]
        angles = _angle(rows @ cells.centers.T)
        every = angles + cells.farthest <= reach - SLACK
        some = (angles - cells.farthest <= reach + SLACK) & (cells.nearest - angles <= reach + SLACK) & ~every
        visited += int(some.sum())
        for c in np.flatnonzero(every.any(axis=0)).tolist():
            q, m = np.flatnonzero(every[:, c]), cells.members[c]
            links[i + q] += total[c]
            others[m] += mine[q].sum()
            if same:
                own = i + q[home[i + q] == c]
                links[own] -= weight[own]
            left.append(i + q), right.append(np.full(len(q), m[0]))
            low.append(np.full(len(m), m[0])), high.append(m)
        for c in np.flatnonzero(some.any(axis=0)).tolist():
            q, m = np.flatnonzero(some[:, c]), cells.members[c]
            hit = rows[q] @ units[m].T >= cosine
            if same:
                hit &= (i + q)[:, None] != m[None, :]
            q, hit = q[keep := hit.any(axis=1)], hit[keep]
            if not len(q):
                continue
            links[i + q] += hit @ weight[m]
            others[m] += mine[q] @ hit
            first = hit.argmax(axis=1)
            left.append(i + q), right.append(m[first])
            pairs = np.unique((first[:, None] * len(m) + np.arange(len(m))[None, :])[hit])
            low.append(m[pairs // len(m)]), high.append(m[pairs % len(m)])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Compared(links, others, (join(left), join(right)), (join(low), join(high)), visited / max(1, len(asking) * len(cells.members)))


def _tile(table: pa.Table, cosine: float) -> pa.Table:
    """One pair of blocks: id, the smallest id of its local component, links."""
    ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
    units, asked = _units(table.column("v").to_pylist()), table.column("asked").to_numpy()
    same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    t = np.arange(len(ids)) if same else np.flatnonzero(asked)
    q = t if same else np.flatnonzero(~asked)
    if not (len(q) and len(t)):
        return pa.table([pa.array([], pa.int64())] * 3, ["id", "root", "links"])
    found = compare(units[q], weight[q], units[t], weight[t], cosine, same)
    links = np.zeros(len(ids), np.int64)
    links[q] += found.links
    if not same:
        links[t] += found.others
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    left = place[np.concatenate([q[found.between[0]], t[found.among[0]]])]
    right = place[np.concatenate([t[found.between[1]], t[found.among[1]]])]
    root = ids[order][_roots(len(ids), left, right)][place]
    some = (links > 0) | (root != ids)
    return pa.table([pa.array(x[some]) for x in (ids, root, links)], ["id", "root", "links"])


def links(embeddings: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = _cleaned(embeddings, vec_id, vector, label)
    alike = rows.where("v is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v"))
    alike = materialize(alike, "distinct-vectors")
    key = ["label", "size"]
    sized = alike.withColumn("size", F.octet_length("v"))
    per_block = F.greatest(F.lit(1), F.floor(F.lit(float(BLOCK_BYTES)) / F.col("size")))
    sizes = sized.groupBy(*key).agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / per_block).cast("long")).drop("n")
    dealt = sized.join(sizes, key).withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))  # one block, one copy
    tiles = dealt.select(*key, "id", "weight", "v", "b", every.alias("o")).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o"), "asked": F.col("b") > F.col("o")})
    found = tiles.select(*key, "id", "weight", "v", "i", "j", "asked").groupBy(*key, "i", "j").applyInArrow(lambda t: _tile(t, cosine), "id long, root long, links long")
    found = materialize(found, "found-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    known = alike.select("label", "digest", "id", "weight").join(counts, "id", "left").join(roots, "id", "left")
    known = known.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = rows.select("vec_id", "label", "digest").join(known, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
