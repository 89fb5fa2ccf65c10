"""Removal of long word passages that a document with a smaller id holds too (operator 3).

The edges of the graph are the windows of ``k`` consecutive words.  Each window names an anchor, the smallest hash
among its short word groups; consecutive windows of one anchor are a path without branches, and equal passages are cut
into equal paths wherever they stand.  So a path is one row, not one row per window:

1. Paths are compared by (anchor, content): the first place of each content, by document and position, is found after
   each task has pre-aggregated its own.  A path whose content a smaller document holds is repeated as a whole.
2. Where an anchor has several contents the graph branches.  Only there, and only for the first document of each
   content, the windows themselves are compared, so partly equal paths lose exactly the windows that are repeated.
3. The words at each repeated content's first place are read from that document and digested.  What was found goes
   back to the documents by id; each finds its own places of the repeated paths and compares their words' digest with
   the source's, and finds its repeated windows anew.  The words they cover go.

A window is judged on the input, not on what is left.  Joins tell paths and windows apart by 128 bits.  Only sums,
minima and joins deal rows by a path, an anchor or a window, never a sorted window: what is hot is pre-aggregated, and
Spark can split its side of a join, so a passage or a phrase in a third of all documents is no one task's rows.

Defined results: a null, empty or short text loses nothing; a very long text is handled whole, alone in its chunk; rows
of one ``doc_id`` never repeat one another; documents with a null ``doc_id`` come after all others, ordered by a hash of
their texts; repeated windows inside one document stay; repeated rows are judged each; other columns, whatever their
names, are carried along or ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .storage import few, map_batches, materialize

WINDOW, ANCHOR = 50, 10
LAST_ID = 2**63 - 1
#: Paths that a task holds before it pre-aggregates and sends them on.
HELD_PATHS = 1 << 20


@dataclass
class Paths:
    """The words of some texts, and their windows' paths: text, first window and windows of each, and its names."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    upto: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def find_paths(data: np.ndarray, offsets: np.ndarray, k: int = WINDOW, a: int = ANCHOR) -> Paths:
    starts, ends, upto = W.split(data, offsets)
    hashes = W.hash_spans(data, starts, ends)
    n, none = len(hashes), np.zeros(0, np.int64)
    if n < k:
        return Paths(data, starts, ends, upto, hashes, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    least = W.rolling(hashes, a, 3)
    names, at, cover = least, np.arange(len(least)), 1
    while cover < k - a + 1:  # leftmost smallest of k-a+1 neighbours, by doubling
        step = min(cover, k - a + 1 - cover)
        right = least[step:] < least[:-step]
        at, least = np.where(right, at[step:], at[:-step]), np.where(right, least[step:], least[:-step])
        cover += step
    text_of_word = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    inside = np.flatnonzero(text_of_word[: n - k + 1] == text_of_word[k - 1 :])
    at, text = at[inside], text_of_word[inside]
    new = np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]))[: len(inside)]
    heads = np.flatnonzero(new)
    first, count = inside[heads], np.diff(np.append(heads, len(inside)))
    base = 0xC2B2AE3D27D4EB4F
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * W.powers(base, n), out=total[1:])
    content = W.mix((total[first + count - 1 + k] - total[first]) * W.powers(pow(base, -1, 2**64), n)[first] ^ count.astype(np.uint64))
    return Paths(data, starts, ends, upto, hashes, text[heads], first, count, names[at[heads]], content)


def window_names(p: Paths, k: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window that starts at each word (it may reach into the next text)."""
    return W.rolling(p.hashes, k, 5), W.rolling(p.hashes, k, 9)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _place(doc_id: str, text: str = "text") -> tuple[Column, Column]:
    """The order of documents: by id, then (null ids, which come last) by a hash of the text, from 1 on."""
    unnamed = F.xxhash64(text).bitwiseAND(LAST_ID - 1) + 1
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)), F.when(F.col(doc_id).isNull(), unnamed).otherwise(F.lit(0)).cast("long")


def _path_rows(docs: DataFrame, counted: bool) -> DataFrame:
    """anchor, content, d, t of all paths; counted: the first place of each in a task (with p, the first window, and c,
    the windows) and the number of its rows."""

    def pack(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        anchor, content, d, t, first, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((first, t, d, content, anchor))
        anchor, content, d, t = anchor[order], content[order], d[order], t[order]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))
        if not counted:
            new[1:] |= (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        heads = np.flatnonzero(new)
        columns, names = [_long(anchor[heads]), _long(content[heads]), pa.array(d[heads]), pa.array(t[heads])], ["anchor", "content", "d", "t"]
        if counted:
            columns += [pa.array(first[order][heads]), pa.array(count[order][heads]), pa.array(np.diff(np.append(heads, len(d))))]
            names += ["p", "c", "n"]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for begin, _, data, offsets in W.text_chunks(batch.column(2)):
                p = find_paths(data, offsets)
                if len(p.first):
                    of = begin + p.text
                    held.append([p.anchor, p.content, d[of], t[of], p.first - p.upto[p.text], p.count])
                    size += len(p.first)
                if size >= HELD_PATHS:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return map_batches(docs.select("d", "t", "text"), run, "anchor long, content long, d long, t long" + (", p long, c long, n long" if counted else ""))


def _asked(docs: DataFrame, by_document: DataFrame) -> DataFrame:
    """d, t, text and by_document's columns.  While the asked documents are few, only their texts are shuffled."""
    ids = few(by_document.select("d", "t"))
    if ids is not None:
        docs = docs.join(ids, ["d", "t"], "left_semi")
    return docs.join(by_document, ["d", "t"])


def _branching_windows(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """d, t, w: windows at branches that a smaller document holds too."""
    wanted = materialize(repeated.where("branches").groupBy("d", "t").agg(F.collect_set("content").alias("contents")), "branches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            cuts = np.asarray(lists.offsets)
            values = lists.values.to_numpy().view(np.uint64)
            for begin, end, data, offsets in W.text_chunks(batch.column(2)):
                p = find_paths(data, offsets)
                if not len(p.first):
                    continue
                asked = np.unique(values[cuts[begin] : cuts[end]])
                take = np.isin(p.content, asked)
                at = W.gather_spans(p.first[take], p.count[take])
                one, two = window_names(p)
                of = np.repeat(begin + p.text[take], p.count[take])
                yield pa.RecordBatch.from_arrays([_long(one[at]), _long(two[at]), pa.array(d[of]), pa.array(t[of])], ["w", "w2", "d", "t"])

    rows = map_batches(_asked(docs, wanted).select("d", "t", "text", "contents"), run, "w long, w2 long, d long, t long")
    rows = materialize(rows, "windows")
    place = F.struct("d", "t")
    least = rows.groupBy("w", "w2").agg(F.min(place).alias("m"), F.max(place).alias("top")).where("m < top").select("w", "w2", "m")
    return rows.join(least, ["w", "w2"]).where(F.struct("d", "t") > F.col("m")).select("d", "t", "w")


def _source_digests(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """sources: anchor, content, d, t, p, c.  anchor, content, digest of the words that stand at that place."""
    wanted = sources.groupBy("d", "t").agg(F.collect_list(F.struct("anchor", "content", "p", "c")).alias("places"))
    wanted = materialize(wanted, "sources")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, fields = np.asarray(batch.column(1).offsets), batch.column(1).values.flatten()
            anchor, content, first, count = (x.to_numpy() for x in fields)
            for begin, end, data, offsets in W.text_chunks(batch.column(0)):
                p = find_paths(data, offsets)
                if not len(p.first):
                    continue
                own = np.arange(cuts[begin], cuts[end])
                at = first[own] + p.upto[np.repeat(np.arange(end - begin), np.diff(cuts[begin : end + 1]))]
                place = np.minimum(np.searchsorted(p.first, at), len(p.first) - 1)
                # of several rows of one id, only the one that has the path there
                here = (p.first[place] == at) & (p.count[place] == count[own]) & (p.content[place].view(np.int64) == content[own]) & (p.anchor[place].view(np.int64) == anchor[own])
                own, at = own[here], at[here]
                found = _digests(data, p.starts, p.ends, at, count[own])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(content[own]), pa.array(found, pa.binary())], ["anchor", "content", "digest"])

    rows = map_batches(_asked(docs, wanted).select("text", "places"), run, "anchor long, content long, digest binary")
    return rows.groupBy("anchor", "content").agg(F.min("digest").alias("digest"))


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, count: np.ndarray, k: int = WINDOW) -> list[bytes]:
    """A 64-bit digest of the words of each path, one space between two."""
    size = ends - starts + 1
    body = np.append(data, np.uint8(32))[W.gather_spans(starts, size)]
    after = np.append(0, np.cumsum(size))
    body[after[1:] - 1] = 32
    view = memoryview(np.ascontiguousarray(body)).cast("B")
    last = np.minimum(first + count + k - 1, len(starts))
    return [hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(after[first].tolist(), after[last].tolist(), strict=True)]


def repeats(docs: DataFrame) -> DataFrame:
    """docs: d, t, text.  d, t, paths (contents and the digests of their words), windows of each document with findings."""
    counted = _path_rows(docs, True)
    first = F.min(F.struct("d", "t", "p", "c")).alias("s")
    contents = materialize(counted.groupBy("anchor", "content").agg(first, F.sum("n").alias("n")).select("anchor", "content", "s.*", "n"), "contents")
    branching = contents.groupBy("anchor").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low < high").select(F.col("anchor").alias("a"))
    marked = contents.join(branching, F.col("anchor") == F.col("a"), "left").withColumn("branches", F.col("a").isNotNull())
    repeated = materialize(marked.where("branches or n > 1").drop("a"), "paths")
    shared = repeated.where("n > 1")
    key = [F.col("p.anchor") == F.col("r.anchor"), F.col("p.content") == F.col("r.content")]
    later = F.struct("p.d", "p.t") > F.struct(F.col("r.d").alias("d"), F.col("r.t").alias("t"))
    whole = _path_rows(docs, False).alias("p").join(shared.select("anchor", "content", "d", "t").alias("r"), key).where(later)
    whole = materialize(whole.select("p.anchor", "p.content", "p.d", "p.t"), "repeated-paths")
    sources = shared.join(whole.select("anchor", "content").distinct(), ["anchor", "content"], "left_semi")
    known = whole.join(_source_digests(docs, sources.select("anchor", "content", "d", "t", "p", "c")), ["anchor", "content"])
    path, window = F.struct("content", "digest"), F.col("w")
    found = known.select("d", "t", path.alias("path"), F.lit(None).cast("long").alias("w"))
    found = found.unionByName(_branching_windows(docs, repeated).select("d", "t", F.lit(None).cast(found.schema["path"].dataType).alias("path"), "w"))
    return materialize(found.groupBy("d", "t").agg(F.collect_set("path").alias("paths"), F.collect_set(window).alias("windows")), "repeats")


def _removed(p: Paths, contents: np.ndarray, digests: list[bytes], windows: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Which words a repeated window covers."""
    n = len(p.hashes)
    change = np.zeros(n + 1, np.int64)
    if len(p.first):
        take = np.flatnonzero(np.isin(p.content, contents))
        if len(take):
            source = set(zip(contents.tolist(), digests, strict=True))
            own = _digests(p.data, p.starts, p.ends, p.first[take], p.count[take], k)
            take = take[[x in source for x in zip(p.content[take].tolist(), own, strict=True)]]
        np.add.at(change, p.first[take], 1)
        np.add.at(change, p.first[take] + p.count[take] - 1 + k, -1)
        if len(windows):
            mine = W.gather_spans(p.first, p.count)
            hit = mine[np.isin(window_names(p, k)[0][mine], windows)]
            np.add.at(change, hit, 1)
            np.add.at(change, hit + k, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(p: Paths, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, each followed by a space, and each text's place in them."""
    stay = np.flatnonzero(~gone)
    size = p.ends[stay] - p.starts[stay] + 1
    body = np.append(p.data, np.uint8(32))[W.gather_spans(p.starts[stay], size)]
    after = np.cumsum(size)
    body[after - 1] = 32
    return body, np.append(0, after)[np.searchsorted(stay, p.upto)]


def _judged(docs: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with findings (the columns ``names``, then paths and windows) and those without."""
    d, t = _place("doc_id")
    keyed = docs.withColumns({"__d": d, "__t": t})
    found = repeats(keyed.select(F.col("__d").alias("d"), F.col("__t").alias("t"), "text"))
    found = found.select(F.col("d").alias("__of_d"), F.col("t").alias("__of_t"), F.col("paths").alias("__paths"), F.col("windows").alias("__windows"))
    same = (F.col("__d") == F.col("__of_d")) & (F.col("__t") == F.col("__of_t"))
    kept = [F.col(f"`{n}`") for n in names]
    keys = found.select("__of_d", "__of_t")
    ids = few(keys)
    asked = keyed if ids is None else keyed.join(ids, same, "left_semi")
    return asked.join(found, same).select(*kept, "__paths", "__windows"), keyed.join(ids or keys, same, "left_anti").select(*kept)


def _judge(batch: pa.RecordBatch, text: int, found: bool) -> Iterator[tuple[int, int, Paths, np.ndarray]]:
    """(first row, end row, paths, removed words); found: the last two columns are paths and windows.

    Text by text: what was found for one document says nothing about another."""
    if found:
        paths, windows = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        c_at, w_at = np.asarray(paths.offsets), np.asarray(windows.offsets)
        contents, digests = paths.values.flatten()
        c_all, w_all = contents.to_numpy().view(np.uint64), windows.values.to_numpy().view(np.uint64)
    for begin, end, data, offsets in W.text_chunks(batch.column(text)):
        if not found:
            starts, ends, upto = W.split(data, offsets)
            none = np.zeros(0, np.int64)
            yield begin, end, Paths(data, starts, ends, upto, none, none, none, none, none, none), np.zeros(len(starts), bool)
            continue
        p = find_paths(data, offsets)
        gone = np.zeros(len(p.hashes), bool)
        some = np.flatnonzero(np.diff(c_at[begin : end + 1]) + np.diff(w_at[begin : end + 1]))
        for i in some.tolist():
            a, b = p.upto[i], p.upto[i + 1]
            lo, hi = np.searchsorted(p.text, [i, i + 1])
            x, y = (offsets[i], offsets[i + 1])
            own = Paths(data[x:y], p.starts[a:b] - x, p.ends[a:b] - x, np.array([0, b - a]), p.hashes[a:b], p.text[lo:hi], p.first[lo:hi] - a, p.count[lo:hi], p.anchor[lo:hi], p.content[lo:hi])
            c = slice(c_at[begin + i], c_at[begin + i + 1])
            gone[a:b] = _removed(own, c_all[c], digests[c.start : c.stop].to_pylist(), w_all[w_at[begin + i] : w_at[begin + i + 1]])
        yield begin, end, p, gone


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch], found: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, p, gone in _judge(batch, 1, found):
                lost = np.diff(np.append(0, np.cumsum(gone))[p.upto])
                body, at = _kept(p, gone)
                view, places = memoryview(np.ascontiguousarray(body)).cast("B"), at.tolist()
                names = [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(places[:-1], places[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(np.diff(p.upto)), pa.array(lost), pa.array(names, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    some, rest = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"])
    return map_batches(some, lambda b: run(b, True), schema).unionByName(map_batches(rest, lambda b: run(b, False), schema))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words gone from ``text``; texts that lose nothing stay as they are, and those of
    documents without findings never leave the JVM.

    A column ``n_chars``, where there is one, is the length of the text again for those that lose something."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, p, gone in _judge(batch, at, True):
                columns = [c.slice(begin, end - begin) for c in batch.columns[: len(names)]]
                lost = np.flatnonzero(np.diff(np.append(0, np.cumsum(gone))[p.upto]))
                if len(lost):
                    body, places = _kept(p, gone)
                    texts = columns[at].to_pylist()
                    for i in lost.tolist():
                        texts[i] = body[places[i] : max(places[i], places[i + 1] - 1)].tobytes().decode()
                    columns[at] = pa.array(texts, columns[at].type)
                    if "n_chars" in names:
                        c = names.index("n_chars")
                        sizes = columns[c].to_pylist()
                        for i in lost.tolist():
                            sizes[i] = len(texts[i])
                        columns[c] = pa.array(sizes, columns[c].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    some, rest = _judged(docs, names)
    return map_batches(some, run, docs.schema).union(rest)
