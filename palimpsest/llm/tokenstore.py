"""Token ids as Parquet list columns for selective reads (operator 7).

Documents are range-partitioned and sorted by ``doc_id``; each partition is encoded by the tokenizers library and becomes
one file whose ids are delta-encoded lists, with row groups of a set number of ids and page indexes.  Files are written under a name of the attempt and only count through the manifest that
the tasks return, so a task that runs twice does no harm.

Defined results: a null or empty text holds the end id alone; a very long text is one list, whole; a null ``doc_id``
sorts first; rows of one ``doc_id`` are ordered by a hash of their texts, then by the texts, and may fill several files; repeated rows are stored each; an empty table has a
manifest without rows; other columns, whatever their names, are not stored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .storage import KEPT, map_batches, materialize, new_folder, open_fs

END_ID = 1
#: Ids in a row group, and bytes in a page: what a selective read takes at least.
GROUP_IDS, PAGE_BYTES = 1 << 20, 64 << 10
#: Words in one call of the library.
BATCH_WORDS = 256

_ENCODERS: dict[str, bpe.WordEncoder] = {}
KEPT["library"] = _ENCODERS


class LibraryEncoder(bpe.WordEncoder):
    """The distinct pieces of a chunk are encoded by the tokenizers library: added tokens, normalising, splitting, model.

    A chunk is cut at white space, and at sure piece ends where it has no added token, only so that equal parts of its
    texts are encoded once: the library would cut there too, and its ids of a text are those of the parts in turn.  A
    piece of small ASCII letters, which normalising and splitting leave as it is, goes to the library's model at once;
    others are encoded some at a time, with an added token between two."""

    most_words = 450_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(lambda pieces: [], {})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.between = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special), None)

    def of_new(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        joined, alone = [], []
        for i, w in enumerate(words):
            if w.isalpha() and w.islower():  # of bytes, so ASCII
                out[i] = np.array([t.id for t in self.model.tokenize(w.decode())], "<u4").tobytes()
            elif self.between is None or b"<" in w:
                alone.append(i)
            else:
                joined.append(i)
        for at in (joined[i : i + BATCH_WORDS] for i in range(0, len(joined), BATCH_WORDS)):
            name, mark = self.between
            ids = np.array(self.encode([name.join(words[i].decode() for i in at)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == mark)
            body, starts, ends = ids.tobytes(), (np.append(0, cuts + 1) * 4).tolist(), (np.append(cuts, len(ids)) * 4).tolist()
            for i, a, b in zip(at, starts, ends, strict=True):
                out[i] = body[a:b]
        for i, e in zip(alone, self.encode([words[i].decode() for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def library_encoder(path: str) -> bpe.WordEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


class _FileWriter:
    SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def __init__(self, folder: str) -> None:
        self.fs, path = open_fs(folder)
        self.path, self.uri = f"{path}/{(name := f'part-{uuid.uuid4().hex}.parquet')}", f"{folder}/{name}"
        self.fs.create_dir(path, recursive=True)
        self.out = pq.ParquetWriter(self.path, self.SCHEMA, filesystem=self.fs, compression="zstd", compression_level=1, use_dictionary=False, column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED", "tokens.list.element": "DELTA_BINARY_PACKED"}, data_page_size=PAGE_BYTES, write_page_index=True, write_statistics=True)
        self.held: list[pa.RecordBatch] = []
        self.held_ids = self.rows = self.ids = 0
        self.first = self.last = None

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.held.append(pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], schema=self.SCHEMA))
        self.first = doc_ids[0].as_py() if not self.rows else self.first
        self.last, self.rows = doc_ids[-1].as_py(), self.rows + len(doc_ids)
        self.held_ids, self.ids = self.held_ids + len(ids), self.ids + len(ids)
        if self.held_ids >= GROUP_IDS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write_table(pa.Table.from_batches(self.held), row_group_size=1 << 30)
        self.held, self.held_ids = [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()


MANIFEST = "part int, path string, first_id long, last_id long, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode and store ``docs``; the manifest: a row per file with its id range, counts and ``start``, its first id's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = library_encoder(tokenizer), None
        for batch in batches:
            for begin, end, ids, offsets in words.chunks(batch.column(1)):
                out = out or _FileWriter(folder)
                ends = offsets[1:]
                out.add(batch.column(0).slice(begin, end - begin), np.insert(ids, ends, end_id), offsets + np.arange(len(offsets)))
        if out:
            out.close()
            row = {"part": TaskContext.get().partitionId(), "path": out.uri, "first_id": out.first, "last_id": out.last, "n_docs": out.rows, "n_ids": out.ids}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("path", pa.string()), *((n, pa.int64()) for n in ("first_id", "last_id", "n_docs", "n_ids"))]))

    by = [F.col("doc_id").asc_nulls_first(), F.col("h")]  # the hash splits a hot id's rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text").select("doc_id", "text")
    manifest = materialize(map_batches(dealt, run, MANIFEST, "library"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents with ``low <= doc_id <= high`` from the files: doc_id, start, n_tokens, tokens.

    Files outside the range are pruned by the manifest, row groups by their statistics."""
    return _read(manifest, low, high, "tokens array<int>", lambda ids, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids))


def checksums(manifest: DataFrame) -> DataFrame:
    """Per stored document, read back from the files: doc_id, start, n_tokens, ids_crc32."""

    def crc(ids: pa.Array, offsets: np.ndarray) -> pa.Array:
        body, ends = memoryview(ids.to_numpy().astype("<u4")).cast("B"), (offsets * 4).tolist()
        return pa.array([zlib.crc32(body[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())

    return _read(manifest, None, None, "ids_crc32 long", crc)


def _read(manifest: DataFrame, low: int | None, high: int | None, column: str, made) -> DataFrame:
    name = column.split()[0]
    if low is not None:
        manifest = manifest.where(F.col("last_id") >= low)
    if high is not None:
        manifest = manifest.where(F.col("first_id") <= high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inner = open_fs(path)
                with fs.open_input_file(inner) as f:
                    file = pq.ParquetFile(f)
                    for g in range(file.num_row_groups):
                        group = file.metadata.row_group(g)
                        s = group.column(0).statistics
                        skip = s is not None and s.has_min_max and s.null_count == 0 and (low is not None and s.max < low or high is not None and s.min > high)
                        if skip:  # only the counts are read, to carry the place on
                            start += int(np.sum(file.read_row_group(g, columns=["n_tokens"]).column(0).to_numpy()))
                            continue
                        table = file.read_row_group(g).combine_chunks()
                        counts = table.column("n_tokens").to_numpy()
                        lists = table.column("tokens").chunk(0)
                        offsets = np.append(0, np.cumsum(counts))
                        out = pa.RecordBatch.from_arrays([table.column("doc_id").chunk(0), pa.array(start + offsets[:-1]), pa.array(counts), made(lists.flatten(), offsets)], ["doc_id", "start", "n_tokens", name])
                        start += int(offsets[-1])
                        if low is not None or high is not None:
                            ids = table.column("doc_id").to_pandas()
                            out = out.filter(pa.array(((ids >= (low if low is not None else ids.min())) & (ids <= (high if high is not None else ids.max()))).to_numpy()))
                        yield out

    files = manifest.select("path", "start")
    files = files.repartition(max(1, files.count()))  # a task per file: a set number is not coalesced
    return map_batches(files, run, f"doc_id long, start long, n_tokens long, {column}")


def store_and_check(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return checksums(write_tokens(docs, tokenizer, new_folder(spark, "tokens")))
