"""Byte-pair encoding and decoding with a pair occurrence index (operator 8).

For a batch of pieces the index maps every mergeable pair to all its positions.  Active ranks are taken in ascending
order; one rank's merges are applied to all positions at once, and the lists of the neighbouring pairs that arise are
extended.  A pair that holds a merged symbol has a later rank than that symbol, so one ascending sweep equals the
library's choice of the lowest rank in each piece, leftmost first.

Defined results: a null, empty or wordless text has no ids and decodes to the empty text; a very long text is encoded
whole, alone in its chunk; equal pairs merge leftmost first; repeated rows are encoded each; an empty table gives no
rows; other columns of the input, whatever their names, are ignored.  Work is a row-wise map without a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import words as W
from .storage import KEPT, map_batches

_SPACES = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")

#: Entries kept of the per-worker caches; a full cache is emptied, which costs time but changes nothing.
WORD_CACHE, PIECE_CACHE = 300_000, 60_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII letters, and other ASCII but white space and the apostrophe: where the two meet, a piece ends.
_KIND = np.zeros(256, np.int8)
_KIND[33:127] = 2
_KIND[39] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file whose pieces end in a word-end mark."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, mark = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in (ids | self.added).items()}
        self.pieces = [names.get(i, "") for i in range(max(names) + 1)]
        alphabet = byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int32)
        self.final = np.array([ids[c + mark] for c in alphabet], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = self.left << 20 | self.right
        self._rank = np.argsort(keys, kind="stable")
        self._keys = keys[self._rank]
        encoded = [s.encode() + b" " for s in self.pieces]
        self.piece_bytes = np.frombuffer(b"".join(encoded), np.uint8)
        self.piece_size = np.array([len(s) for s in encoded], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it never merges."""
        keys = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._rank[at], -1)

    def merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that start at ``starts`` in ``data``, and the number of ids of each."""
        n = len(data)
        sym = self.inner[data]
        last = np.append(starts[1:], n) - 1
        sym[last] = self.final[data[last]]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[last], prv[starts] = -1, -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            keep = np.flatnonzero(rank >= 0)
            if not len(keep):
                return
            rank, at = rank[keep], at[keep]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, positions in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(positions)

        enter(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[alive[at] & (sym[at] == self.left[r])]
            to = nxt[at]
            good = (to >= 0) & (sym[to] == self.right[r])
            at, to = at[good], to[good]
            if self.left[r] == self.right[r] and len(at) > 1:  # a run of equal symbols merges two by two from its left
                order = np.argsort(at)
                at, to = at[order], to[order]
                heads = np.append(True, at[1:] != to[:-1])
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))
                at, to = at[nth % 2 == 0], to[nth % 2 == 0]
            if not len(at):
                continue
            after = nxt[to]
            sym[at], alive[to], nxt[at] = self.made[r], False, after
            linked = after >= 0
            prv[after[linked]] = at[linked]
            before = prv[at]
            around = np.unique(np.concatenate([before[before >= 0], at]))
            enter(around[nxt[around] >= 0])
        kept = np.cumsum(alive)
        ends = kept[last]
        return sym[alive], np.diff(ends, prepend=0)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece (normalised, without white space, not empty)."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(b) for b in raw], np.int64)
        ids, counts = self.merge(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes)
        body, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids: their pieces, one space between two."""
        parts = []
        for i in range(0, len(ids), 1 << 17):
            some = ids[i : i + (1 << 17)]
            parts.append(self.piece_bytes[W.gather_spans(self.piece_start[some], self.piece_size[some])].tobytes())
        return b"".join(parts)[:-1]


class WordEncoder:
    """Ids of whole texts from the ids of their distinct words.

    Normalising (NFC, lower case character by character) and splitting never reach over ASCII white space, so a text's
    ids are those of its words in turn.  ``encode_pieces`` gives the ids of pieces that no cache holds."""

    most_words: int | None = None  # of the cache, if not WORD_CACHE

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], added: dict[str, int]) -> None:
        self.encode_pieces = encode_pieces
        self.added = {s: np.array([i], "<u4").tobytes() for s, i in added.items()}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _split(self, word: str) -> list[str | bytes]:
        """Pieces of one word; an added token is given as its ids."""
        if self._special is None or "<" not in word:
            parts = [word]
        else:
            parts = self._special.split(word)
        found: list[str | bytes] = []
        for part in parts:
            if part in self.added:
                found.append(self.added[part])
            elif part:
                text = self._normal(part)
                found += [text] if text.isascii() and text.isalpha() else _PIECE.findall(text)
        return found

    def of_words(self, keys: list[bytes]) -> list[bytes]:
        """Ids of each distinct word, as little-endian 32-bit numbers."""
        out = list(map(self.words.get, keys))
        missing = [k for k, ids in zip(keys, out, strict=True) if ids is None]
        if missing:
            fresh = dict(zip(missing, self.of_new(missing), strict=True))
            out = [fresh[k] if ids is None else ids for k, ids in zip(keys, out, strict=True)]
            most = self.most_words or WORD_CACHE
            if len(self.words) + len(fresh) > most:
                self.words.clear()
            self.words |= dict(list(fresh.items())[:most])
        return out

    def of_new(self, words: list[bytes]) -> list[bytes]:
        cut = [self._split(k.decode()) for k in words]
        new = list(dict.fromkeys(p for parts in cut for p in parts if isinstance(p, str) and p not in self.pieces))
        table = dict(zip(new, self.encode_pieces(new), strict=True)) if new else {}
        out = [b"".join(p if isinstance(p, bytes) else table[p] if p in table else self.pieces[p] for p in parts) for parts in cut]
        if len(self.pieces) + len(table) > PIECE_CACHE:
            self.pieces.clear()
        self.pieces |= dict(list(table.items())[:PIECE_CACHE])
        return out

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets of each row's ids) for runs of rows."""
        for begin, end, data, offsets in W.text_chunks(texts):
            raw, breaks = data.tobytes(), None
            if b"<|" not in raw:  # no added token: lower case and sure piece ends first, as that makes fewer distinct words
                data = _LOWER[data]
                raw, kind = data.tobytes(), _KIND[data]
                breaks = np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1
            starts, ends, upto = W.split(data, offsets, breaks)
            if not len(starts):
                yield begin, end, np.zeros(0, np.int64), np.zeros(end - begin + 1, np.int64)
                continue
            codes, first = W.distinct(data, starts, ends)
            encoded = self.of_words([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            size = np.array([len(b) for b in encoded], np.int64) // 4
            flat = np.frombuffer(b"".join(encoded), "<u4")
            each = size[codes]
            ids = flat[W.gather_spans((np.cumsum(size) - size)[codes], each)].astype(np.int64)
            before = np.append(0, np.cumsum(each))
            yield begin, end, ids, before[upto]


_ENCODERS: dict[str, tuple[Vocabulary, WordEncoder]] = {}
KEPT["encoders"] = _ENCODERS


def encoder(path: str) -> tuple[Vocabulary, WordEncoder]:
    """This worker's vocabulary and encoder of a tokenizer file."""
    if path not in _ENCODERS:
        vocabulary = Vocabulary(path)
        _ENCODERS[path] = vocabulary, WordEncoder(vocabulary.encode_pieces, vocabulary.added)
    return _ENCODERS[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text as an array column ``into``; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != into]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{into}` array<int>"
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words = encoder(path)
        for batch in batches:
            for begin, end, ids, offsets in words.chunks(batch.column(names.index(text))):
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, lists], [*names, into])

    return map_batches(docs.select(*[f"`{n}`" for n in names]), run, schema, "encoders")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids, and digests of its ids and of their decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, words = encoder(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for _, _, ids, offsets in words.chunks(batch.column(1)):
                counts.append(np.diff(offsets))
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = ids[a:b]
                    ids_sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(vocabulary.decode(own)).hexdigest())
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "encoders")
