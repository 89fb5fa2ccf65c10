"""Language identification by averaged hashed subword embeddings (operator 6).

A text's vector is the mean embedding of the hashed byte n-grams of its lower-case words; a linear softmax over it
gives the language.  Embeddings and classifier are trained together by stochastic gradient descent in numpy on the
driver, on a bounded sample of labelled documents; a part of the sample that training does not see sets the
temperature of the softmax and the score below which a text is rejected.  For prediction the product of embeddings and
classifier is one small table, so a text costs a few look-ups per distinct word and no shuffle.

Defined results: a null text, or one without a letter, gets ``und`` with score 0 and is rejected; documents without a
language are never learned from; without any labelled document every text gets ``und``; repeated rows are predicted
each; equal scores go to the language that sorts first; a very long text is predicted whole, alone in its chunk; an
empty table gives no rows; other columns, whatever their names, are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .storage import few, give_back, map_batches, materialize

UNKNOWN = "und"
#: The training sample: at most so many documents of a language, so many in all, and so many first characters of each.
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_CHARS = 1500, 6000, 20_000
#: Of each language so many times PER_LANGUAGE documents are expected below the hash bound, of which the least are taken.
SPARE = 2
BUCKETS, DIMENSIONS, ORDERS, EPOCHS, RATE = 1 << 15, 12, (2, 3, 4), 6, 8.0
#: A small sample is gone over more often than EPOCHS times, until so many steps are done.
LEAST_STEPS = 12_000
#: Share of known-language documents that calibration lets the rejection cost, and the score that is never rejected.
REJECTED_SHARE, SURE = 0.002, 0.5


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % 5


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the given lower-case words with their borders, and the number of n-grams of each."""
    size = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + size + 1]
    body = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets) + 2
    starts = np.cumsum(lengths) - lengths
    flat = np.full(int(lengths.sum()), 32, np.uint32)
    flat[W.gather_spans(starts + 1, lengths - 2)] = body
    own = np.repeat(np.arange(size), lengths)
    found, of = [], []
    for n in ORDERS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, n, np.uint32)
        for k in range(n):
            h = (h ^ flat[k : k + len(h)]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        inside = own[: len(h)] == own[n - 1 :]
        found.append((h[inside] % np.uint32(BUCKETS)).astype(np.int64))
        of.append(own[: len(h)][inside])
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return np.concatenate(found)[order], np.bincount(of_all, minlength=size)


def _distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray] | None:
    starts, ends, upto = W.split(data, offsets)
    if not len(starts):
        return None
    codes, first = W.distinct(data, starts, ends)
    return codes, pc.utf8_lower(W.texts_of(data, starts[first], ends[first])), upto


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # logits of each bucket
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, logits, whether the text has a letter)."""
        for begin, end, data, offsets in W.text_chunks(texts):
            out, letters = np.zeros((end - begin, len(self.labels))), np.zeros(end - begin, bool)
            if found := _distinct_words(data, offsets):
                codes, words, upto = found
                buckets, count = subwords(words)
                sums = np.add.reduceat(self.table[buckets], np.cumsum(count) - count, axis=0)
                lettered = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
                full = np.flatnonzero(np.diff(upto))
                at = upto[:-1][full]
                # float64 sums: a text's scores do not depend on the chunk it is in beyond rounding
                total = np.add.reduceat(count[codes], at)
                out[full] = np.add.reduceat(sums[codes], at, axis=0) / total[:, None] + self.bias
                letters[full] = np.logical_or.reduceat(lettered[codes], at)
            yield begin, end, out, letters

    def predict(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Label, score, and whether the text is accepted."""
        labels, scores, accepted = [], [], []
        names = np.array([*self.labels, UNKNOWN], object)
        for begin, end, logits, letters in self.logits(texts):
            if not self.labels:
                best, top = np.zeros(end - begin, int), np.zeros(end - begin)
                letters[:] = False
            else:
                p = softmax(logits / self.temperature)
                best = p.argmax(axis=1)
                top = p[np.arange(len(p)), best]
            labels.append(np.where(letters, names[best], UNKNOWN))
            scores.append(np.where(letters, top, 0.0))
            accepted.append(letters & (top >= self.reject_below))
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return join(labels, pa.string()), join(scores, pa.float64()), join(accepted, pa.bool_())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(docs: DataFrame) -> list[tuple[str, str, int]]:
    """The bounded training sample: (text, lang, fold), of each language those of the smallest hashes.

    A language's count bounds the hashes, so that no language, however large, brings more than a few thousand rows to
    the ranking; of longer texts the sample holds the first SAMPLE_CHARS characters."""
    usable = docs.select("doc_id", "text", "lang", fold().alias("fold")).where("fold != 0 and lang is not null and text is not null")
    hashed = usable.withColumn("h", F.xxhash64("doc_id"))
    counts = materialize(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    near = hashed.join(few(counts, 10_000) or counts, "lang").where(share * F.col("n") <= SPARE * PER_LANGUAGE)
    near = near.withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    ranked = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PER_LANGUAGE)
    chosen = ranked.orderBy("nth", "lang").limit(SAMPLE_ROWS)
    return [(r.text, r.lang, r.fold) for r in chosen.select("text", "lang", "fold").collect()]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs, in as few bytes as hold them: the driver keeps the sample's."""
    found = _distinct_words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    if found is None:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    codes, words, _ = found
    buckets, count = subwords(words)
    times = np.bincount(buckets, np.repeat(np.bincount(codes), count), BUCKETS)
    at = np.flatnonzero(times)
    return at.astype(np.min_scalar_type(BUCKETS - 1)), times[at].astype(np.min_scalar_type(int(times.max())))


def train(rows: list[tuple[str, str, int]]) -> Model:
    """Fold 1 of the sample calibrates; the others train."""
    labels = sorted({lang for _, lang, _ in rows})
    rng = np.random.default_rng(7)
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    weight, bias = np.zeros((DIMENSIONS, len(labels))), np.zeros(len(labels))
    made = [(*features(text), labels.index(lang), fold) for text, lang, fold in rows]
    made = [x for x in made if len(x[0])]
    held = [x for x in made if x[3] == 1]
    learned = [x for x in made if x[3] != 1] or made
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(learned))))
    steps, done = epochs * len(learned), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learned)):
            at, times, label, _ = learned[i]
            share = times / times.sum()
            rate = RATE * (1 - done / steps)
            rows_ = embedding[at]
            x = share @ rows_
            slope = softmax(x @ weight + bias)
            slope[label] -= 1
            back = weight @ slope
            weight -= rate * 0.1 * np.outer(x, slope)
            bias -= rate * 0.01 * slope
            embedding[at] = rows_ - rate * np.outer(share, back)
            done += 1
    model = Model(labels, embedding @ weight, bias)
    calibrate(model, held or learned)
    return model


def calibrate(model: Model, made: list[tuple[np.ndarray, np.ndarray, int, int]]) -> None:
    if not made:
        return
    logits = np.stack([times / times.sum() @ model.table[at] + model.bias for at, times, _, _ in made])
    truth = np.array([label for _, _, label, _ in made])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    model.reject_below = min(SURE, float(np.quantile(right, REJECTED_SHARE))) if len(right) else 0.0


def fit(docs: DataFrame) -> Model:
    model = train(sample(docs))
    give_back()  # the driver outlives its training
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score, accepted = model.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), label, score, accepted], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return map_batches(docs.select("doc_id", (fold() == 0).alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language the model does not reject."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(model.predict(batch.column(at))[2])

    return map_batches(docs, run, docs.schema)
