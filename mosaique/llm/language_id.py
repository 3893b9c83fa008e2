"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, texts_of

#: Hash buckets as a power of two, longest n-gram, smoothing, bytes of text scored together.
BITS, LONGEST, ALPHA, CHUNK_BYTES = 16, 3, 0.5, 1 << 20
#: Labelled rows that a model is fitted on at most, about; labels, and characters, that are scored together.
TRAIN_ROWS, LABEL_BLOCK, ROW_BLOCK = 60_000, 64, 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of lower-cased texts, a row for each character and a column for each length;
    where each text's rows begin; whether it has a letter. Runs of other characters count as one space."""
    lowered = [text.lower() for text in texts]
    lengths = np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts))
    # a space stands between texts
    chars = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[chars]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    begins = 1 + np.concatenate([[0], np.cumsum(lengths + 1)])
    rows = np.concatenate([[0], np.cumsum(keep)])
    starts = rows[begins]
    chars, letter = np.where(letter, chars, np.uint32(32))[keep], letter[keep]
    has = np.diff(np.concatenate([[0], np.cumsum(letter)])[starts]) > 0
    # more spaces end each text while n-grams are made, so that its last ones do not reach into the next
    own = np.insert(np.ones(len(chars), dtype=bool), np.repeat(starts[1:], LONGEST - 1), False)
    chars = np.insert(chars, np.repeat(starts[1:], LONGEST - 1), np.uint32(32))
    hashed = np.empty((len(chars), LONGEST), dtype=np.uint32)
    code = np.zeros(len(chars), dtype=np.uint32)
    for n in range(LONGEST):
        later = chars if n == 0 else np.concatenate([chars[n:], np.full(min(n, len(chars)), 32, dtype=np.uint32)])[: len(chars)]
        code = (code + later + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        hashed[:, n] = (code * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
    return hashed[own], starts, has


@dataclass
class Model:
    """labels in order; weights: log probabilities, a row for each bucket and a column for each label."""

    labels: list[str]
    priors: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.labels:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        hashed, starts, has = ngrams(texts)
        scores = np.tile(self.priors, (len(texts), 1))
        for label in range(0, len(self.labels), LABEL_BLOCK):
            weights = self.weights[:, label : label + LABEL_BLOCK]
            for row in range(int(starts[0]), int(starts[-1]), ROW_BLOCK):  # a long text is scored in parts
                end = min(row + ROW_BLOCK, int(starts[-1]))
                sums = weights[hashed[row:end, 0]]
                for n in range(1, LONGEST):
                    sums += weights[hashed[row:end, n]]
                first = int(np.searchsorted(starts, row, side="right")) - 1
                last = int(np.searchsorted(starts, end, side="left"))
                at = np.maximum(starts[first:last], row) - row
                filled = np.flatnonzero(np.diff(np.append(at, end - row)))  # texts that have rows here
                scores[first + filled, label : label + LABEL_BLOCK] += np.add.reduceat(sums, at[filled], axis=0, dtype=np.float64)
        best = scores.argmax(axis=1)
        share = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.labels[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, share, 0.0).tolist()


def fit(docs: DataFrame, text: str = "text", label: str = "lang", seed_column: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from the text and label of the rows of docs that have a label; a null text counts as empty.

    If there are more than train_rows of them, about that many are taken by a hash of seed_column. Counts are
    folded in each task before they are shuffled; a model of labels times 2**BITS numbers reaches the driver, however
    many labels there are, and is scored LABEL_BLOCK labels at a time."""
    rows = docs.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("body"), F.col(seed_column).alias("seed"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    labels = sorted(sizes)
    number = {x: i for i, x in enumerate(labels)}
    total = sum(sizes.values())
    if total > train_rows:
        rows = rows.filter(F.pmod(F.xxhash64("seed"), F.lit(1_000_000)) < F.lit(int(1_000_000 * train_rows / total)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = len(labels) <= LABEL_BLOCK  # then a task's counts are held whole, else those of a chunk
        sums = np.zeros(len(labels) << BITS if few else 0, dtype=np.int64)

        def counted(flat: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((flat >> BITS).astype(np.int32)), pa.array((flat & ((1 << BITS) - 1)).astype(np.int32)), pa.array(n)], ["label", "bucket", "n"])

        for batch in batches:
            for part in pieces_of(batch, 1, CHUNK_BYTES):
                hashed, starts, _ = ngrams(texts_of(part.column(1)))
                of = np.array([number[x] for x in part.column(0).to_pylist()], dtype=np.int64)
                spread = np.repeat(of, np.diff(starts))
                inside = hashed[starts[0] : starts[-1]]
                flat = (spread[:, None] << BITS) + inside
                if few:
                    sums += np.bincount(flat.ravel(), minlength=sums.size)
                else:
                    yield counted(*np.unique(flat, return_counts=True))
        yield counted(np.flatnonzero(sums), sums[np.flatnonzero(sums)])

    counts = np.full((1 << BITS, len(labels)), ALPHA)
    if labels:
        found = rows.select("label", "body").mapInArrow(count, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
        counts[found.column("bucket").to_numpy(), found.column("label").to_numpy()] += found.column("n").to_numpy()
    weights = np.log(counts / counts.sum(axis=0)).astype(np.float32) if labels else np.zeros((1 << BITS, 0), np.float32)
    return Model(labels, np.log(np.array([sizes[x] / total for x in labels])) if labels else np.zeros(0), weights)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added (they replace columns of these names).

    lang_pred is a learned label, or `und` with score 0 where the text is null or has no letter, or nothing was
    learned. score is the label's posterior probability. Equal scores go to the first label in order. Whole
    texts are scored, in chunks of rows, a long one in parts whose scores are added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text)
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, at, CHUNK_BYTES):
                labels, scores = sent.value.predict(texts_of(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*names).mapInArrow(run, schema)


def identify_keys(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As identify, but returns the key, lang_pred and score only, so that texts do not come back from Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1, CHUNK_BYTES):
                labels, scores = sent.value.predict(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
