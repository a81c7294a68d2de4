"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector x of its hashed words (L2-normalised counts) and of
one indicator per structure statistic and metadata bin.  The score is
``sigmoid(w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``:
all pairwise interactions of rank ``RANK`` in time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common
from fluxgrid.llm.shingles import U, word_hashes

WORD_BITS, RANK = 17, 8
#: Bound of the labelled sample per class; the model is fitted on the driver on at most twice as many rows.
SAMPLE_PER_CLASS = 3_000
EPOCHS, RATE, DECAY = 6, 0.15, 1e-4
THRESHOLD, FOLDS = 0.3, 5
BINS = 12
STATISTICS = ("upper", "symbol", "digit", "pipe", "mark", "repeat", "fresh", "long", "lines", "words", "n_chars")
WIDTH = (1 << WORD_BITS) + BINS * len(STATISTICS)

_CLASS = np.zeros((5, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-!?()|"]] = True
_CLASS[2, 48:58] = True
_CLASS[3, 124] = True
_CLASS[4, 33] = True


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Fine bins near zero, coarse ones near one."""
    return np.minimum((np.sqrt(part / np.maximum(whole, 1)) * BINS).astype(np.int64), BINS - 1)


def _log_bin(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 0) + 1.0).astype(np.int64), BINS - 2)


def features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, feature numbers, values) of the texts; ``n_chars`` is negative where it is null."""
    rows = len(texts)
    words, bounds = word_hashes(texts)
    count = np.diff(bounds)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)

    def total(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[at[1:]] - sums[at[:-1]]

    row = np.repeat(np.arange(rows), count)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    key, times = np.unique((row.astype(np.uint64) << U(WORD_BITS)) | (words >> U(64 - WORD_BITS)), return_counts=True)
    owner, word = (key >> U(WORD_BITS)).astype(np.int64), (key & U((1 << WORD_BITS) - 1)).astype(np.int64)
    each = np.bincount(owner, minlength=rows)
    norm = np.sqrt(np.bincount(owner, weights=times.astype(float) ** 2, minlength=rows))
    letters = size - total(_CLASS[1:4][:, raw].any(axis=0), offsets)
    bins = [
        _share_bin(total(_CLASS[0][raw], offsets), letters),
        _share_bin(total(_CLASS[1][raw], offsets), size),
        _share_bin(total(_CLASS[2][raw], offsets), size),
        _share_bin(total(_CLASS[3][raw], offsets), count),
        _share_bin(total(_CLASS[4][raw], offsets), count),
        _share_bin(total(same, bounds), count),
        _share_bin(each, count),
        np.minimum((size / np.maximum(count, 1)).astype(np.int64), BINS - 1),
        _share_bin(total(raw == 10, offsets), count),
        _log_bin(count),
        np.where(n_chars < 0, BINS - 1, np.minimum(_log_bin(n_chars) // 2, BINS - 2)),
    ]
    dense = np.stack(bins, axis=1) + np.arange(len(bins)) * BINS + (1 << WORD_BITS)
    starts = np.concatenate([[0], np.cumsum(each + len(bins))])
    number, value = np.empty(starts[-1], np.int64), np.empty(starts[-1], np.float32)
    place = np.arange(len(owner)) + owner * len(bins)
    number[place], value[place] = word, times / norm[owner]
    tail = (starts[1:, None] - len(bins) + np.arange(len(bins))).ravel()
    number[tail], value[tail] = dense.ravel(), 0.5
    return starts, number, value


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, starts: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        vx = self.factors[number] * value[:, None]
        cut = starts[:-1]
        sums, squares = np.add.reduceat(vx, cut, axis=0), np.add.reduceat((vx * vx).sum(axis=1), cut)
        z = self.bias + np.add.reduceat(self.linear[number] * value, cut) + 0.5 * ((sums * sums).sum(axis=1) - squares)
        return 1.0 / (1.0 + np.exp(-np.clip(z.astype(float), -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float, seed: int = 7) -> FactorisationMachine:
    """Adagrad on (label, feature numbers, values); the bias is moved to the share of label 1 among all labels.

    Without rows of both labels the model is a constant, the share.
    """
    draw = np.random.default_rng(seed)
    share = min(max(share, 0.01), 0.99)
    model = FactorisationMachine(0.0, np.zeros(WIDTH, np.float32), draw.normal(0, 0.03, (WIDTH, RANK)).astype(np.float32))
    have = np.array([r[0] for r in rows])
    if not len(have) or have.min() == have.max():
        model.factors[:], model.bias = 0, float(np.log(share / (1 - share)))
        return model
    gw, gv, gb = np.full(WIDTH, 1e-2, np.float32), np.full((WIDTH, RANK), 1e-2, np.float32), 1e-2
    for _ in range(EPOCHS):
        for k in draw.permutation(len(rows)):
            label, number, value = rows[k]
            v, x = model.factors[number], value[:, None]
            vx = v * x
            s = vx.sum(axis=0)
            z = model.bias + float(model.linear[number] @ value) + 0.5 * float((s * s).sum() - (vx * vx).sum())
            g = 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0))) - label
            dw, dv = g * value + DECAY * model.linear[number], g * x * (s - vx) + DECAY * v
            gw[number] += dw * dw
            gv[number] += dv * dv
            gb += g * g
            model.linear[number] -= RATE * dw / np.sqrt(gw[number])
            model.factors[number] -= RATE * 0.3 * dv / np.sqrt(gv[number])
            model.bias -= RATE * g / gb**0.5
    there = have.mean()
    model.bias += float(np.log(share / (1 - share)) - np.log(there / (1 - there)))
    return model


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    text = common.as_string(batch, "text")
    at = batch.schema.get_field_index("n_chars")
    n = np.full(batch.num_rows, -1.0) if at < 0 else np.nan_to_num(batch.column(at).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False), nan=-1.0)
    return text, n


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, n = _columns(batch)
        number, value = [], []
        for a, b in common.chunks(text):
            s, i, x = features(text.slice(a, b - a), n[a:b])
            number += [i[p:q].astype(np.int32).tobytes() for p, q in zip(s[:-1], s[1:], strict=True)]
            value += [x[p:q].tobytes() for p, q in zip(s[:-1], s[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")).cast(pa.int32()), pa.array(number, pa.binary()), pa.array(value, pa.binary())], names=["label", "number", "value"])


def text_columns(docs: DataFrame) -> list[str]:
    return ["doc_id", "text"] + (["n_chars"] if "n_chars" in docs.columns else [])


def sampled_labels(labels: DataFrame, label: str, learn, per_class: int) -> tuple[DataFrame, int, int]:
    """(at most ``per_class`` ids of each class in the order of a hash, rows with label 0 and 1 in all).

    Repeated ids count once, with the larger label; null ids and labels not at all.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where(learn)
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = rows.where("label = 1").orderBy(*order).limit(per_class).union(rows.where("label = 0").orderBy(*order).limit(per_class))
    return some, n.get(0, 0), n.get(1, 0)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, per_class: int = SAMPLE_PER_CLASS) -> FactorisationMachine:
    """Fit, in one task, on a bounded sample of the labelled rows outside the held-out fold."""
    some, n0, n1 = sampled_labels(labels, label, common.crc_fold("doc_id", folds) != 0, per_class)
    picked = docs.select(*text_columns(docs)).join(F.broadcast(some), "doc_id")  # at most 2 * per_class ids
    share = n1 / max(n0 + n1, 1)

    def learn(table: pa.Table) -> FactorisationMachine:
        columns = (table["label"].to_pylist(), table["number"].to_pylist(), table["value"].to_pylist())
        return fit([(y, np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32)) for y, i, x in sorted(zip(*columns, strict=True))], share)

    return common.fitted(picked.mapInArrow(common.trimmed(_sampled), "label int, number binary, value binary"), learn)


def _score(batch: pa.RecordBatch, model: FactorisationMachine) -> np.ndarray:
    text, n = _columns(batch)
    out = [model.score(*features(text.slice(a, b - a), n[a:b])) for a, b in common.chunks(text)]
    return np.concatenate(out) if out else np.empty(0)


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """Per document: doc_id, held_out, score in [0, 1] and predicted (score >= threshold).

    A null text scores as an empty one; a null id is not held out.  Columns
    other than doc_id, text and n_chars are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: WIDTH * (RANK + 1) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _score(batch, held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select(*text_columns(docs)).mapInArrow(common.trimmed(run), f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(common.crc_fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, whole and unchanged, whose score reaches the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score(batch, held.value) >= threshold))

    return docs.mapInArrow(common.trimmed(run), docs.schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside fold 0 of 5."""
    docs = common.table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, common.table(spark, sf_dir, "labels")))
