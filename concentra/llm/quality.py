"""Quality scores by random Fourier features and ridge regression (op 5).

Every text becomes a fixed row of statistics (lengths, shares of kinds of
characters, repetition of words, word triples and lines), computed over the whole
text. Labelled training rows give their mean and spread; the standardised row is
mapped by random cosines that approximate a Gaussian kernel, the plain row and a
constant stand beside them. Normal equations are summed per partition and then
over partitions, the ridge weights are solved on the driver (the matrix has a
fixed size), and the scores of the training rows are calibrated to probabilities
by isotonic regression over fixed bins.

Defined cases: a null text counts as empty; empty texts have a score too (that
of the all-zero statistics); without any labelled row every score is 0.5; a
document that is labelled twice counts twice; labels other than 0 and 1 or null
are left out; language, source, id and labels are no inputs; an empty table
gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import stored
from .langid import remainder
from .registry import read_table, register
from .words import Piece, hash_spans, pieces, split_words, windows

FEATURES = 192
RIDGE = 1.0
BINS = 512
SEED = 5
THRESHOLD = 0.3
_FAN = 16

_KINDS = {  # byte classes
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\r\x0b\x0c", "line": b"\n",
    "stop": b".?", "exclaim": b"!", "comma": b",;:", "quote": b"'\"`", "bracket": b"()[]{}<>", "dash": b"-_/\\~", "mark": b"#$%&*", "bar": b"|", "sign": b"@+=^",
}
_VOWELS = b"aeiouAEIOU"


def _ratio(a, b):
    return np.asarray(a, float) / np.maximum(b, 1)


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of values and of distinct values between consecutive bounds."""
    n = np.diff(first)
    return n, np.array([len(np.unique(values[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], np.int64)


def statistics(piece: Piece) -> np.ndarray:
    """One row per document."""
    n = len(piece.offsets) - 1
    size = np.diff(piece.offsets)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 256 + piece.data, minlength=n * 256).reshape(n, 256)
    words = split_words(piece)
    length = words.ends - words.starts
    of = np.repeat(np.arange(n), np.diff(words.first))
    n_words, distinct = _distinct(words.hashes, words.first)
    total = np.bincount(of, length, n)
    spread = np.sqrt(np.maximum(_ratio(np.bincount(of, length.astype(float) ** 2, n), n_words) - _ratio(total, n_words) ** 2, 0))
    last = piece.data[words.ends - 1] if len(length) else np.zeros(0, np.uint8)
    front = piece.data[words.starts] if len(length) else last
    kind = np.zeros(256, np.uint8)
    for i, k in enumerate(("lower", "upper", "digit", "mark", "exclaim", "bar", "stop", "comma")):
        kind[list(_KINDS[k])] = i + 1
    kind[0x80:] = 1
    ends_in = [_ratio(np.bincount(of[kind[last] == i], minlength=n), n_words) for i in range(1, 9)]
    starts_in = [_ratio(np.bincount(of[kind[front] == i], minlength=n), n_words) for i in (1, 2, 3)]
    grams = windows(words.hashes, 3)
    tri = np.array([len(np.unique(grams[a : b - 2])) / (b - a - 2) if b - a > 2 else 1.0 for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)])
    # lines
    breaks = np.zeros(len(piece.data) + 1, bool)
    breaks[piece.offsets] = True
    breaks[1:] |= piece.data == 0x0A
    line = np.flatnonzero(breaks[:-1])
    line_first = np.searchsorted(line, piece.offsets)
    ends = np.append(line[1:], len(piece.data)) if len(line) else line
    n_lines, distinct_lines = _distinct(hash_spans(piece.data, line, ends), line_first)
    share = [_ratio(counts[:, list(b)].sum(1), size) for b in _KINDS.values()]
    letters = counts[:, list(_KINDS["lower"] + _KINDS["upper"])].sum(1)
    short = np.bincount(of[length <= 2], minlength=n)
    long = np.bincount(of[length > 14], minlength=n)
    wide = np.zeros(n)
    np.maximum.at(wide, of, length)
    columns = [
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), _ratio(total, n_words), spread, np.log1p(wide), _ratio(short, n_words), _ratio(long, n_words),
        1 - _ratio(distinct, n_words) * (n_words > 0), tri, 1 - _ratio(distinct_lines, n_lines) * (n_lines > 0), np.log1p(_ratio(size, n_lines)),
        _ratio(counts[:, 0x80:].sum(1), size), _ratio(counts[:, list(_VOWELS)].sum(1), letters), (counts > 0).sum(1) / 64.0, *share, *ends_in, *starts_in,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x) with the statistics of every row of ``docs``."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column("text")):
                x = statistics(piece).astype(np.float32)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(piece.lo, piece.hi - piece.lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))],
                    ["doc_id", "x"],
                )

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, x array<float>")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    levels: np.ndarray  # calibrated probability of each bin of the raw score


def random_features(x: np.ndarray, model: Model) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    d = model.directions.shape[1]
    return np.concatenate([np.sqrt(2 / d) * np.cos(z @ model.directions + model.phases), z, np.ones((len(z), 1))], axis=1)


def _sums(frame: DataFrame, part, width: int) -> np.ndarray:
    """Sum of the float64 arrays that ``part(x, y)`` makes of each batch, over all
    rows of ``frame`` (x, y): summed per task, then in ``_FAN`` tasks, then here."""

    def local(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                some = part(_matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64))
                total = some if total is None else total + some
        if total is not None:
            yield pa.record_batch([[total.tobytes()]], ["sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for x in table.column("sums"):
            total += np.frombuffer(x.as_buffer())
        return pa.table({"sums": [total.tobytes()]})

    sums = frame.select("x", "y").mapInArrow(local, "sums binary").withColumn("k", F.pmod(F.spark_partition_id(), F.lit(_FAN)))
    sums = sums.groupBy("k").applyInArrow(lambda t: merge(t.select(["sums"])), "sums binary")
    return sum((np.frombuffer(r.sums) for r in sums.collect()), np.zeros(width))


def fit(train: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """Model from (x, y) rows; None without rows."""
    head = train.first()
    if head is None:
        return None
    width = len(head.x)
    moments = _sums(train, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * width)
    n, mean = moments[0], moments[1 : 1 + width] / moments[0]
    scale = np.sqrt(np.maximum(moments[1 + width :] / n - mean**2, 1e-12))
    scale = np.where(scale < 1e-5, 1.0, scale)
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(size=(width, features)) / np.sqrt(width), rng.uniform(0, 2 * np.pi, features), np.zeros(0), np.zeros(0))
    d = features + width + 1

    def equations(x, y):
        f = random_features(x, model)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    total = _sums(train, equations, d * d + d)
    gram = total[: d * d].reshape(d, d) + ridge * np.diag(np.append(np.ones(d - 1), 1e-9))
    model = model._replace(weights=np.linalg.solve(gram, total[d * d :]))

    def binned(x, y):
        b = score_bin(random_features(x, model) @ model.weights)
        return np.concatenate([np.bincount(b, minlength=BINS), np.bincount(b, y, BINS)])

    total = _sums(train, binned, 2 * BINS)
    return model._replace(levels=isotonic(total[:BINS], total[BINS:]))


def score_bin(raw: np.ndarray) -> np.ndarray:
    """Bins of equal width over raw scores from -0.5 to 1.5."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def isotonic(count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over bins; one positive and one negative count,
    spread by the overall share, keep the ends off 0 and 1. Bins without rows
    take the level of the next filled bin below (the first filled one at the start)."""
    overall = positive.sum() / count.sum()
    filled = np.flatnonzero(count > 0)
    stack: list[list[float]] = []  # weight, positives, number of bins
    for i in filled:
        stack.append([count[i], positive[i], 1])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            w, p, k = stack.pop()
            stack[-1] = [stack[-1][0] + w, stack[-1][1] + p, stack[-1][2] + k]
    level = np.concatenate([np.full(int(k), (p + overall) / (w + 1)) for w, p, k in stack])
    level = np.maximum.accumulate(level)
    at = np.clip(np.searchsorted(filled, np.arange(len(count)), "right") - 1, 0, None)
    return level[at]


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of rows (doc_id, x)."""
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                raw = random_features(_matrix(batch.column("x")), shared.value) @ shared.value.weights
                # within a bin the raw score breaks ties without leaving the calibrated order
                fine = np.clip((raw + 0.5) / 2, 0, 1)
                yield pa.record_batch([batch.column("doc_id"), pa.array(np.clip(shared.value.levels[score_bin(raw)] + 1e-6 * (fine - 0.5), 0, 1))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out=None) -> DataFrame:
    """(doc_id, score): trained on the labelled documents for which the column
    ``held_out`` of the id is false."""
    rows = stored(with_statistics(docs), "statistics")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("y"))
    train = rows.join(known, "doc_id")
    train = stored(train if held_out is None else train.where(~held_out), "training-rows")
    return score(rows, fit(train))


@register("op5_quality")
def op5_quality(spark, sf_dir):
    held_out = remainder(F.col("doc_id"), 5) == 0
    out = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), held_out=held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
