"""Language identification by interpolated Kneser-Ney character models (op 9).

One model of order three per language. Texts are lower-cased, every run of
non-letters becomes one blank, and a blank stands before and after a text.
Trigram counts are gathered from ALL training texts (counted per piece in
numpy, summed in Spark); continuation counts, discounts and back-off weights
follow from all of them by groupBy in Spark. A model is a set of sorted key
arrays with values beside them, in one file that every machine gets and maps,
read by binary search: neither the driver nor a worker holds it as a whole, and
its size is bounded by the trigrams there are. The language with the lowest
cross-entropy per character wins. Rejection is calibrated on the training texts: a text goes
when its cross-entropy exceeds the mean of training texts of that language and
length class by ``z`` standard deviations.

Defined cases: null, empty or letterless text: ``und``, score 0, rejected; no
labelled row at all: every text ``und``; ties between languages go to the
first name in order; repeated rows are counted and answered one by one; the
id may be null; other columns pass through untouched.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import stored
from .registry import read_table, register
from .words import Piece, code_points, pieces

#: rows of the model that pass through the driver at once, on their way to the file
SLICE_ROWS = 1_000_000
#: standard deviations above the training mean at which a text is rejected,
#: and the least standard deviation (nats per character) that counts
Z_REJECT = 6.0
LEAST_SPREAD = 0.25

#: bytes of text looked at once: there are several numbers for every character
PIECE_BYTES = 1 << 20

_POINTS = 0x110000
_BITS = 21
_DENSE = 1 << 22
_BLANK = 32


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Code point -> lower-case letter, or blank for anything but a letter."""
    fold = np.full(_POINTS, _BLANK, np.uint32)
    for cp in range(_POINTS):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            fold[cp] = ord(low) if len(low) == 1 else cp
    return fold


class Trigrams(NamedTuple):
    codes: np.ndarray  # one per trigram, dense or position in ``keys``
    first: np.ndarray  # first trigram of each document
    keys: np.ndarray  # packed trigram of each used code, ascending
    used: np.ndarray  # the used codes
    size: int  # codes are below this


def trigrams(piece: Piece) -> Trigrams:
    points, offsets = code_points(piece)
    n = len(offsets) - 1
    # a blank before and after each document
    doc = np.repeat(np.arange(n), np.diff(offsets) + 2)
    text = np.full(len(doc), _BLANK, np.uint32)
    at = np.arange(len(points)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1
    text[at] = _folding()[points]
    same = np.zeros(len(text), bool)
    same[1:] = doc[1:] == doc[:-1]
    keep = np.ones(len(text), bool)
    keep[1:] = ~((text[1:] == _BLANK) & (text[:-1] == _BLANK) & same[1:])
    text, doc = text[keep], doc[keep]
    count = np.maximum(np.bincount(doc, minlength=n) - 2, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    here = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    present = np.flatnonzero(np.bincount(text, minlength=1)) if len(text) else np.zeros(0, np.int64)
    a = len(present)
    dense = np.zeros(int(present[-1]) + 1 if a else 1, np.int64)
    dense[present] = np.arange(a)
    ids = dense[text]
    codes = (ids[here] * a + ids[here + 1]) * a + ids[here + 2]
    if a**3 <= _DENSE:
        used = np.flatnonzero(np.bincount(codes, minlength=1))
        size = max(a**3, 1)
        parts = used
    else:
        parts, codes = np.unique(codes, return_inverse=True)
        used, size = np.arange(len(parts)), max(len(parts), 1)
    keys = np.zeros(0, np.int64)
    if a and len(parts):
        keys = (present[parts // (a * a)] << (2 * _BITS)) | (present[parts // a % a] << _BITS) | present[parts % a]
    return Trigrams(codes, first, keys, used, size)


class KneserNey(NamedTuple):
    """Sorted keys and, beside them, discounted shares and back-off weights."""

    tri: np.ndarray
    tri_p: np.ndarray
    ctx2: np.ndarray
    ctx2_w: np.ndarray
    bi: np.ndarray
    bi_p: np.ndarray
    ctx1: np.ndarray
    ctx1_w: np.ndarray
    uni: np.ndarray
    uni_p: np.ndarray
    floor: float


def _discount(counts: np.ndarray) -> float:
    one, two = float((counts == 1).sum()), float((counts == 2).sum())
    d = one / (one + 2 * two) if one else 0.5
    return min(max(d, 0.1), 0.9)


def _level(context: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discounted share of each entry; contexts and their back-off weights."""
    d = _discount(counts)
    ctx, inverse = np.unique(context, return_inverse=True)
    total = np.bincount(inverse, counts, len(ctx))
    kinds = np.bincount(inverse, minlength=len(ctx))
    return np.maximum(counts - d, 0) / total[inverse], ctx, d * kinds / total


def fit_language(keys: np.ndarray, counts: np.ndarray, alphabet: int) -> KneserNey:
    """The model of one language from its trigram counts."""
    order = np.argsort(keys)
    tri, counts = keys[order], counts[order].astype(float)
    tri_p, ctx2, ctx2_w = _level(tri >> _BITS, counts)
    low = (1 << (2 * _BITS)) - 1
    bi, left = np.unique(tri & low, return_counts=True)  # in how many contexts a bigram ends
    bi_p, ctx1, ctx1_w = _level(bi >> _BITS, left.astype(float))
    uni, left = np.unique(bi & ((1 << _BITS) - 1), return_counts=True)
    d = _discount(left)
    floor = d * len(uni) / left.sum() / alphabet
    return KneserNey(tri, tri_p, ctx2, ctx2_w, bi, bi_p, ctx1, ctx1_w, uni, (left - d) / left.sum() + floor, floor)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def log_probability(model: KneserNey, keys: np.ndarray) -> np.ndarray:
    """Natural log of the interpolated probability of each packed trigram's
    last character after its first two."""
    one = (1 << _BITS) - 1
    low = (1 << (2 * _BITS)) - 1
    p = _find(model.uni, model.uni_p, keys & one, model.floor)
    p = _find(model.bi, model.bi_p, keys & low, 0.0) + _find(model.ctx1, model.ctx1_w, (keys >> _BITS) & one, 1.0) * p
    p = _find(model.tri, model.tri_p, keys, 0.0) + _find(model.ctx2, model.ctx2_w, keys >> _BITS, 1.0) * p
    return np.log(p)


@lru_cache(maxsize=2)
def _opened(path: str, sizes: tuple, floors: tuple) -> tuple[KneserNey, ...]:
    """The models in a file: the sorted keys of every level of every language,
    then the values of all. The file is mapped, not read."""
    rows = sum(map(sum, sizes))
    keys = np.memmap(path, "<i8", "r", 0, (rows,))
    values = np.memmap(path, "<f8", "r", 8 * rows, (rows,))
    parts, at = [], 0
    for levels, floor in zip(sizes, floors, strict=True):
        arrays = []
        for n in levels:
            arrays += [keys[at : at + n].view(np.ndarray), values[at : at + n].view(np.ndarray)]
            at += n
        parts.append(KneserNey(*arrays, floor))
    return tuple(parts)


class Model(NamedTuple):
    languages: tuple[str, ...]
    #: name among the files of the application, rows of each level by language,
    #: probability of a character never seen by language
    file: str
    sizes: tuple[tuple[int, ...], ...]
    floors: tuple[float, ...]
    #: (language, length class) -> highest accepted cross-entropy
    limits: dict

    @property
    def parts(self) -> tuple[KneserNey, ...]:
        return _opened(SparkFiles.get(self.file), self.sizes, self.floors) if self.languages else ()


def length_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def score_piece(model: Model, piece: Piece):
    """Per document: best language (-1: none), posterior, cross-entropy, trigrams."""
    g = trigrams(piece)
    n = len(g.first) - 1
    count = np.diff(g.first)
    total = np.zeros((len(model.languages), n))
    some = count > 0
    for i, part in enumerate(model.parts):  # one language's values at a time
        table = np.zeros(g.size, np.float32)
        table[g.used] = log_probability(part, g.keys)
        if some.any():
            total[i, some] = np.add.reduceat(table[g.codes].astype(np.float64), g.first[:-1][some])
    if not model.languages:
        return np.full(n, -1), np.zeros(n), np.zeros(n), count
    best = np.argmax(total, axis=0)
    top = total[best, np.arange(n)]
    posterior = 1.0 / np.exp(total - top).sum(axis=0)
    best = np.where(some, best, -1)
    return best, np.where(some, posterior, 0.0), np.where(some, -top / np.maximum(count, 1), 0.0), count


def _counter(text: str, lang: str) -> Callable:
    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(lang).to_pylist(), object)
            for piece in pieces(batch.column(text), PIECE_BYTES):
                g = trigrams(piece)
                of = np.repeat(np.arange(len(g.first) - 1), np.diff(g.first))
                names, index = np.unique(langs[piece.lo : piece.hi].astype(str), return_inverse=True)
                for i, name in enumerate(names):
                    counts = np.bincount(g.codes[(index == i)[of]], minlength=g.size)[g.used]
                    seen = counts > 0
                    yield pa.record_batch(
                        [pa.array([name] * int(seen.sum()), pa.string()), pa.array(g.keys[seen], pa.int64()), pa.array(counts[seen], pa.int64())],
                        ["lang", "key", "n"],
                    )

    return run


def count_trigrams(train: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, key, n) over all rows of ``train`` with a label and a text."""
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    return rows.mapInArrow(_counter("text", "lang"), "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _spark_discount(entries: DataFrame) -> DataFrame:
    """``_discount`` of each language: (lang, d)."""
    one, two = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    d = F.when(one > 0, one / (one + 2 * two)).otherwise(F.lit(0.5))
    return entries.groupBy("lang").agg(F.least(F.greatest(d, F.lit(0.1)), F.lit(0.9)).alias("d"))


def _spark_level(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_level`` of all languages: (lang, key, value) of entries and of contexts."""
    entries = entries.withColumn("c", F.shiftright("key", _BITS))
    ctx = entries.groupBy("lang", "c").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    ctx = ctx.join(F.broadcast(_spark_discount(entries)), "lang")
    share = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("t")
    shares = entries.join(ctx, ["lang", "c"]).select("lang", "key", share.alias("value"))
    return shares, ctx.select("lang", F.col("c").alias("key"), (F.col("d") * F.col("k") / F.col("t")).alias("value"))


def _tables(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``fit_language`` makes, of all languages: (lang, level, key, value)
    with the levels in the order of ``KneserNey``, and (lang, floor)."""
    bi = counts.groupBy("lang", F.col("key").bitwiseAND((1 << (2 * _BITS)) - 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    uni = bi.groupBy("lang", F.col("key").bitwiseAND((1 << _BITS) - 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    alphabet = uni.select("key").distinct().count() + 1
    totals = uni.groupBy("lang").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).join(_spark_discount(uni), "lang")
    floors = totals.select("lang", "d", "t", (F.col("d") * F.col("k") / F.col("t") / F.lit(alphabet)).alias("floor"))
    ends = uni.join(F.broadcast(floors), "lang").select("lang", "key", ((F.col("n") - F.col("d")) / F.col("t") + F.col("floor")).alias("value"))
    levels = [*_spark_level(counts), *_spark_level(bi), ends]
    levels = [x.select("lang", F.lit(i).alias("level"), "key", "value") for i, x in enumerate(levels)]
    return reduce(DataFrame.unionAll, levels), floors.select("lang", "floor")


def _packed(batches):
    for batch in batches:
        keys, values = batch.column(0).to_numpy().astype("<i8"), batch.column(1).to_numpy().astype("<f8")
        yield pa.record_batch([pa.array([keys.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["k", "v"])


def _to_file(counts: DataFrame) -> Model:
    """The models of all languages, in a file of the application. The rows pass
    through the driver in sorted slices and are held there one slice at a time."""
    spark = counts.sparkSession
    table, floors = _tables(counts)
    table = stored(table, "langid-model")
    rows = {(r["lang"], r["level"]): r["n"] for r in table.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return Model((), "", (), (), {})
    floors = {r["lang"]: r["floor"] for r in floors.collect()}  # one row per language
    names = tuple(sorted(floors))
    sizes = tuple(tuple(rows[x, level] for level in range(5)) for x in names)
    order = ["lang", "level", "key"]
    slices = table.repartitionByRange(-(-sum(rows.values()) // SLICE_ROWS), *order).sortWithinPartitions(*order)
    folder = tempfile.mkdtemp(prefix="concentra-langid-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors ask for it until then
    path = os.path.join(folder, os.path.basename(folder))
    with open(path, "wb") as keys, open(path, "r+b") as values:
        values.seek(8 * sum(rows.values()))
        for row in slices.select("key", "value").mapInArrow(_packed, "k binary, v binary").toLocalIterator():
            keys.write(row.k)
            values.write(row.v)
    spark.sparkContext.addFile(path)
    return Model(names, os.path.basename(path), sizes, tuple(floors[x] for x in names), {})


def fit(train: DataFrame, text: str = "text", lang: str = "lang", z: float = Z_REJECT) -> Model:
    """Models of all languages and their rejection limits, from all rows of
    ``train`` and all their trigrams. The counts are a stored table: they are read
    several times, and kept on no executor's heap."""
    model = _to_file(stored(count_trigrams(train, text, lang), "trigram-counts"))
    return model._replace(limits=_limits(train, model, text, lang, z))


def _limits(train: DataFrame, model: Model, text: str, lang: str, z: float) -> dict:
    """Mean + z standard deviations of the cross-entropy by language and length."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column("text"), PIECE_BYTES):
                best, _, ce, count = score_piece(shared.value, piece)
                ok = best >= 0
                yield pa.record_batch([pa.array(best[ok], pa.int64()), pa.array(length_class(count[ok]), pa.int64()), pa.array(ce[ok])], ["best", "length", "ce"])

    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna().select("text")
    stats = rows.mapInArrow(run, "best bigint, length bigint, ce double").groupBy("best", "length").agg(F.avg("ce").alias("m"), F.coalesce(F.stddev_samp("ce"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n"))
    found = {(r.best, r.length): (r.m, r.s, r.n) for r in stats.collect()}  # languages x length classes
    limits = {}
    for (best, length), (m, s, n) in found.items():
        # a class of few texts says little about its spread: take the widest of the language
        wide = max([s, LEAST_SPREAD, *(s2 for (b2, _), (_, s2, n2) in found.items() if b2 == best and n < 30 <= n2)])
        limits[best, length] = m + z * wide
    return limits


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (posterior among the learned
    languages), ``lang_ce`` (cross-entropy per character, nats) and
    ``lang_rejected`` appended; columns of ``docs`` with these names give way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"lang_pred": T.StringType(), "lang_score": T.DoubleType(), "lang_ce": T.DoubleType(), "lang_rejected": T.BooleanType()}
    docs = docs.select(*[c for c in docs.columns if c not in added])
    names = [*docs.columns, *added]
    at = docs.columns.index(text)

    def run(batches):
        model = shared.value
        labels = np.array([*model.languages, "und"], object)
        widest: dict = {}
        for (b, _), limit in model.limits.items():
            widest[b] = max(limit, widest.get(b, limit))
        for batch in batches:
            for piece in pieces(batch.column(at), PIECE_BYTES):
                best, posterior, ce, count = score_piece(model, piece)
                length = length_class(count)
                # a length without training texts takes the language's highest limit
                over = [b < 0 or c > model.limits.get((b, n), widest.get(b, np.inf)) for b, n, c in zip(best.tolist(), length.tolist(), ce.tolist(), strict=True)]
                part = batch.slice(piece.lo, piece.hi - piece.lo)
                yield pa.record_batch([*part.columns, pa.array(labels[best], pa.string()), pa.array(posterior), pa.array(ce), pa.array(over, pa.bool_())], names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in added.items())])
    return docs.mapInArrow(run, schema)


def remainder(key: Column, m: int) -> Column:
    """crc32 of the key as text, modulo m (a null key: 0)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % m, F.lit(0))


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.where(remainder(F.col(key), 4) != 2)


@register("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = fit(training_rows(docs))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"), "lang_ce", "lang_rejected",
    )
