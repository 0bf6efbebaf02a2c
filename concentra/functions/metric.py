"""Concentration metric on score vectors, as JVM-side column expressions.

A score vector (one row per position, ``array<float|double>``) is turned into
a probability vector by a max-shifted softmax; the metric ``ned`` (normalised
entropy deficit) is KL(p || uniform) / ln(n) = 1 - H(p) / ln(n): 0 for a
uniform distribution, 1 for a point mass.

Closed form used here, with z = (x - max x) / temp, e = exp(z), s = sum(e):

    sum p ln p = sum(e * z) / s - ln s
    ned        = 1 + (sum(e * z) / s - ln s) / ln n

so no per-element logarithm is needed and no probability is clamped: terms
that a float32 softmax would flush to zero contribute below 1e-40 here.
Everything is computed in double. A one-element vector gives 0/0 -> NULL.

All functions return ``Column`` objects built from higher-order functions
(``aggregate``/``transform``), so they stay inside the JVM. For very wide
vectors (150K entries) ``ned_arrow`` runs the same formula in numpy on Arrow
batches; bench both on the target width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _temp(temp) -> Column:
    if temp is None:
        return F.lit(1.0)
    return _col(temp) if isinstance(temp, (str, Column)) else F.lit(float(temp))


def as_double_array(scores) -> Column:
    """Cast a float array to double before any arithmetic (same on both engines)."""
    return F.transform(_col(scores), lambda x: x.cast("double"))


def temper(scores, temp) -> Column:
    """Divide every score by the temperature."""
    t = _temp(temp)
    return F.transform(_col(scores), lambda x: x.cast("double") / t)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Expressions inside a higher-order lambda are re-evaluated for every
    element; a per-row constant such as ``array_max(scores)`` must therefore
    be bound outside (here: a one-element ``transform``), or the cost per
    vector grows with the square of its width.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _exp_sum(x: Column, m: Column, t: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp((v.cast("double") - m) / t))


def softmax(scores, temp=None) -> Column:
    """Max-shifted softmax of (scores / temp), double precision."""
    x = _col(scores)
    t = _temp(temp)
    return _bind(
        F.array_max(x).cast("double"),
        lambda m: _bind(
            _exp_sum(x, m, t),
            lambda s: F.transform(x, lambda v: F.exp((v.cast("double") - m) / t) / s),
        ),
    )


def ned(scores, temp=None) -> Column:
    """Normalised entropy deficit of softmax(scores / temp)."""
    x = _col(scores)
    t = _temp(temp)
    ln_n = F.log(F.size(x).cast("double"))

    def with_max(m):
        s = _exp_sum(x, m, t)
        q = F.aggregate(
            x,
            F.lit(0.0),
            lambda acc, v: acc
            + F.exp((v.cast("double") - m) / t) * ((v.cast("double") - m) / t),
        )
        return F.lit(1.0) + (q / s - F.log(s)) / F.nullif(ln_n, F.lit(0.0))

    return _bind(F.array_max(x).cast("double"), with_max)


def argmax_token(scores) -> Column:
    """C4: 0-based index of the largest score (first one on ties)."""
    x = _col(scores)
    return (F.array_position(x, F.array_max(x)) - 1).cast("bigint")


def topk_mass(scores, k: int, temp=None) -> Column:
    """Summed probability of the k most likely entries (k clipped to width)."""
    p = softmax(scores, temp)
    top = F.slice(F.sort_array(p, asc=False), 1, int(k))
    return F.aggregate(top, F.lit(0.0), lambda acc, v: acc + v)


def topk_masses(scores, ks, temps=(1.0,)) -> Column:
    """C5 for several k and temperatures: array of struct(temp, m<k>...).

    The order of the entries does not depend on the temperature, so the raw
    scores are sorted once; each mass is a sum over the head of that order
    (k clipped to width), and the normaliser is one sum per temperature.
    """
    x = _col(scores)

    def head(xs: Column, m: Column, s: Column, t: Column, k: int) -> Column:
        return F.aggregate(F.slice(xs, 1, int(k)), F.lit(0.0), lambda acc, v: acc + F.exp((v.cast("double") - m) / t)) / F.nullif(s, F.lit(0.0))

    def at_temp(xs: Column, m: Column, temp: float) -> Column:
        t = F.lit(float(temp))
        return _bind(
            _exp_sum(xs, m, t),
            lambda s: F.struct(t.alias("temp"), *[head(xs, m, s, t, k).alias(f"m{k}") for k in ks]),
        )

    return _bind(
        F.sort_array(x, asc=False),
        lambda xs: _bind(F.get(xs, F.lit(0)).cast("double"), lambda m: F.array(*[at_temp(xs, m, t) for t in temps])),
    )


def entropy_from_ned(ned_col, vocab_size) -> Column:
    """H = (1 - ned) ln V (nats)."""
    v = _col(vocab_size) if isinstance(vocab_size, (str, Column)) else F.lit(float(vocab_size))
    return (F.lit(1.0) - _col(ned_col)) * F.log(v.cast("double"))


def perplexity_from_ned(ned_col, vocab_size) -> Column:
    """perplexity = exp(H)."""
    return F.exp(entropy_from_ned(ned_col, vocab_size))


# --- Arrow path for very wide vectors ------------------------------------


BLOCK_VALUES = 1 << 22


def _blocks(rows, temps):
    """(positions, matrix of scores / temperature) for rows of equal width, a bounded number
    at a time; empty rows and rows without vector or temperature are left out."""
    width = np.fromiter((0 if r is None else len(r) for r in rows), np.int64, len(rows))
    temps = np.array([np.nan if t is None else t for t in temps], dtype=np.float64)
    width[np.isnan(temps)] = 0
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        step = max(1, BLOCK_VALUES // int(w))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, np.stack([np.asarray(rows[j], dtype=np.float64) for j in part]) / temps[part, None]


def _ned_numpy(rows, temps) -> np.ndarray:
    out = np.full(len(rows), np.nan)
    for at, z in _blocks(rows, temps):
        if z.shape[1] < 2:
            continue
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        s = e.sum(axis=1)
        out[at] = 1.0 + (np.einsum("ij,ij->i", e, z) / s - np.log(s)) / np.log(z.shape[1])
    return out


def _topk_numpy(rows, temps, ks) -> np.ndarray:
    out = np.full(len(rows), np.nan)
    ks = np.array([np.nan if k is None else k for k in ks], dtype=np.float64)
    for at, z in _blocks(rows, temps):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        s, w = e.sum(axis=1), z.shape[1]
        for k in np.unique(ks[at][~np.isnan(ks[at])]):  # as a rule one
            mine = np.flatnonzero(ks[at] == k)
            kk = int(min(k, w))
            head = np.partition(e[mine], w - kk, axis=1)[:, w - kk :] if 0 < kk < w else e[mine][:, : max(kk, 0)]
            out[at[mine]] = head.sum(axis=1) / s[mine]
    return out


@F.pandas_udf(T.DoubleType())
def ned_arrow(scores: pd.Series, temp: pd.Series) -> pd.Series:
    """C2 on Arrow batches (for widths of 32K to 256K): numpy over whole blocks of
    equal width. A NULL vector or temperature gives NULL."""
    return pd.Series(_ned_numpy(scores.to_numpy(), temp.to_numpy()))


@F.pandas_udf(T.DoubleType())
def topk_mass_arrow(scores: pd.Series, temp: pd.Series, k: pd.Series) -> pd.Series:
    """C5 on Arrow batches, with a partial selection over whole blocks instead of sorts. A
    NULL vector, temperature or k gives NULL."""
    return pd.Series(_topk_numpy(scores.to_numpy(), temp.to_numpy(), k.to_numpy()))
