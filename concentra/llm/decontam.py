"""Benchmark decontamination by greedy string tiling (op 1).

Tokens are runs of letters and digits (ASCII case folded), so punctuation and
markup between words do not hide a leak. A document and a benchmark item are a
candidate pair when they share a seed: the hash of ``match`` consecutive
tokens. Pairs whose seeds could not cover enough of the item are left at once.
The others are tiled: windows of a search length are hashed in a running way
(Karp-Rabin) in the parts of both texts that are not marked yet, equal windows
are checked and extended to maximal matches, the longest are marked first, an
overlapped match is shortened or dropped, and the search length falls until it
is ``match``. A pair whose tiles cover the share ``coverage`` of the item's tokens is
reported, in whatever order the passages stand.

The benchmark goes to the tasks in blocks of at most ``BLOCK_TOKENS`` tokens, a
proven bound of what is broadcast; a larger benchmark takes more passes.

Defined cases: null or empty texts share nothing; an item shorter than
``match`` tokens has to occur as a whole; items without tokens are never found;
repeated items and documents are reported each; a null id stays null; no
benchmark rows: nothing is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import read_table, register
from .words import NOT_ALNUM, mix, pieces, split_words, windows

MATCH = 5
COVERAGE = 0.8
BLOCK_TOKENS = 2_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FILTER_BITS = 22


class Items:
    """A block of benchmark items: tokens, and seeds by length."""

    def __init__(self, ids: list, texts: list, match: int):
        piece = next(pieces(pa.array(texts, pa.string()), 1 << 62), None)
        words = split_words(piece, NOT_ALNUM, lower=True) if piece else None
        first = words.first.tolist() if words else [0]
        self.ids = ids
        self.tokens = [words.hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        seeds: dict[int, list] = {}
        for i, tokens in enumerate(self.tokens):
            k = min(match, len(tokens))
            if k:
                grams = windows(tokens, k)
                seeds.setdefault(k, []).append((grams, np.full(len(grams), i), np.arange(len(grams))))
        #: k -> seed hashes (ascending), item and position of each, and a bit table
        self.seeds = {}
        for k, parts in seeds.items():
            grams, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(grams, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.seeds[k] = grams[order], item[order], at[order], bits


def running_hashes(tokens: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``s`` tokens."""
    n = len(tokens)
    if n < s:
        return np.zeros(0, np.uint64)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n - s + 1, _INVERSE, np.uint64)
    back[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(tokens) * power, out=sums[1:])
    return mix((sums[s:] - sums[: n - s + 1]) * np.multiply.accumulate(back))


def _free_windows(marked: np.ndarray, s: int) -> np.ndarray:
    """Starts of the windows of ``s`` tokens without a marked one."""
    n = len(marked)
    if n < s:
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(total[s:] == total[: n - s + 1])


def _matches(a, b, marked_a, marked_b, s: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches (length, start in a, start in b) of ``s`` tokens or more."""
    at_a, at_b = _free_windows(marked_a, s), _free_windows(marked_b, s)
    if not len(at_a) or not len(at_b):
        return []
    hash_a, hash_b = running_hashes(a, s)[at_a], running_hashes(b, s)[at_b]
    order = np.argsort(hash_a, kind="stable")
    hash_a, at_a = hash_a[order], at_a[order]
    lo, hi = np.searchsorted(hash_a, hash_b, "left"), np.searchsorted(hash_a, hash_b, "right")
    found = []
    seen: set[tuple[int, int]] = set()
    for j in np.flatnonzero(hi > lo).tolist():
        y = int(at_b[j])
        for x in at_a[lo[j] : hi[j]].tolist():
            if (x, y) in seen or not np.array_equal(a[x : x + s], b[y : y + s]):
                continue
            if x and y and a[x - 1] == b[y - 1] and not marked_a[x - 1] and not marked_b[y - 1] and (x - 1, y - 1) in seen:
                seen.add((x, y))  # within the match that starts one token earlier
                continue
            n = s
            while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and not marked_a[x + n] and not marked_b[y + n]:
                n += 1
            seen.update((x + i, y + i) for i in range(n - s + 1))
            found.append((n, x, y))
    return found


def tiles(a: np.ndarray, b: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (length, start in a, start
    in b) of non-overlapping matches, ``match`` tokens at least (all of ``a`` if it
    is shorter)."""
    match = min(match, len(a))
    if not match:
        return []
    marked_a, marked_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out, s = [], max(match, min(4 * match, len(a)))
    while True:
        found = sorted(_matches(a, b, marked_a, marked_b, s), key=lambda m: (-m[0], m[1], m[2]))
        if found and found[0][0] > 2 * s:
            s = found[0][0]
            continue
        again = False
        for n, x, y in found:
            taken = marked_a[x : x + n] | marked_b[y : y + n]
            if not taken.any():
                marked_a[x : x + n] = marked_b[y : y + n] = True
                out.append((n, x, y))
            else:  # what is left of it may still hold a match of this length
                free = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
                again |= any(e - st >= s for st, e in zip(free[::2].tolist(), free[1::2].tolist(), strict=True))
        if again:
            continue
        if s <= match:
            return out
        s = max(match, s // 2)


def leaks(items: Items, column, match: int, coverage: float) -> Iterator[tuple[int, int, int, float, list]]:
    """(row, item, tokens matched, coverage, tiles) of a text column."""
    for piece in pieces(column):
        words = split_words(piece, NOT_ALNUM, lower=True)
        pairs: dict[tuple[int, int], int] = {}
        for k, (seeds, item, at, bits) in items.seeds.items():
            grams = windows(words.hashes, k)
            near = np.flatnonzero(bits[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            doc = np.searchsorted(words.first, near, "right") - 1
            near, doc = (x[near + k <= words.first[doc + 1]] for x in (near, doc))
            lo, hi = np.searchsorted(seeds, grams[near], "left"), np.searchsorted(seeds, grams[near], "right")
            size = hi - lo
            rows = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            if not len(rows):
                continue
            # distinct (document, item, position) of the shared seeds
            hits = np.unique(np.stack([np.repeat(doc, size), item[rows], at[rows]]), axis=1)
            change = np.flatnonzero(np.any(hits[:2, 1:] != hits[:2, :-1], axis=0)) + 1
            for part in np.split(hits, change, axis=1):
                ends = np.minimum(np.diff(part[2], append=part[2, -1] + k), k)
                pairs[int(part[0, 0]), int(part[1, 0])] = int(ends.sum())  # tokens that the seeds cover
        for (d, i), most in sorted(pairs.items()):
            tokens = items.tokens[i]
            if most < coverage * len(tokens):
                continue
            found = tiles(tokens, words.hashes[words.first[d] : words.first[d + 1]], match)
            covered = sum(n for n, _, _ in found)
            if covered >= coverage * len(tokens):
                yield piece.lo + d, i, covered, covered / len(tokens), sorted(found, key=lambda t: t[2])


def _blocks(benchmark: DataFrame, match: int) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for row in benchmark.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "") // 2 + 1  # no more tokens than that
        if size >= BLOCK_TOKENS:
            yield Items(ids, texts, match)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, match)


SCHEMA = "doc_id bigint, item_id bigint, n_matched bigint, coverage double, n_tiles bigint, tiles array<struct<length:bigint,item_at:bigint,doc_at:bigint>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row per leaked pair: document, item, tokens of the item covered, their
    share, and the tiles (lengths and places in tokens)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    out = None
    for items in _blocks(benchmark.select(F.col("item_id").cast("bigint"), "text"), match):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_matched", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()),
                                ("tiles", pa.list_(pa.struct([("length", pa.int64()), ("item_at", pa.int64()), ("doc_at", pa.int64())])))])
            for batch in batches:
                ids, items = batch.column("doc_id"), shared.value
                found = [
                    {"doc_id": ids[d].as_py(), "item_id": items.ids[i], "n_matched": n, "coverage": c, "n_tiles": len(t), "tiles": [dict(zip(("length", "item_at", "doc_at"), x, strict=True)) for x in t]}
                    for d, i, n, c, t in leaks(items, batch.column("text"), match, coverage)
                ]
                yield pa.RecordBatch.from_pylist(found, schema)

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` in which no item is found; one pass for each block
    of the benchmark, no shuffle."""
    for items in _blocks(benchmark.select(F.col("item_id").cast("bigint"), "text"), match):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared, at=docs.columns.index("text")):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in leaks(shared.value, batch.column(at), match, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


@register("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
