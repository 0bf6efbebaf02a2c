"""Substring de-duplication with sharded FM-indexes (op 2).

A word is removed when a window of ``WINDOW`` words that covers it also starts in a
document with a smaller id. All windows are judged on the input.

1. Every window has an anchor: the word n-gram within it that hashes lowest. Equal
   windows have equal anchors. Anchors of one text only are left out: (anchor,
   text) rows are sorted by anchor, and a group is read as a stream. The most
   frequent anchors are taken as shared without that (a bounded list).
2. Of equal texts (a 128-bit hash) only the first goes on: the others lose every
   word, or keep all if they are shorter than a window. The first ones with shared
   anchors are cut into segments: runs of windows with the same anchor. Of equal
   segments within a piece only the one with the smallest id goes on. Segments go
   to shards by anchor; the windows of the most frequent anchors go one by one,
   by their own hash, so no anchor loads a shard.
3. A shard is sorted by key and read in parts of bounded size that never split a
   key. A part gets an FM-index (suffix order, Burrows-Wheeler transform, wavelet
   matrix). Its segments are streamed against the index: backward search gives the
   matching statistics at every word, and where they reach the window the interval
   in the suffix order leads to the smallest id among all documents in it.
4. The removed windows return to their documents, and the kept words are hashed.

Defined cases: a null or empty text has no words and nothing removed; a text
shorter than the window keeps all; a null id counts as smaller than all others;
rows with the same id never remove each other's words; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .folders import stored
from .frequent import most_frequent, release
from .registry import read_table, register
from .words import Piece, Words, inside_windows, mix, pieces, split_words, windows

WINDOW = 13
ANCHOR = 5
#: anchors known to be frequent (8 MB), and from which count on their windows are
#: dealt out one by one
MAX_FREQUENT = 1_000_000
SPLIT = 2_000
#: words in a part of a shard that is indexed at once
PART_WORDS = 1 << 19
MAX_BROADCAST_IDS = 1_000_000
#: bytes of text looked at once; equal segments are found within them
PIECE_BYTES = 4 << 20
LEAST_ID = -(1 << 63)

_ASK, _PENDING, _GONE = 1, 2, 3


class Anchors:
    """Anchor of every window of a piece."""

    def __init__(self, words: Words, window: int, anchor: int):
        self.inside = inside_windows(words.first, window)
        hashes = mix(windows(words.hashes, anchor))
        m = len(self.inside)
        if m:
            span = window - anchor + 1
            self.at = np.lib.stride_tricks.sliding_window_view(hashes, span)[:m].argmin(axis=1) + np.arange(m)
            self.hash = hashes[self.at]
        else:
            self.at, self.hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def runs(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each run with the same anchor in
        the same document."""
        w = np.flatnonzero(self.inside)
        if not len(w):
            return w, w
        new = np.ones(len(w), bool)
        new[1:] = (self.at[w[1:]] != self.at[w[:-1]]) | (doc[w[1:]] != doc[w[:-1]]) | (w[1:] != w[:-1] + 1)
        first = np.flatnonzero(new)
        return w[first], np.diff(np.append(first, len(w)))


def _anchor_rows(batches, window: int, anchor: int):
    """(hash, document index in the piece, piece) of the distinct anchors."""
    for batch in batches:
        for piece in pieces(batch.column("text"), PIECE_BYTES):
            words = split_words(piece)
            doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
            found = Anchors(words, window, anchor)
            start, _ = found.runs(doc)
            pairs = np.unique(np.stack([found.hash[start], doc[start].astype(np.uint64)]), axis=1) if len(start) else np.zeros((2, 0), np.uint64)
            yield batch, piece, pairs[0], pairs[1].astype(np.int64)


def frequent_anchors(docs: DataFrame, window: int, anchor: int, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for _, _, hashes, _ in _anchor_rows(batches, window, anchor):
            token, n = np.unique(hashes, return_counts=True)
            yield pa.record_batch([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

    return most_frequent(docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")), most)


def _contains(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def describe(rows: DataFrame) -> DataFrame:
    """(id, class, text_id, n_words, sha) of every row: a 128-bit hash of the text,
    and the hash of its words as they are."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column("text"), PIECE_BYTES):
                words, n = split_words(piece), piece.hi - piece.lo
                raw, bounds = piece.data.tobytes(), piece.offsets.tolist()
                ids = [hashlib.blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                part = batch.slice(piece.lo, n)
                sha = kept_hashes(piece, words, np.zeros(len(words.hashes), bool), np.arange(n))
                yield pa.record_batch([part.column("id"), part.column("class"), pa.array(ids, pa.binary()), pa.array(np.diff(words.first)), pa.array(sha)], ["id", "class", "text_id", "n_words", "sha"])

    return rows.mapInArrow(run, "id bigint, class bigint, text_id binary, n_words bigint, sha string")


def shared_anchors(docs: DataFrame, frequent, window: int, anchor: int) -> DataFrame:
    """(class, anchors) of the texts with anchors that another text has too; the
    frequent anchors are not listed, but texts that have one are."""

    def emit(batches):
        for batch, piece, hashes, doc in _anchor_rows(batches, window, anchor):
            often = _contains(frequent.value[0], hashes)
            classes = batch.column("class").slice(piece.lo, piece.hi - piece.lo).to_numpy()
            # one row for a text with frequent anchors, spread by the text
            marked = classes[np.unique(doc[often])]
            key = np.concatenate([hashes[~often], mix(marked.view(np.uint64))]).view(np.int64)
            sure = np.repeat([False, True], [int((~often).sum()), len(marked)])
            yield pa.record_batch([pa.array(key), pa.array(np.concatenate([classes[doc[~often]], marked])), pa.array(sure)], ["anchor", "class", "sure"])

    def several(batches):
        """From rows sorted by (anchor, class): one row per pair, of anchors with
        two classes or more. The last anchor of a batch waits for the next one."""
        open_anchor, waiting, known = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            sure = batch.filter(batch.column("sure"))
            yield pa.record_batch([sure.column("class"), sure.column("anchor")], ["class", "anchor"])
            batch = batch.filter(pc.invert(batch.column("sure")))
            if not batch.num_rows:
                continue
            a, c = batch.column("anchor").to_numpy(), batch.column("class").to_numpy()
            if waiting is not None:
                a, c = np.append(open_anchor, a), np.append(waiting, c)
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            pair = new.copy()
            pair[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new) - 1
            n = np.bincount(group, pair)
            many = n > 1
            many[0] |= known  # rows of this anchor have gone out before
            out = pair & many[group]
            if waiting is not None and known:
                out[0] = False  # it has gone out already
            if not many[-1]:
                out &= group < group[-1]
            yield pa.record_batch([pa.array(c[out]), pa.array(a[out])], ["class", "anchor"])
            open_anchor, waiting, known = a[-1], c[-1], bool(many[-1])

    rows = docs.select("text", "class").mapInArrow(emit, "anchor bigint, class bigint, sure boolean")
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", "class")
    pairs = ordered.mapInArrow(several, "class bigint, anchor bigint")
    return pairs.groupBy("class").agg(F.collect_list("anchor").alias("anchors"))


_SEGMENTS = "kind int, key bigint, id bigint, class bigint, at int, n int, words binary"


def _rows(kind: int, **columns) -> pa.RecordBatch:
    types = {"key": pa.int64(), "id": pa.int64(), "class": pa.int64(), "at": pa.int32(), "n": pa.int32(), "words": pa.binary()}
    size = len(columns["id"])
    arrays = [pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in types.items()]
    return pa.record_batch([pa.array([kind] * size, pa.int32()), *arrays], ["kind", *types])


def kept_hashes(piece: Piece, words: Words, removed: np.ndarray, which: np.ndarray) -> list[str]:
    """SHA-256 of the kept words, joined by one blank, of the documents ``which``."""
    out = []
    data = piece.data.copy()
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    data[np.cumsum(inside[:-1]) == 0] = 0x20
    for d in which.tolist():
        a, b = int(words.first[d]), int(words.first[d + 1])
        kept = np.flatnonzero(~removed[a:b]) + a
        if not len(kept):
            out.append(hashlib.sha256(b"").hexdigest())
            continue
        # bytes of the kept words, each with the one after it
        lo, hi = int(words.starts[a]), int(words.ends[b - 1])
        keep = np.zeros(hi - lo + 2, np.int8)
        np.add.at(keep, words.starts[kept] - lo, 1)
        np.add.at(keep, words.ends[kept] - lo + 1, -1)
        body = data[lo:hi][np.cumsum(keep[: hi - lo]) > 0].tobytes()
        out.append(hashlib.sha256(body if kept[-1] == b - 1 else body[:-1]).hexdigest())
    return out


def _cut(window: int, anchor: int, frequent):
    """Segments, settled windows and marks of pending documents, from rows (id,
    text, class, anchors) of distinct texts."""

    def run(batches):
        hot, hot_n = frequent.value
        for batch in batches:
            ids = batch.column("id").to_numpy()
            classes = batch.column("class").to_numpy()
            anchors = batch.column("anchors")
            text = batch.column("text")
            for piece in pieces(text, PIECE_BYTES):
                words = split_words(piece)
                n = piece.hi - piece.lo
                here, cls = ids[piece.lo : piece.hi], classes[piece.lo : piece.hi]
                count = np.diff(words.first)
                found = Anchors(words, window, anchor)
                doc = np.repeat(np.arange(n), count)
                start, size = found.runs(doc)
                of = doc[start] if len(start) else start
                hashes = found.hash[start]
                often = _contains(hot, hashes)
                ok = often.copy()
                bounds = np.searchsorted(of, np.arange(n + 1))
                for d in range(n):
                    a, b = bounds[d], bounds[d + 1]
                    if b > a:
                        ok[a:b] |= np.isin(hashes[a:b].view(np.int64), anchors[piece.lo + d].values.to_numpy())
                start, size, of, hashes, often = start[ok], size[ok], of[ok], hashes[ok], often[ok]
                # windows of the most frequent anchors one by one
                if often.any():
                    heavy = np.zeros(len(start), bool)
                    heavy[often] = hot_n[np.searchsorted(hot, hashes[often])] >= SPLIT
                    one = np.repeat(start[heavy] - np.cumsum(size[heavy]) + size[heavy], size[heavy]) + np.arange(size[heavy].sum())
                    single = windows(words.hashes, window)[one] if len(one) else np.zeros(0, np.uint64)
                    start = np.concatenate([start[~heavy], one])
                    of = np.concatenate([of[~heavy], np.repeat(of[heavy], size[heavy])])
                    hashes = np.concatenate([hashes[~heavy], single])
                    size = np.concatenate([size[~heavy], np.ones(len(one), np.int64)])
                pending = np.zeros(n, bool)
                pending[of] = True
                # of equal segments of the piece the one with the smallest id asks, the others are settled
                content = _segment_hash(words.hashes, start, size + window - 1)
                order = np.lexsort((here[of], content))
                lead = np.ones(len(order), bool)
                lead[1:] = content[order][1:] != content[order][:-1]
                first = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]] if len(order) else order
                settled = np.zeros(len(start), bool)
                settled[order] = ~lead & (here[of[order]] > here[of[first]])
                at = start - words.first[of]
                if settled.any():
                    s = np.flatnonzero(settled)
                    yield _rows(_GONE, key=mix(here[of[s]].view(np.uint64)).view(np.int64), id=here[of[s]], **{"class": cls[of[s]]}, at=at[s], n=(1 << size[s]) - 1)
                asks = np.flatnonzero(~settled)
                if len(asks):
                    raw, length = words.hashes, size[asks] + window - 1
                    blobs = [raw[a : a + m].tobytes() for a, m in zip(start[asks].tolist(), length.tolist(), strict=True)]
                    yield _rows(_ASK, key=hashes[asks].view(np.int64), id=here[of[asks]], **{"class": cls[of[asks]]}, at=at[asks], n=size[asks], words=blobs)
                if pending.any():
                    p = np.flatnonzero(pending)
                    yield _rows(_PENDING, key=mix(here[p].view(np.uint64)).view(np.int64), id=here[p], **{"class": cls[p]})

    return run


def _segment_hash(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = mix(length.astype(np.uint64))
    for j in range(int(length.max(initial=0))):
        more = length > j
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15 | 1) + hashes[start[more] + j])
    return out


def judge(words: np.ndarray, first: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """For each segment a bit per window: it occurs in a document with a smaller id
    among the segments of this part."""
    # equal segments once in the index, with their smallest owner
    content = _segment_hash(words, first[:-1], np.diff(first))
    _, one, same = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, same, owner)
    size = np.diff(first)[one]
    first_one = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(first[one] - first_one[:-1], size) + np.arange(first_one[-1])
    text = words[take]
    index = FMIndex(text, first_one, least)
    length, place = index.matching_statistics(text, first_one, window)
    block, _ = index.depth(window)
    found = length == window
    lowest = np.full(len(text), np.iinfo(np.int64).max)
    lowest[found] = index.least_owner(window)[block[place[found]]]
    mask = np.zeros(len(owner), np.int64)
    for j in range(int(size.max(initial=0)) - window + 1):
        has = size[same] - window >= j
        mask[has] |= (lowest[first_one[same[has]] + j] < owner[has]).astype(np.int64) << j
    return mask


def _search(window: int):
    def run(batches):
        held: list[tuple] = []
        held_words, last_key = 0, None

        def flush():
            keys, ids, cls, at, blobs = (np.concatenate(x) if i < 4 else [b for part in x for b in part] for i, x in enumerate(zip(*held, strict=True)))
            size = np.array([len(b) // 8 for b in blobs])
            mask = judge(np.frombuffer(b"".join(blobs), np.uint64), np.concatenate([[0], np.cumsum(size)]), ids, window)
            hit = mask > 0
            return _rows(_GONE, id=ids[hit], **{"class": cls[hit]}, at=at[hit], n=mask[hit])

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            yield batch.filter(pa.array(kind != _ASK))
            asks = batch.filter(pa.array(kind == _ASK))
            if not asks.num_rows:
                continue
            keys = asks.column("key").to_numpy()
            change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            size = np.array(asks.column("words").to_pylist(), object)
            length = np.cumsum([len(b) // 8 for b in size])
            columns = [asks.column(c).to_numpy() for c in ("key", "id", "class", "at")]
            lo = 0
            cuts = change.tolist()
            if last_key is not None and keys[0] != last_key:
                cuts = [0, *cuts]
            for cut in cuts:  # a part ends only between two keys
                if held_words + (length[cut - 1] - (length[lo - 1] if lo else 0) if cut else 0) >= PART_WORDS:
                    if cut > lo:
                        held.append((*[c[lo:cut] for c in columns], size[lo:cut].tolist()))
                    if held:
                        yield flush()
                    held, held_words, lo = [], 0, cut
            held.append((*[c[lo:] for c in columns], size[lo:].tolist()))
            held_words += int(length[-1] - (length[lo - 1] if lo else 0))
            last_key = keys[-1]
        if held:
            yield flush()

    return run


def _finish(window: int):
    """Result rows of documents with their removed windows."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column("text"), PIECE_BYTES):
                words = split_words(piece)
                n = piece.hi - piece.lo
                cover = np.zeros(len(words.hashes) + 1, np.int64)
                marks = batch.column("gone").slice(piece.lo, n)
                size = np.array([len(m) if m.is_valid else 0 for m in marks])
                flat = marks.flatten()
                base = np.repeat(words.first[:-1], size)
                at, mask = flat.field("at").to_numpy(zero_copy_only=False) + base, flat.field("n").to_numpy(zero_copy_only=False)
                for j in range(int(mask.max(initial=0)).bit_length()):
                    some = at[mask >> j & 1 == 1] + j
                    np.add.at(cover, some, 1)
                    np.add.at(cover, some + window, -1)
                removed = np.cumsum(cover[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(removed)])[words.first]
                yield pa.record_batch(
                    [batch.column("id").slice(piece.lo, n), pa.array(np.diff(words.first)), pa.array(np.diff(total)), pa.array(kept_hashes(piece, words, removed, np.arange(n)))],
                    ["id", "n_words", "n_removed", "sha"],
                )

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LEAST_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("class", F.xxhash64("text"))
    texts = stored(describe(rows), "texts")
    firsts = texts.groupBy("text_id").agg(F.min("id").alias("first"), F.first("class").alias("class"))
    frequent = spark.sparkContext.broadcast(frequent_anchors(rows, window, anchor))
    shared = shared_anchors(rows, frequent, window, anchor)
    # the first document of each text with shared anchors speaks for its copies
    speak = stored(firsts.join(shared, "class").select(F.col("first").alias("id"), "class", "anchors"), "shared-anchors")
    release(spark)
    segments = rows.join(speak, ["id", "class"]).select("id", "text", "class", "anchors").mapInArrow(_cut(window, anchor, frequent), _SEGMENTS)
    found = segments.repartition("key").sortWithinPartitions("key").mapInArrow(_search(window), _SEGMENTS)
    found = stored(found.drop("key", "words"), "repeats")
    release(spark)
    gone = found.groupBy("id", "class").agg(F.collect_list(F.when(F.col("kind") == _GONE, F.struct("at", "n"))).alias("gone"))
    pending = found.where(F.col("kind") == _PENDING).select("id", "class").distinct()
    ids = pending.select("id").distinct()
    few = ids.count() <= MAX_BROADCAST_IDS  # then only the texts that are needed move
    some = rows.join(F.broadcast(ids), "id", "left_semi") if few else rows
    rest = some.join(gone, ["id", "class"]).select("id", "text", "gone")
    rest = rest.mapInArrow(_finish(window), "id bigint, n_words bigint, n_removed bigint, sha string")
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)  # of a smaller document: every word is covered
    done = texts.join(pending, ["id", "class"], "left_anti").join(firsts.select("text_id", "first"), "text_id")
    done = done.select("id", "n_words", F.when(copy, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("sha"))
    return done.unionByName(rest).select(F.when(F.col("id") != LEAST_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


ORACLE_OP2 = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(a[i:i+12], ' ') AS s
  FROM (SELECT doc_id, a, unnest(range(1, len(a) - 11)) AS i FROM w WHERE len(a) >= 13)),
low AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
gone AS (SELECT DISTINCT g.doc_id, g.i + k AS p FROM g JOIN low USING (s), range(0, 13) r(k) WHERE low.m < g.doc_id),
words AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS p, unnest(a) AS x FROM w),
kept AS (
  SELECT words.doc_id, string_agg(words.x, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(w.a) AS BIGINT) AS n_words, CAST(len(w.a) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@register("op2_substring_dedup", ORACLE_OP2)
def op2_substring_dedup(spark, sf_dir):
    return without_repeats(read_table(spark, sf_dir, "documents"))
