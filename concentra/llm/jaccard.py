"""N-gram Jaccard join by a token-group matrix (op 8).

Sets of word shingles are linked when ``den * |x & y| >= num * |x | y|``.

1. Equal sets are one class (only the smallest id goes on): copies never meet
   each other.
2. With ``o = ceil(n * num / den)``, the least overlap of a set of n tokens with any set
   it is linked to, and ``l = min(SHARED, o)``, every set has a prefix of ``n - o + l``
   tokens in one global order (frequent tokens last, else by hash); linked sets
   share at least the smaller ``l`` of the two in their prefixes. Tokens of one set
   only are left out, and then sets with fewer than ``l`` tokens left.
3. Grouping: a token's pivot is, among the sets of about one size that hold it,
   the one whose prefix tokens are the most common (the text that near copies have
   in the middle). Every set is compared with the pivots that share enough of its
   prefix; the linked ones form groups of similar documents (connected
   components). That is linear in the number of tokens, also for groups of many
   near copies, and only prepares the exact step.
4. Token-group matrix: for each (token, group) one entry with the group's sizes.
   A set is a query for another group only where the matrix has ``l`` of its
   prefix tokens at a compatible size; of both prefixes only the part counts that
   the overlap asked of two sets of these sizes leaves. The smaller group asks
   the larger one.
   Each group is laid out in blocks of bounded size with the block's token
   union. The number of the query's tokens in the union bounds every overlap
   within; only blocks that reach the least overlap are opened, and their
   members are compared exactly. Sets of one group are not compared again, as
   more links inside it can't change a component. Texts are what is moved for a
   comparison; their sets are made where they meet.
5. Components over all links.

Defined cases: a null or empty text has no shingle and is alone; a text with
fewer words than a shingle has its whole word sequence as one; rows with the
same id count as one document; a row without id takes the smallest id of its
equal texts (null if there is none) and starts no links; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .folders import stored
from .frequent import most_frequent, release
from .registry import read_table, register
from .words import pieces, split_words, windows

#: how many frequent tokens the global order knows (8 MB); it only decides in
#: which order tokens are tried, not which links are found
MAX_FREQUENT = 1_000_000
#: prefix tokens that linked sets share at least (fewer for very small sets)
SHARED = 2
#: values up to which the driver lets a table with ids be broadcast (8 MB)
MAX_BROADCAST_IDS = 1_000_000
#: tokens in a block of a group (and in a block of queries)
BLOCK_TOKENS = 1 << 18


def shingle_sets(piece, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document (A-Z lower-cased)."""
    words = split_words(piece, lower=True)
    grams = windows(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(windows(words.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: int, num: int, den: int) -> int:
    """Least overlap of a set of n tokens with any set it is linked to."""
    return -(-n * num // den)


def linked(overlap, a, b, num: int, den: int):
    return (den + num) * overlap >= num * (a + b)


def frequent_tokens(docs: DataFrame, k: int, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that several documents of a piece share, with their summed
    counts: sorted tokens and ranks. Bounded by ``most``."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column("text")):
                sets = [s for s in shingle_sets(piece, k) if len(s)]
                if sets:
                    tokens, n = np.unique(np.concatenate(sets), return_counts=True)
                    yield pa.record_batch([pa.array(tokens[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

    counts = docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return most_frequent(counts, most)


def prefix(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    least = least_overlap(len(tokens), num, den)
    size = len(tokens) - least + min(SHARED, least)
    if not len(frequent):
        return tokens[:size]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    often = frequent[at] == tokens
    rare = tokens[~often]
    if len(rare) >= size:
        return rare[:size]
    rest = tokens[often]
    return np.concatenate([rare, rest[np.lexsort((rest, rank[at[often]]))]])[:size]


def describe(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, size, set_id, prefix) per row, size in bytes of text; set_id is null for an empty set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, k))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column("text")):
                sets = shingle_sets(piece, k)
                frequent, rank = shared.value
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(piece.lo, piece.hi - piece.lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.diff(piece.offsets).astype(np.int64)),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([prefix(s, frequent, rank, num, den).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "size", "set_id", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, size bigint, set_id binary, prefix array<bigint>")


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with an ``id``) with the text of that document. Only texts move: a set
    is a hash of 8 bytes for each shingle, which nothing compresses."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    if rows.count() * len(rows.columns) <= MAX_BROADCAST_IDS:  # then the texts need not move here
        return texts.join(F.broadcast(rows), "id")
    ids = rows.select("id").distinct()
    if ids.count() <= MAX_BROADCAST_IDS:  # then no others move
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    return texts.join(rows, "id")


def _sets(column, k: int) -> list[np.ndarray]:
    return [s for piece in pieces(column) for s in shingle_sets(piece, k)]


def _pair_links(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for piece in pieces(batch.column("text_u")):
                rows = zip(shingle_sets(piece, k), _sets(batch.column("text_v").slice(piece.lo, piece.hi - piece.lo), k), strict=True)
                for i, (x, y) in enumerate(rows, piece.lo):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if linked(both, len(x), len(y), num, den):
                        keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


class Block:
    """Members of a group with their token union, and exact overlaps on demand."""

    def __init__(self, ids, tokens: list[np.ndarray]):
        self.ids = np.asarray(ids, np.int64)
        self.n = np.array([len(t) for t in tokens])
        flat, member = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), self.n)
        order = np.argsort(flat, kind="stable")
        self.flat, self.member = flat[order], member[order]
        self.union = np.unique(self.flat)

    def links(self, query: np.ndarray, num: int, den: int) -> np.ndarray:
        """Ids of the members linked to ``query``; empty without opening the
        block when the union's bound is too low."""
        at = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        if (self.union[at] == query).sum() < least_overlap(len(query), num, den):
            return self.ids[:0]
        lo, hi = np.searchsorted(self.flat, query, "left"), np.searchsorted(self.flat, query, "right")
        size = hi - lo
        rows = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        overlap = np.bincount(self.member[rows], minlength=len(self.ids))
        return self.ids[linked(overlap, len(query), self.n, num, den)]


def _group_links(k: int, num: int, den: int):
    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        if members.num_rows and queries.num_rows:
            block = Block(members.column("id").to_numpy(), _sets(members.column("text_m"), k))
            for x, tokens in zip(queries.column("id").to_pylist(), _sets(queries.column("text_q"), k), strict=True):
                hits = block.links(tokens, num, den)
                if len(hits):  # one link ties the query to the whole group
                    found.append((x, int(hits.min())))
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    return run


def _open_groups(docs: DataFrame, asks: DataFrame, members: DataFrame, weights: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (u, v) between queries and members of the groups they ask.
    ``asks``, ``members``: (id, comp); ``weights``: (id, weight) in tokens."""
    parts = lambda t, name: t.join(weights, "id").groupBy("comp").agg(F.ceil(F.sum("weight") / BLOCK_TOKENS).cast("int").alias(name))
    plan = stored(parts(members, "blocks").join(parts(asks, "parts"), "comp"), "group-blocks")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(plan, "comp").withColumn("block", spread("blocks", 1)).withColumn("part", every("parts"))
    right = asks.join(plan, "comp").withColumn("part", spread("parts", 2)).withColumn("block", every("blocks"))
    keys = ["comp", "block", "part"]
    left = texts_of(docs, stored(left.select("id", *keys), "group-members")).withColumnRenamed("text", "text_m")
    right = texts_of(docs, stored(right.select("id", *keys), "group-askers")).withColumnRenamed("text", "text_q")
    release(docs.sparkSession)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_group_links(k, num, den), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sets = stored(describe(docs, k, num, den), "shingle-sets")
    classes = sets.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.max("size").alias("size"), F.first("prefix").alias("prefix")
    )
    classes = stored(classes, "set-classes")

    ratio = float(np.log(den / num))
    # size and place in one column: a token's row moves more than once
    at = F.shiftleft("n", 31).bitwiseOR(F.col("pos"))
    tokens = classes.where("id is not null").select("id", "n", F.posexplode("prefix").alias("pos", "token")).select("id", at.alias("at"), "token")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    overlap = lambda n: F.ceil(n * num / F.lit(den))  # noqa: E731  with anything linked to a set of n tokens
    least = lambda n: F.least(F.lit(SHARED), overlap(n))
    behind = lambda n: overlap(n) - least(n)  # noqa: E731  tokens behind the prefix
    joint = lambda n, m: F.ceil((n + m) * num / F.lit(num + den))  # noqa: E731  overlap of linked sets of n and m tokens
    shared = stored(tokens.join(common, "token"), "shared-tokens")
    release(docs.sparkSession)
    n = F.col("n")
    # one row for each set from here on: its shared tokens and their places in the prefix
    shared = shared.repartition("id").groupBy("id", F.shiftright("at", 31).alias("n")).agg(
        F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos"), "token")).alias("t"), F.sum("c").alias("s")
    )
    # near copies often share all of a prefix: a part of the hash of the id makes them choose one pivot
    tie = 1 + F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1e14
    shared = shared.where(F.size("t") >= least(n)).select(
        "id", "n", (F.col("s") / (n - behind(n)) * tie).alias("w"), F.col("t.pos").alias("places"), F.col("t.token").alias("tokens")
    )
    shared = stored(shared, "shared-sets")
    release(docs.sparkSession)
    size_class = F.floor(F.log("n") / ratio).cast("int")
    by_size = shared.select("id", "n", "w", size_class.alias("size_class"), F.explode("tokens").alias("token"))
    by_size = by_size.select("id", "n", "w", F.xxhash64("token", "size_class").alias("key"))
    pivots = by_size.groupBy("key").agg(F.max_by("id", "w").alias("v"))
    pairs = by_size.join(pivots, "key").where("id != v").groupBy(F.col("id").alias("u"), "v", "n").count()
    # a set's tokens may have different pivots, so half of what a link implies is asked for
    enough = F.greatest(least(n), (joint(n, n) - behind(n)) / 2)
    pairs = stored(pairs.where(F.col("count") >= enough).select("u", "v").distinct(), "pivot-pairs")
    left = texts_of(docs, pairs.select(F.col("u").alias("id"), "v")).select(F.col("id").alias("u"), "v", F.col("text").alias("text_u"))
    right = texts_of(docs, pairs.select(F.col("v").alias("id")).distinct()).select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    links = left.join(right, "v").select("u", "v", "text_u", "text_v").mapInArrow(_pair_links(k, num, den), "u bigint, v bigint")
    links = stored(links, "pivot-links")
    release(docs.sparkSession)

    # a set without a link is a group by itself, of its own id and size 1
    grouped = components(links).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    grouped = stored(grouped.join(grouped.groupBy("comp").agg(F.count(F.lit(1)).alias("size")), "comp"), "groups")
    rows = shared.join(grouped, "id", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"), "places", "tokens")
    rows = stored(rows, "set-groups").select("id", "n", "comp", "size", "places", F.posexplode("tokens").alias("i", "token"))
    rows = rows.select("token", "id", "n", F.get("places", "i").alias("pos"), "comp", "size")
    single = rows.where("size = 1").select("token", "comp", "size", F.col("n").alias("n_min"), F.col("n").alias("n_max"), F.col("pos").alias("pos_min"))
    matrix = rows.where("size > 1").groupBy("token", "comp", "size").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("pos").alias("pos_min"))
    matrix = matrix.unionByName(single).withColumnsRenamed({"comp": "other", "size": "other_size"})
    n_min, n_max = F.col("n_min"), F.least("n_max", F.floor(n * den / F.lit(num)))
    asks = (
        rows.join(matrix, "token")
        .where("comp != other and (size < other_size or size = other_size and comp > other)")
        .where(f"{den} * n >= {num} * n_min and {num} * n <= {den} * n_max")
        .where((F.col("pos") < n - joint(n, n_min) + least(n)) & (F.col("pos_min") < n_max - joint(n, n_min) + F.lit(SHARED)))
        .groupBy("id", "n", F.col("other").alias("comp"), (F.col("size") + F.col("other_size") == 2).alias("alone"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("n_min").alias("n_min"))
        .where(F.col("c") >= F.least(least(n), least(n_min))).select("id", "comp", "alone")
    )
    # two single sets that were a pivot pair are known not to be linked
    tested = pairs.select(F.greatest("u", "v").alias("id"), F.least("u", "v").alias("comp"), F.lit(True).alias("alone"))
    asks = stored(asks.join(tested, ["id", "comp", "alone"], "left_anti").select("id", "comp").distinct(), "group-queries")
    members = asks.select("comp").distinct().join(grouped.select("comp", "id"), "comp", "left").select(F.coalesce("id", "comp").alias("id"), "comp")
    # a text counts by its bytes where they outweigh its set
    weights = classes.groupBy("id").agg(F.sum(F.greatest("n", F.ceil(F.col("size") / 8))).alias("weight"))
    more = stored(_open_groups(docs, asks, stored(members, "group-sets"), weights, k, num, den), "group-links")

    found = components(links.unionByName(more)).select(F.col("node").alias("id"), "component")
    ids = classes.select("set_id", "id").join(found, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id"))
    return sets.select("doc_id", F.col("n").alias("n_shingles"), "set_id").join(ids, "set_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of ``docs`` of each group of near copies: the one with the smallest
    doc_id, null ids last, then by a hash of id and text.

    Rows without id and rows that share an id are judged by themselves, by their
    texts (known by a 64-bit hash of id and text). Of rows with one id and one
    text, one is kept: the one with the smallest hash of all columns. Rows
    without a word are copies of nothing and all stay."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    ids = stored(ids.where("__n > 1").select("doc_id", F.lit(True).alias("__own")), "repeated-ids")
    keyed = docs.join(ids, "doc_id", "left").withColumn("__own", F.col("doc_id").isNull() | F.coalesce("__own", F.lit(False)))
    row = F.when(F.col("__own"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("bigint"))
    keyed = keyed.withColumn("__row", row).select(*docs.columns, "__own", "__row")
    found = near_duplicates(keyed, k, num, den, key="__row").where("n_shingles > 0")
    found = stored(found.select(F.col("doc_id").alias("__row"), "component_id"), "near-copies")
    own = stored(keyed.where("__own").groupBy("__row").agg(F.first("doc_id").alias("__id"), F.count(F.lit(1)).alias("__n")), "rows-by-text")
    known = found.join(own.withColumn("__own", F.lit(True)), "__row", "left")
    name = F.when(F.col("__own"), F.col("__id")).otherwise(F.col("__row"))
    best = known.groupBy("component_id").agg(F.min(F.struct(name.isNull(), name, F.col("__row").alias("row"))).alias("b"))
    gone = found.select("__row").distinct().join(best.select(F.col("b.row").alias("__row")), "__row", "left_anti")
    kept = keyed.join(gone, "__row", "left_anti")
    twice = own.where("__n > 1").join(found, "__row", "left_semi").select("__row")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    cells = [F.col(f"`{c}`") for c in docs.columns]
    one = kept.join(twice, "__row", "left_semi").groupBy("__row").agg(F.min_by(F.struct(*cells), F.xxhash64(*cells)).alias("__r"))
    return kept.join(twice, "__row", "left_anti").select(*docs.columns).unionByName(one.select("__r.*"))


ORACLE_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
         ELSE list_distinct(list_transform(range(1, len(a) - 1), lambda i: array_to_string(a[i:i+2], ' '))) END AS g
  FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
links AS (
  SELECT x.doc_id AS u, y.doc_id AS v FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n a ON a.doc_id = x.doc_id JOIN n b ON b.doc_id = y.doc_id
  WHERE a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY x.doc_id, y.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, r.component_id
FROM n JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) r ON r.u = n.doc_id
"""


@register("op8_jaccard_join", ORACLE_OP8)
def op8_jaccard_join(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=3, num=9, den=10)
