"""Exact nearest neighbours by a block matrix join of int8 tiles (op 12).

Rows are dealt into blocks. A block holds its vectors three times: as int8 with one
scale per vector, as the norm of what the int8 form leaves out, and as they were. Blocks
of queries (stripes) meet chunks of base blocks in one shuffle on (length, stripe,
chunk); a task keeps one stripe and streams the chunk's blocks past it. A tile is the
product of int8 matrices, exact in float32, and by Cauchy-Schwarz the inner product
lies within |q| * rest(x) + rest(q) * (|x| + rest(x)) of the scaled tile. Only pairs whose
upper bound reaches the query's threshold are computed from the original vectors, in
double precision and in the order of the components, and go into the query's heap of
k. The heaps of all chunks are merged by query.

The threshold of a query is the k-th best of its heap or, while that is not full, the k-th
best lower bound of a tile. So that chunks don't start from nothing, a first pass
over one block in SEED_EVERY gives each query the k-th best score of these blocks,
which no result can be below; the second pass is over all blocks. Nothing depends on
which blocks those are but the time.

Copies: within a block only the k + 1 smallest ids of equal vectors are kept. No more
of them can be among the k nearest of any query, since they tie and one may be
the query itself. So a vector that a third of the rows share costs k + 1 pairs a block.

Defined cases: vectors null, empty, zero or holding a null or non-finite component take no
part, nor do rows without id; vectors of different lengths are not compared; every
query row is asked for itself, also when rows repeat an id, and finds no row of its own
id; an id that stands on several rows is found once for each score it has; ties
go to the smaller id; with fewer than k others all of them are returned; no queries or
no rows give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import stored
from .registry import read_table, register

K = 20
BLOCK = 4096  # base vectors in a block, at most (fewer of more than 256 components)
STRIPE = 16384  # queries that a task keeps, at most
CHUNK_BLOCKS = 16  # blocks that stream past a stripe in one task, at most
SEED_EVERY = 16  # one block in so many gives the first thresholds
_TILE = 512  # queries of a stripe that are multiplied at once
_EXACT = 1024  # 127 * 127 * 1024 < 2^24: float32 sums of int8 products are whole numbers

_PACK = "dim int, part int, ids binary, small binary, scale binary, norm binary, rest binary, whole binary"
_FOUND = "dim int, part int, row int, query_id long, vec_id long, score double"


# ------------------------------------------------------------------ packing


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 matrix, scale, norm of the vector and norm of what is left, per row."""
    x = x.astype(np.float64)
    largest = np.abs(x).max(axis=1)
    scale = largest / 127
    scale = np.where(scale > 0, scale, largest)  # below the least double
    small = np.rint(x / scale[:, None]).astype(np.int8)
    rest = np.sqrt(((x - small * scale[:, None]) ** 2).sum(axis=1))
    return small, scale, np.sqrt((x * x).sum(axis=1)), rest


def _by_length(table: pa.Table):
    """(ids, matrix) of the usable vectors of each length."""
    vectors = table.column("vector").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    ids = table.column("vec_id").to_numpy()
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    for d in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == d)
        x = flat[start[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield ids[rows[good]], np.ascontiguousarray(x[good])


def _few_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows that are left when of equal vectors only the ``most`` smallest distinct ids stay."""
    whole = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, cls = np.unique(whole, return_inverse=True)
    order = np.lexsort((ids, cls))
    cls, sorted_ids = cls[order], ids[order]
    again = np.zeros(len(ids), bool)
    again[1:] = (cls[1:] == cls[:-1]) & (sorted_ids[1:] == sorted_ids[:-1])
    order, cls = order[~again], cls[~again]
    first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    place = np.arange(len(cls)) - np.repeat(first, np.diff(np.append(first, len(cls))))
    return np.sort(order[place < most])


def _packer(most_copies: int | None):
    def pack(key, table):
        out = []
        for ids, x in _by_length(table):
            if most_copies is not None:
                stay = _few_copies(ids, x, most_copies)
                ids, x = ids[stay], x[stay]
            small, scale, norm, rest = quantise(x)
            out.append((x.shape[1], key[0].as_py(), *[a.tobytes() for a in (ids.astype(np.int64), small, scale, norm, rest, x)]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, [pa.int32()] * 2 + [pa.binary()] * 6)], names=["dim", "part", "ids", "small", "scale", "norm", "rest", "whole"])

    return pack


class Block:
    """One packed row: arrays over its vectors."""

    def __init__(self, row: dict, dtype):
        d = self.dim = row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.small = np.frombuffer(row["small"], np.int8).reshape(-1, d)
        self.scale, self.norm, self.rest = (np.frombuffer(row[c]) for c in ("scale", "norm", "rest"))
        self.whole = np.frombuffer(row["whole"], dtype).reshape(-1, d)


# ------------------------------------------------------------------ tiles and heaps


def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int8 matrices (rows by rows), exact, as doubles."""
    out = None
    for k in range(0, a.shape[1], _EXACT):
        part = (a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].astype(np.float32).T).astype(np.float64)
        out = part if out is None else out + part
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k].astype(np.float64) * b[:, k].astype(np.float64)
    return out


def offer(heap: list, item: tuple, k: int) -> None:
    """Keep the k largest different items."""
    if len(heap) < k:
        if item not in heap:
            heapq.heappush(heap, item)
    elif item > heap[0] and item not in heap:
        heapq.heapreplace(heap, item)


class Heaps:
    """The k best (score, -id) of each query of a stripe, from the blocks shown so far."""

    def __init__(self, stripe: Block, k: int, least: np.ndarray | None):
        self.stripe, self.k = stripe, k
        self.heaps = [[] for _ in stripe.ids]
        self.least = np.full(len(stripe.ids), -np.inf) if least is None else least.copy()

    def show(self, block: Block) -> None:
        q, k = self.stripe, self.k
        order = np.argsort(block.ids, kind="stable")
        sorted_ids = block.ids[order]
        lo, hi = np.searchsorted(sorted_ids, q.ids, "left"), np.searchsorted(sorted_ids, q.ids, "right")
        # the k-th of the lower bounds, further down by the rows that repeat an id of the block
        place = len(np.unique(block.ids)) - k
        slack = np.stack([block.rest + 1e-9 * block.norm, block.norm + block.rest])
        for a in range(0, len(q.ids), _TILE):
            b = min(a + _TILE, len(q.ids))
            # everything divided by the query's scale, which is positive
            with np.errstate(all="ignore"):
                about = tile(q.small[a:b], block.small)
                about *= block.scale
                bound = np.stack([q.norm[a:b] / q.scale[a:b], q.rest[a:b] / q.scale[a:b]], axis=1) @ slack
                own = np.flatnonzero(hi[a:b] > lo[a:b])
                for i in own:
                    about[i, order[lo[a + i] : hi[a + i]]] = -np.inf
                least = self.least[a:b] / q.scale[a:b]
                open_ = np.flatnonzero(self.least[a:b] == -np.inf)
                if len(open_) and place >= 0:
                    low = about[open_] - bound[open_]
                    low[~np.isfinite(low)] = -np.inf
                    least[open_] = np.partition(low, place, axis=1)[:, place]
                about += bound
                i, j = np.nonzero(~(about < least[:, None]) & (about != -np.inf))
            for s in range(0, len(i), 1 << 17):
                self._push(a + i[s : s + (1 << 17)], j[s : s + (1 << 17)], block)

    def _push(self, i: np.ndarray, j: np.ndarray, block: Block) -> None:
        score = exact(self.stripe.whole[i], block.whole[j])
        keep = np.flatnonzero(~(score < self.least[i]))
        for r, s, v in zip(i[keep].tolist(), score[keep].tolist(), block.ids[j[keep]].tolist()):
            heap = self.heaps[r]
            offer(heap, (s, -v), self.k)
            if len(heap) == self.k and heap[0][0] > self.least[r]:
                self.least[r] = heap[0][0]

    def found(self, part: int):
        sizes = np.array([len(h) for h in self.heaps], np.int64)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        flat = [x for h in self.heaps for x in h]
        n = len(flat)
        return pa.record_batch(
            [pa.array(np.full(n, self.stripe.dim, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(row), pa.array(self.stripe.ids[row]), pa.array([-v for _, v in flat], pa.int64()), pa.array([s for s, _ in flat], pa.float64())],
            names=["dim", "part", "row", "query_id", "vec_id", "score"],
        )


def _tiles(k: int, dtype):
    def run(batches):
        at, heaps, part = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                key = (row["dim"], row["part"], row["chunk"])
                if key != at:
                    if heaps is not None:
                        yield heaps.found(part)
                    at, heaps, part = key, None, row["part"]
                if row["block"] < 0:
                    heaps = Heaps(Block(row, dtype), k, None if row["least"] is None else np.frombuffer(row["least"]))
                elif heaps is not None:
                    heaps.show(Block(row, dtype))
        if heaps is not None:
            yield heaps.found(part)

    return run


def _merge(k: int):
    """Best k of each (dim, part, row) from rows sorted by these columns, as rank 1, 2, ..."""

    def out(done):
        cols = list(zip(*done)) if done else [[]] * 7
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["dim", "part", "row", "query_id", "rank", "vec_id", "score"])

    def run(batches):
        at, heap, done = None, [], []

        def close():
            ordered = sorted(heap, key=lambda x: (-x[0], -x[1]))
            done.extend((*at, n + 1, -v, s) for n, (s, v) in enumerate(ordered))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for dim, part, row, query, vec, score in zip(*columns):
                if (dim, part, row, query) != at:
                    if at is not None:
                        close()
                    at, heap = (dim, part, row, query), []
                offer(heap, (score, -vec), k)
            yield out(done)
            done = []
        if at is not None:
            close()
            yield out(done)

    return run


# ------------------------------------------------------------------ the join


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """A part number for each row, in turn, whatever its id and vector are."""
    return rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int"))


def _search(stripes: DataFrame, blocks: DataFrame, chunks: int, n_stripes: int, k: int, dtype) -> DataFrame:
    """(dim, part, row, query_id, rank, vec_id, score): each stripe against each chunk,
    then the heaps of all chunks merged."""
    columns = ["dim", "part", "chunk", "block", "ids", "small", "scale", "norm", "rest", "whole", "least"]
    left = stripes.withColumn("block", F.lit(-1)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = blocks.withColumn("block", F.col("part")).withColumn("chunk", F.col("part") % chunks).withColumn("least", F.lit(None).cast("binary"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_stripes - 1))))
    met = left.select(columns).unionByName(right.select(columns))
    tasks = min(2 * chunks * n_stripes, 20_000)
    met = met.repartition(tasks, "dim", "part", "chunk").sortWithinPartitions("dim", "part", "chunk", "block")
    found = met.mapInArrow(_tiles(k, dtype), _FOUND)
    found = found.repartition("dim", "part", "row").sortWithinPartitions("dim", "part", "row", "query_id")
    return found.mapInArrow(_merge(k), "dim int, part int, row int, query_id long, rank int, vec_id long, score double")


def _least(key, table):
    """The k-th best scores of a stripe's rows as one array; -inf where there are fewer."""
    row, score = table.column("row").to_numpy(), table.column("score").to_numpy()
    out = np.full(table.column("size")[0].as_py(), -np.inf)
    out[row] = score
    return pa.table({"dim": [key[0].as_py()], "part": [key[1].as_py()], "least": [out.tobytes()]}, schema=pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("least", pa.binary())]))


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` holds, the k rows
    with the largest inner product among all others. ``vectors`` has vec_id and
    vector (an array of numbers)."""
    single = isinstance(vectors.schema["vector"].dataType.elementType, T.FloatType)
    dtype = np.float32 if single else np.float64
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("vector").cast(f"array<{'float' if single else 'double'}>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).where("vec_id is not null and size(vector) > 0")
    n, asked, widest = rows.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("vector"))).first()
    in_block, in_stripe = (max(64, min(most, 256 * most // (widest or 1))) for most in (BLOCK, STRIPE))
    n_blocks, n_stripes = max(-(-n // in_block), 1), max(-(-asked // in_stripe), 1)
    # a chunk has CHUNK_BLOCKS blocks, or fewer where there are partitions for more chunks
    chunks = max(-(-n_blocks // CHUNK_BLOCKS), min(n_blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    blocks = _dealt(rows.drop("asked"), n_blocks).groupBy("part").applyInArrow(_packer(k + 1), _PACK)
    blocks = stored(blocks, "vector-blocks")
    stripes = _dealt(rows.where("asked").drop("asked"), n_stripes).groupBy("part").applyInArrow(_packer(None), _PACK)
    stripes = stored(stripes, "query-stripes")

    seeds = _search(stripes.withColumn("least", F.lit(None).cast("binary")), blocks.where(F.col("part") % SEED_EVERY == 0), chunks, n_stripes, k, dtype)
    kth = seeds.where(F.col("rank") == k).join(stripes.select("dim", "part", (F.octet_length("ids") / 8).cast("int").alias("size")), ["dim", "part"])
    least = kth.groupBy("dim", "part").applyInArrow(_least, "dim int, part int, least binary")
    stripes = stored(stripes.join(least, ["dim", "part"], "left"), "query-thresholds")
    return _search(stripes, blocks, chunks, n_stripes, k, dtype).select("query_id", "rank", "vec_id", "score")


_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@register("op12_nearest_neighbours", _SQL)
def op12_nearest_neighbours(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, F.col("vec_id") % 20 == 0)
