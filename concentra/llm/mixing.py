"""Mixing sources to target weights by temperature (op 3).

The share p of every source in the corpus (in tokens) is raised to an exponent
a and normalised: w = p^a / sum p^a; a = 1 keeps the corpus, a = 0 is uniform. The
exponent is found by bisection so that the mixture meets a target entropy, or so
that no source is repeated more than ``repeats`` times when the largest one is
taken once. The budget of a source is its weight times the token budget; the
default budget takes the source with the least repetition exactly once, so no
document is lost.

A budget is realised by passes (epochs) over the source. In every pass the
documents have a fixed pseudo-random place: a block (of about ``BLOCK_TOKENS``
tokens) by hash, a place within the block by another hash. Whole passes take
all documents. The last pass takes blocks in order until the budget is reached,
and of the block in which it is reached the documents up to it (the document
that crosses it is the last one taken). Sums run over blocks, and rows are ordered
only within a block, so a source with a third of all rows is spread like any other.

Defined cases: a null source is a source of its own; a null or empty text has
no token and is taken in whole passes only; repeated rows are taken each; one
source, or equal sources, keep weight and one pass; an empty table gives an
empty result; other columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folders import stored
from .registry import read_table, register

BLOCK_TOKENS = 1 << 20
REPEATS = 2.0
SEED = 17


def weights(shares: list[float], exponent: float) -> list[float]:
    raised = [p**exponent if p > 0 else 0.0 for p in shares]
    total = math.fsum(raised)
    return [r / total for r in raised]


def entropy(w: list[float]) -> float:
    return -math.fsum(x * math.log(x) for x in w if x > 0)


def most_repeats(shares: list[float], exponent: float) -> float:
    """Passes over the most repeated source when the least repeated one is
    taken once."""
    ratio = [w / p for w, p in zip(weights(shares, exponent), shares, strict=True) if p > 0]
    return max(ratio) / min(ratio)


def bisect_exponent(shares: list[float], target_entropy: float | None = None, repeats: float | None = None) -> float:
    """Exponent in [0, 1] whose mixture meets the target: the entropy falls and
    the repetition falls as the exponent rises. A target beyond what 0 or 1
    reaches gives that end."""
    if sum(p > 0 for p in shares) < 2:
        return 1.0
    if (target_entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    if repeats is not None:
        excess = lambda a: most_repeats(shares, a) - repeats
    else:
        excess = lambda a: entropy(weights(shares, a)) - target_entropy
    lo, hi = 0.0, 1.0
    if excess(lo) <= 0:
        return lo
    if excess(hi) >= 0:
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) > 0 else (lo, mid)
    return hi


def _place(salt: str, epoch, key):
    return F.xxhash64(F.lit(f"{salt}{SEED}"), epoch, key)


def mix(docs: DataFrame, repeats: float | None = REPEATS, target_entropy: float | None = None, budget: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mixture takes them, one row per time taken, with ``mix_epoch``
    (0: first pass), ``mix_block``, ``mix_place`` (orders the documents of a block
    in that pass) and ``mix_weight`` (of the source) appended."""
    added = ["mix_epoch", "mix_block", "mix_place", "mix_weight"]
    docs = docs.select(*[c for c in docs.columns if c not in added])
    n_tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    identity = F.xxhash64(F.col(key), F.col(text))
    # the texts are read for their token counts once; what follows is narrow
    counts = stored(docs.select(name.alias("_s"), identity.alias("_i"), n_tokens.alias("_n")), "mix-counts")
    sizes = counts.groupBy("_s").agg(F.sum("_n").alias("t")).orderBy("_s")
    sizes = [(r["_s"], int(r.t)) for r in sizes.collect()]  # one row per source
    total = sum(t for _, t in sizes)
    taken: dict[str, tuple[float, float, int]] = {}
    if total:
        shares = [t / total for _, t in sizes]
        w = weights(shares, bisect_exponent(shares, target_entropy, None if target_entropy is not None else repeats))
        if budget is None:
            budget = math.ceil(max(t / x for (_, t), x in zip(sizes, w, strict=True) if t))
        for (s, t), x in zip(sizes, w, strict=True):
            passes = x * budget / t if t else 1.0
            if abs(passes - round(passes)) * max(t, 1) < 1:  # no part of a token
                passes = float(round(passes))
            taken[s] = (x, passes, max(1, -(-t // BLOCK_TOKENS)))
    else:
        taken = {s: (0.0, 1.0, 1) for s, _ in sizes}
    rows = [(s, w, math.floor(p), round((p - math.floor(p)) * dict(sizes)[s]), b) for s, (w, p, b) in taken.items()]
    plan = docs.sparkSession.createDataFrame(rows, "_s string, w double, whole int, rest bigint, blocks int")
    plan = F.broadcast(plan) if len(rows) <= 100_000 else plan
    slim = docs.withColumn("_s", name).withColumn("_i", identity).join(plan, "_s")
    # the pass that is not whole: how many blocks, and where the budget ends
    last = counts.join(plan, "_s").where("rest > 0").withColumn("_b", F.pmod(_place("block", F.col("whole"), F.col("_i")), F.col("blocks")).cast("int"))
    blocks = last.groupBy("_s", "_b", "rest").agg(F.sum("_n").alias("t"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("left", F.col("rest") - F.coalesce(F.sum("t").over(before), F.lit(0))).where("left > 0")
    blocks = stored(blocks.select("_s", "_b", "left", (F.col("t") > F.col("left")).alias("cut")), "mix-blocks")
    place = _place("place", F.col("whole"), F.col("_i"))
    inside = Window.partitionBy("_s", "_b").orderBy(place, "_i").rowsBetween(Window.unboundedPreceding, -1)
    ends = last.join(blocks.where("cut"), ["_s", "_b"]).withColumn("gone", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ends = ends.where("gone < left").groupBy("_s", "_b").agg(F.max(F.struct(place.alias("p"), F.col("_i").alias("i"))).alias("end"))
    ends = blocks.join(ends, ["_s", "_b"], "left").select("_s", "_b", "cut", F.col("end.p").alias("_p"), F.col("end.i").alias("_e"))
    ends = stored(ends, "mix-ends")
    part = slim.where("rest > 0").withColumn("_b", F.pmod(_place("block", F.col("whole"), F.col("_i")), F.col("blocks")).cast("int"))
    part = part.join(ends, ["_s", "_b"]).withColumn("_q", place)
    part = part.where("not cut or _q < _p or (_q = _p and _i <= _e)").withColumn("mix_epoch", F.col("whole")).withColumn("mix_block", F.col("_b")).withColumn("mix_place", F.col("_q"))
    whole = slim.where("whole > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    whole = whole.withColumn("mix_block", F.pmod(_place("block", F.col("mix_epoch"), F.col("_i")), F.col("blocks")).cast("int"))
    whole = whole.withColumn("mix_place", _place("place", F.col("mix_epoch"), F.col("_i")))
    columns = [*docs.columns, "mix_epoch", "mix_block", "mix_place", F.col("w").alias("mix_weight")]
    return whole.select(*columns).unionByName(part.select(*columns))


@register("op3_source_mixing")
def op3_source_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "mix_epoch", "mix_block", "mix_place", "mix_weight")
