"""Document fingerprints by one-permutation MinHash (op 7), in DataFrame functions.

Every shingle of five words is hashed once to 64 bits. The top bits name one of
``BINS`` bins, and a bin keeps its smallest hash. An empty bin borrows from a
filled one that an independent hash of (empty bin, filled bin) picks, the same for
all documents (optimal densification). The low ``BITS`` bits of each bin are stored,
packed as hex. The share m of equal bins of two fingerprints estimates the Jaccard
similarity after the correction for chance matches: (m - 2^-b) / (1 - 2^-b).

The document that follows by ascending id comes from a window within ranges of
ids. The first document of a range also visits the range before it, so no
window spans the table and the texts move once.

Defined cases: a text of fewer words than a shingle has its whole word sequence
as one; a null or empty text has the empty fingerprint, which is like itself (1)
and unlike others (0); a null id is before all others, equal ids are ordered by a
hash of their texts; a single document is followed by itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import read_table, register

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
ROWS_PER_RANGE = 500
MAX_RANGES = 1 << 16


def with_fingerprint(df: DataFrame, text: str, name: str, k: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as an array of ``BINS`` small numbers
    (empty without words). Each step is a column of its own: what a lambda uses is
    computed once per row."""
    w, h, s, f, b = (f"_{name}_{x}" for x in "whsfb")
    out = df.withColumn(w, F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+", -1), lambda x: x != ""))
    out = out.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    words = [lambda i, j=j: F.get(F.col(h), i + j) for j in range(k)]
    shingles = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[x(i) for x in words]))
    out = out.withColumn(s, F.when(F.size(h) >= k, F.sort_array(shingles)).when(F.size(h) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>")))
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS).cast("int")
    # hashes ascend, so a bin's smallest one is the first of its bin
    out = out.withColumn(f, F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(s), i - 1)))))
    out = out.withColumn(b, F.transform(f, bin_of))
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    half = BINS // 2

    def value(i: Column) -> Column:
        at = F.array_position(F.col(b), i).cast("int")
        # the filled bin with the smallest hash of (empty, filled); its place is in the low bits
        pick = F.array_min(F.transform(F.col(b), lambda x, p: F.xxhash64(i, x).bitwiseAND(F.lit(-BINS)).bitwiseOR(p.cast("bigint"))))
        return low(F.get(F.col(f), F.when(at > 0, at - 1).otherwise(pick.bitwiseAND(F.lit(BINS - 1)).cast("int"))))

    bins = F.sequence(F.lit(-half), F.lit(half - 1))
    out = out.withColumn(name, F.when(F.size(f) > 0, F.transform(bins, value)).otherwise(F.array().cast("array<int>")))
    return out.drop(w, h, s, f, b)


def packed(fingerprint: str) -> Column:
    """The fingerprint as hex, ``BITS`` / 4 digits a bin."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Bias-corrected estimate of the Jaccard similarity, 0 to 1."""
    chance = 2.0**-BITS
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    one = F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
    return one.otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (equal - chance) / (1 - chance))))


def _range_of(key: Column, firsts: list[int]) -> Column:
    """Number of the range: how many of the other ranges' first ids are at or
    below the key; found among every ``step``-th one, then among those between."""
    step = max(1, int(len(firsts) ** 0.5))
    coarse = firsts[::step]
    fine = F.array(*[F.array(*[F.lit(x) for x in firsts[i : i + step]]) for i in range(0, len(firsts), step)])
    block = F.greatest(F.size(F.filter(F.array(*[F.lit(x) for x in coarse]), lambda x: x <= key)) - 1, F.lit(0))
    return (block * step + F.size(F.filter(F.get(fine, block), lambda x: x <= key)) - 1).cast("int")


def with_next(docs: DataFrame, columns: list[str], key: str = "_key", tie: str = "_tie") -> DataFrame:
    """``docs`` with ``next_<c>`` for each of ``columns``: the value of the following
    row by (key, tie); after the last row comes the first. The key is not null."""
    n = docs.count()
    if not n:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    ranges = min(MAX_RANGES, -(-n // ROWS_PER_RANGE))
    cuts = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 4 * ranges)).alias("c")).first().c
    lowest = docs.agg(F.min(key).alias("m")).first().m
    firsts = sorted({lowest, *(c for c in cuts if c > lowest)}) if ranges > 1 else [lowest]
    ranged = docs.withColumn("_range", _range_of(F.col(key), firsts))
    # the ids that open the ranges; at most MAX_RANGES numbers
    opens = {r["_range"]: r.m for r in ranged.select("_range", key).groupBy("_range").agg(F.min(key).alias("m")).collect()}
    filled = sorted(opens)
    before = {opens[r]: filled[i - 1] for i, r in enumerate(filled)}  # the first range visits the last
    visits = F.when(F.col(key).isin(*before), F.get(F.array(*[F.lit(filled[i - 1]) for i in range(len(filled))]), F.array_position(F.array(*[F.lit(r) for r in filled]), F.col("_range")).cast("int") - 1))
    both = F.when(visits.isNotNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest")), F.struct(visits.alias("r"), F.lit(True).alias("guest"))))
    both = both.otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest"))))
    order = Window.partitionBy("_range").orderBy("_guest", key, tie)
    out = ranged.withColumn("_at", F.explode(both)).withColumn("_range", F.col("_at.r")).withColumn("_guest", F.col("_at.guest")).drop("_at")
    return out.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not _guest").drop("_range", "_guest")


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text (second half replaced
    by the beginning of the next document), with likenesses."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))).withColumn("_tie", F.xxhash64("text"))
    rows = with_next(with_fingerprint(rows, "text", "fp"), ["text", "fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), packed("fp").alias("fingerprint"),
        packed("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )


@register("op7_fingerprint")
def op7_fingerprint(spark, sf_dir):
    return edited_likeness(read_table(spark, sf_dir, "documents"))
