"""Secret scan with multipart credential linking (op 6), in DataFrame functions.

Strong kinds are reported by themselves: ``assign`` (a named assignment), ``access``
(an access identifier) and ``hex`` (a long lower-case hex string). Weak kinds are
nothing by themselves: ``key`` (40 characters of a base64 alphabet), ``ident`` (a user
or client name in an assignment) and ``endpoint`` (a URL). They are reported when a
part that completes them lies in the same scope, ``SCOPE`` code points around them:
a key wants an identifier (access or ident), an ident wants a secret (assign, hex
or key), an endpoint wants an access identifier or a secret. A weak span
that overlaps a strong one is part of it and not reported again.

Matching is per row and native: ``split`` gives the gaps and ``regexp_extract_all`` the
matches of a pattern; the lengths of both are stored (no text), and their running sums
are the positions. The scopes are joined as intervals: spans are dealt to bins of
``SCOPE`` code points, and a semi join on (row, bin) keeps a weak span once, however
many partners it has.

Defined cases: a null or empty text has no span (empty string, hash of the empty
string); rows with the same id are answered each; a null id stays null; positions
are code points, ends exclusive; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import stored
from .registry import read_table, register

SCOPE = 200

# fixed values: patterns of the strong kinds, and the least length of what they find
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6

KEY = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
IDENT = r"""(?<![A-Za-z0-9])(?i:user(?:_?name)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""(?i:https?|wss?|ftps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x00-\x20"'<>|]+"""

#: kinds in the order in which spans with the same start are listed
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY, "ident": IDENT, "endpoint": ENDPOINT}
STRONG = ("assign", "access", "hex")
COMPLETED_BY = {"key": ("access", "ident"), "ident": ("assign", "hex", "key"), "endpoint": ("access", "assign", "hex")}


def _found(text: Column, kind: str) -> Column:
    """Gap before, length and value length of every match of the kind."""
    pattern = KINDS[kind]
    lengths = lambda c: F.transform(c, F.length)
    gaps = lengths(F.split(text, pattern, -1))
    whole = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    value = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(2))) if kind == "assign" else whole
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), value.alias("value"))
    return F.when(text.rlike(pattern), zipped)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): all rows as (row, doc_id); all spans of all kinds, strong and
    weak, as (row, kind, rank, start, end)."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), *[_found(body, k).alias(k) for k in KINDS])
    found = stored(found, "secret-matches")  # fixes the row numbers, and is narrow
    rank = {k: i for i, k in enumerate(KINDS)}
    parts = None
    for kind in KINDS:
        one = found.where(F.col(kind).isNotNull()).select("row", F.lit(kind).alias("kind"), F.lit(rank[kind]).alias("rank"), F.posexplode(kind).alias("pos", "m"))
        parts = one if parts is None else parts.unionByName(one)
    before = Window.partitionBy("row", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("row", "kind", "rank", "pos", F.col("m.gap").cast("long").alias("gap"), F.coalesce("m.size", F.lit(0)).cast("long").alias("size"), "m.value")
    parts = parts.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    parts = parts.where("size > 0").where((F.col("kind") != "assign") | (F.col("value") >= LEAST_ASSIGNED))
    return found.select("row", "doc_id"), parts.select("row", "kind", "rank", "start", "end")


def _bins(first: Column, last: Column, scope: int) -> Column:
    return F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope)))


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong spans, and the weak ones whose complement is in scope."""
    strong = parts.where(F.col("kind").isin(*STRONG))
    weak = parts.where(~F.col("kind").isin(*STRONG))
    near = strong.select("row", F.col("start").alias("s"), F.col("end").alias("e"), _bins(F.col("start"), F.col("end") - 1, scope).alias("bin"))
    # pieces of strong spans are gone before they can complete anything
    mine = weak.withColumn("bin", _bins(F.col("start"), F.col("end") - 1, scope))
    covered = mine.join(near, (mine.row == near.row) & (mine.bin == near.bin) & (near.s < mine.end) & (mine.start < near.e), "left_semi")
    weak = weak.join(covered.select("row", "rank", "start").distinct(), ["row", "rank", "start"], "left_anti")
    everything = strong.unionByName(weak)
    partner = everything.select("row", F.col("kind").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"), _bins(F.col("start"), F.col("end") - 1, scope).alias("bin"))
    wide = weak.withColumn("bin", _bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope - 1, scope))
    fits = F.lit(False)
    for kind, wants in COMPLETED_BY.items():
        fits = fits | (wide.kind == kind) & partner.k.isin(*wants)
    reach = (partner.s < wide.end + scope) & (wide.start < partner.e + scope)
    linked = wide.join(partner, (wide.row == partner.row) & (wide.bin == partner.bin) & fits & reach, "left_semi").drop("bin").distinct()
    return strong.unionByName(linked)


def _joined(listed: Column) -> Column:
    return F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, scope: int = SCOPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the strong kinds, the hash of their spans,
    and all reported spans."""
    rows, parts = spans(docs, key, text)
    parts = stored(parts, "secret-spans")
    listed = F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind")))
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    per_row = link(parts, scope).groupBy("row").agg(*[count(k) for k in KINDS], listed.alias("all"))
    out = rows.join(per_row, "row", "left")
    strong = F.filter(F.coalesce("all", F.array()), lambda x: x["kind"].isin(*STRONG))
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(strong), 256).alias("base_sha256"), _joined(F.coalesce("all", F.array())).alias("spans"),
    )


@register("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    return report(read_table(spark, sf_dir, "documents"))
