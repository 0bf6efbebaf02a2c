"""Interaction audit of document filters (op 11).

Every filter leaves a relation: the table of the rows that fail it, written once.
What a filter does behind others depends only on the set of filters before it, so
each filter is followed through all sets of the others, not through all orders:
a left-semi join with its own table gives the rows it would remove first, and a
left-anti join for each other filter takes away what that one has removed, in the
copies of a row whose prefix holds it. The outcome is one table of removals
(filter, set of filters before, row). Left-semi joins with the ids of good and of
toxic documents give the label losses; what a filter's first place removes less
what it removes here is redundant; the total less all removals so far is kept.

Every join is on the row number or on (text hash, id), so neither a large source nor
a text that a third of the table shares falls into one task: of equal texts the
smallest id is found by an aggregation with partial sums, and the rows that are not
that one follow from an anti join on both columns. Counts per source are partial
sums too. Texts are read once and called equal by a 128-bit hash. The number of
prefix sets is two to the number of filters: meant for a handful of filters.

Defined cases: a null text counts as empty, a null source as the empty string; rows
are counted one by one, also those that repeat an id; an id is no smaller than
itself, so repeated rows don't fail the copy filter by each other; a row
without id never fails it, and has no label; a document labelled twice counts once,
as good (toxic) if one of its labels says so; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folders import stored
from .registry import read_table, register

BLANKS = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT = 50, 65, 5


def judged(docs: DataFrame) -> DataFrame:
    """One narrow row for each document, written once: ``row`` (a number of its own),
    doc_id, part, the conditions of filters A to D and a 128-bit hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"),
    ).withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    n_words, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    rows = rows.select(
        "row", "doc_id", "part",
        (n_words < LEAST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT_PCT * n_words).alias("B"),
        (100 * capitals > MOST_CAPITALS_PCT * F.length("text")).alias("C"),
        F.col("text").rlike(MARKS).alias("D"),
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"),
    )
    return stored(rows, "audit-rows")


def failing(rows: DataFrame) -> dict[str, DataFrame]:
    """Filter -> table (row) of the rows that fail it, each written once."""
    fails = {f: rows.where(f).select("row") for f in "ABCD"}
    named = rows.where("doc_id is not null")
    first = named.groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    fails["E"] = named.join(first, ["hash", "doc_id"], "left_anti").select("row")
    return {f: stored(ids, f"audit-fails-{f}") for f, ids in fails.items()}


def removals(rows: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """(filter, before, row, part): the rows that a filter removes when exactly the filters
    of ``before`` stand in front of it. Filters are numbered as in ``fails``; before
    is a sum of powers of two."""
    found = None
    for i, f in enumerate(fails):
        here = rows.select("row", "part").join(fails[f], "row", "left_semi").withColumn("before", F.lit(0))
        for j, g in enumerate(fails):
            if j == i:
                continue
            here = here.withColumn("before", F.explode(F.array("before", F.col("before") + (1 << j))))
            gone = fails[g].select(F.col("row").alias("gone"))
            taken = (F.col("row") == F.col("gone")) & (F.col("before") >= (1 << j))
            # the copy with g in its prefix is the only one that g has touched: j rises,
            # so before >= 2^j says that g is in it
            here = here.join(gone, taken, "left_anti")
        here = here.select(F.lit(i).alias("filter"), "before", "row", "part")
        found = here if found is None else found.unionByName(here)
    return stored(found, "audit-removals")


def labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(row) of the documents with a 1 in that column of the labels."""
    ids = labels.where(F.col(column) == 1).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return rows.select("row", "doc_id").join(ids, "doc_id", "left_semi").select("row")


def audit(rows: DataFrame, fails: dict[str, DataFrame], losses: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of all filters and step. ``losses`` maps a column name to
    the (row) table whose removed members are counted under it."""
    names = list(fails)
    removed = removals(rows, fails)
    keys = ["part", "filter", "before"]
    kinds = {"removed": removed, **{c: removed.join(ids, "row", "left_semi") for c, ids in losses.items()}}
    counts = None
    for kind in kinds:
        one = kinds[kind].select(*keys, *[F.lit(int(c == kind)).alias(c) for c in kinds])
        counts = one if counts is None else counts.unionByName(one)
    counts = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in kinds])

    steps = []
    for order in permutations(range(len(names))):
        label = "".join(names[i] for i in order)
        steps += [(len(steps) + s, label, s + 1, i, sum(1 << j for j in order[:s])) for s, i in enumerate(order)]
    orders = rows.sparkSession.createDataFrame(steps, "k int, filter_order string, step int, filter int, before int")
    spine = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    spine = spine.join(F.broadcast(orders), "k").join(counts, keys, "left").na.fill(0, list(kinds))

    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    everywhere = Window.partitionBy("part", "filter")
    first = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(everywhere)
    alone = F.max(F.when(F.col("step") == len(names), F.col("removed"))).over(everywhere)
    return spine.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed",
        (first - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), *losses,
        F.sum("removed").over(everywhere).alias("shapley"),
    )


_SQL = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, coalesce(text, '') AS text, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
f AS (
  SELECT d.part,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text))::INT
    + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > firsts.least, false)::INT AS mask,
    (d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL))::INT AS good,
    (d.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))::INT AS toxic
  FROM d JOIN firsts ON d.text = firsts.text),
cells AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [a.name, b.name, c.name, d.name, e.name] AS names, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT array_to_string(names, '') AS filter_order, s.step, names[s.step] AS name, bits[s.step] AS bit,
         coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
counted AS (
  SELECT part, filter_order, step, name,
    sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN (mask & before) <> 0 AND (mask & bit) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, name)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley
FROM counted
"""


@register("op11_filter_audit", _SQL)
def op11_filter_audit(spark, sf_dir):
    rows = judged(read_table(spark, sf_dir, "documents"))
    labels = read_table(spark, sf_dir, "labels")
    losses = {"good_lost": labelled(rows, labels, "quality"), "toxic_lost": labelled(rows, labels, "toxic")}
    return audit(rows, failing(rows), losses)
