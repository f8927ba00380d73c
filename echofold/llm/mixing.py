"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue whose documents wait in a shuffled order (by the MD5 of the id). A copy of a
document leaves its queue at the virtual time `words of the source up to and including it / target of
the source`; each further pass over a source adds the source's size. All copies are merged in the
order of that finish time and the merged sequence is cut where the words reach the budget. A source
therefore has delivered its target at virtual time one, whatever the others hold.

Targets: `weight * level`, stopped at `repeats` times the source's size; the level is the one at which
the targets add up to the budget, which is where repeated resharing of the excess ends. With sources in
ascending order of cap / weight, the level is the maximum over j of
`(budget - caps before j) / weights from j on`: it rises while sources are capped and falls after.

Scale: a running sum within a source is a sum over hash buckets plus a window inside one
(source, bucket), so a source with a third of all rows is spread over `BUCKETS` windows. The cut needs
one pass of per-slot sums and then sorts one slot of virtual time, 1 / SLOTS of the rows.

Edge cases: a null or blank text has size 0 and is never in the way (taken 0); null sources are one
source, last in order; rows with equal id, size and source are interchangeable, so ties cannot change
the result; an empty table gives an empty result; columns besides the three named ones are carried by
`mix` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echofold.llm.common import n_words, stored

BUCKETS, SLOTS = 4096, 4096


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> + weight, target, budget. One row per source; the windows here hold
    one row per source, never documents."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    cap = F.col("source_size") * repeats
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    return (
        sizes.withColumn("weight", F.element_at(pattern, ((rank - 1) % len(weights) + 1).cast("int")))
        .withColumn("budget", (F.sum("source_size").over(everything) * F.lit(float(share))).cast("double"))
        .withColumn("ratio", cap.cast("double") / F.col("weight"))
        .withColumn("capped", F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - cap)
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("budget") - F.col("capped")) / F.col("open")).over(everything))
        .withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target", "budget")
    )


def _copies(c: dict[str, Column], repeats: int) -> Column:
    """The passes whose finish time can lie before the cut: those up to just beyond the target."""
    last = F.least(F.lit(repeats - 1), F.ceil(c["target"] / F.greatest(c["source_size"], F.lit(1))).cast("int"))
    return F.sequence(F.lit(0), last)


def queued(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    repeats: int = 3,
    share: float = 1.0,
    keep_rows: bool = False,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, finish (of its first copy), taken,
    and with `keep_rows` the whole row as the struct `row`."""
    spark = docs.sparkSession
    own = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")]
    sized = stored(docs.select(*own), "mix-sizes")
    plan = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats, share), "mix-targets")
    budget = plan.agg(F.max("budget")).first()[0] or 0.0

    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    bucket = F.conv(F.substring("key", 1, 3), 16, 10).cast("int") % BUCKETS
    keyed = (docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if keep_rows else sized).withColumn("key", key).withColumn("bucket", bucket)
    sums = sized.withColumn("key", key).withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = sums.withColumn("base", F.sum("held").over(before) - F.col("held")).select("source", "bucket", "base")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def joined(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"r_{c}") if c in on else F.col(c) for c in right.columns])
        cond = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in on]
        return left.join(right, cond, "left").drop(*[f"r_{c}" for c in on])

    lined = joined(joined(keyed.withColumn("upto", F.sum("size").over(inside)), bases, "source", "bucket"), plan.drop("weight", "budget"), "source")
    lined = lined.withColumn("upto", F.col("upto") + F.col("base")).drop("base", "bucket")
    if keep_rows:  # the window carried whole rows; what follows reads them twice
        lined = stored(lined, "mix-queue")
        light = lined.drop("row")
    else:
        light = lined = stored(lined, "mix-queue")

    finish = lambda pass_: (pass_ * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    c = {"target": F.col("target"), "source_size": F.col("source_size")}
    copies = (
        light.filter(F.col("target") > 0)
        .withColumn("pass", F.explode(_copies(c, repeats)))
        .withColumn("finish", finish(F.col("pass")))
        .withColumn("slot", F.floor(F.col("finish") * SLOTS))
    )
    per_slot = copies.groupBy("slot").agg(F.sum("size").alias("held"))
    upto_slot = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 3 * SLOTS rows
    full = per_slot.withColumn("upto", F.sum("held").over(upto_slot)).filter(F.col("upto") > budget).orderBy("slot").first()
    order = ["finish", "source_null", "source", "pass", "key", "id", "size"]
    null = F.col("source").isNull().alias("source_null")
    cut = None
    if full is not None:
        running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = (
            copies.filter(F.col("slot") == full["slot"])
            .withColumn("source_null", null)
            .withColumn("total", F.sum("size").over(running) + (full["upto"] - full["held"]))
            .filter(F.col("total") > budget)
            .orderBy(*order)
            .first()
        )

    def passes(p: int) -> Column:
        """Whether copy p lies before the cut: the first copy that would exceed the budget."""
        possible = (F.col("target") > 0) & (F.lit(p) <= F.element_at(_copies(c, repeats), -1))
        if cut is None:
            return possible.cast("int")
        mine = F.struct(finish(F.lit(p)).alias("finish"), null, F.coalesce("source", F.lit("")).alias("source"), F.lit(p).alias("pass"), "key", "id", "size")
        edge = F.struct(*[F.lit("" if k == "source" and cut[k] is None else cut[k]).alias(k) for k in order])
        return (possible & (mine < edge)).cast("int")

    taken = sum((passes(p) for p in range(1, repeats)), passes(0))
    first = F.when(F.col("target") > 0, finish(F.lit(0)))
    out = lined.withColumn("copies", F.when(F.col("size") > 0, F.coalesce(taken, F.lit(0))).otherwise(0)).withColumn("finish", first)
    return out.select("id", "source", "size", "source_size", "target", "finish", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", *(["row"] if keep_rows else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the rows of `docs` in the order of their virtual finish times, each as often
    as it was taken, with the columns of `docs` and no others."""
    rows = queued(docs, keep_rows=True, **options).filter(F.col("copies") > 0)
    again = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.col("finish") + F.col("pass") * F.col("source_size") / F.col("target")
    return again.withColumn("at", at).orderBy("at", "source", "id").select("row.*")


def mixture_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, in mixture order."""
    q = queued(docs, **options)
    return q.orderBy("finish", "source", "id").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
         CAST(coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped,
         CAST(sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open_weight
  FROM sizes
), targets AS (
  SELECT source, source_size, budget,
         least(CAST(3 * source_size AS DOUBLE), max((budget - capped) / open_weight) OVER () * weight) AS target
  FROM ranked
), lined AS (
  SELECT s.doc_id, s.source, s.key, s.size, t.source_size, t.target, t.budget,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto,
         row_number() OVER () AS rid
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT rid, size, budget, sum(size) OVER (ORDER BY CAST(pass * source_size + upto AS DOUBLE) / target, source NULLS LAST, pass, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS total
  FROM lined, (VALUES (0), (1), (2)) AS p(pass)
  WHERE target > 0 AND pass <= least(2, ceil(target / greatest(source_size, 1)))
), taken AS (
  SELECT rid, CAST(sum(size) AS BIGINT) AS taken FROM copies WHERE total <= budget GROUP BY rid
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM lined LEFT JOIN taken USING (rid)
"""
