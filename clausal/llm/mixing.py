"""Mixing sources to target weights along a training curriculum, in DataFrame functions only.

Sources share the words of all documents by weight; no source gives more than `most`
times its own words, and what it can't give is shared anew among the others. A source's
words pass by in a fixed order, again and again until its target is reached. Each source
has a schedule, a piecewise linear weight over training time 0 to 1; its integral, scaled
to the target, is the source's demand up to a time. A document's place in its source's
stream, put through the inverse of that integral, is its training position, and a range
sort by position gives the training order.

Prefix sums are two-level: the order is by a hash, hashes fall into buckets, a running sum
over bucket totals gives each bucket's offset, and only then documents are summed within
a bucket, so that a source with a third of all rows is spread over all buckets.

Defined results: a null text or one without words has size 0 and is never taken; null is a
source of its own and comes last; repeated rows are documents of their own, each with its
place, and in the training sequence one of them appears at all their places; the words of a very
long text count like others, though its source may miss its target by half of it; an empty
table gives no rows; other columns pass through `mixed`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausal.llm.common import WORD, dropped, text_key, unused, written

LAST = (1 << 63) - 1

#: Buckets of the hashed order of a source.
BUCKETS = 4096

#: A schedule: (time, weight) knots from time 0 to 1.
Schedule = Sequence[tuple[float, float]]

#: By rank of the source: a steady, a fading and a growing share.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def sizes(text: str = "text") -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, rank, target) for a table (source, source_size) of one row a source.

    Sources by code point, null last, take the weights in turn. The fixed point of
    resharing is min(most x size, level x weight) with one level for all: sources reach
    their limit in the order of size by weight, so the level follows from running sums.
    The table has one row a source, far fewer than documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    df = totals.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    df = df.withColumns({
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
    })
    # the first source that isn't filled sets the level for itself and all after it
    df = df.withColumn("level", F.col("left") / F.col("open")).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(whole)
    return df.withColumn("first", level).select("source", "source_size", "rank", F.when(F.col("first").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("first.level") * F.col("weight"))).alias("target"))


def position(share: Column, rank: Column, curriculum: Sequence[Schedule] = CURRICULUM) -> Column:
    """The training time at which a source has given a share (0 to 1) of its target: the inverse of its integrated schedule."""

    def inverse(schedule: Schedule) -> Column:
        area, steps = 0.0, []
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
            more = (w0 + w1) / 2 * (t1 - t0)
            steps.append((t0, t1, w0, w1, area, area + more))
            area += more
        out = F.lit(1.0)
        for t0, t1, w0, w1, a0, a1 in reversed(steps):
            u = F.greatest(share * area - a0, F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            # w0 x + slope x^2 / 2 = u, solved without cancellation
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * u, F.lit(0.0)))
            at = t0 + F.when(u > 0, 2 * u / (root + w0)).otherwise(F.lit(0.0))
            out = F.when(share * area <= a1, F.least(at, F.lit(float(t1)))).otherwise(out)
        return out

    out = inverse(curriculum[-1])
    for i in range(len(curriculum) - 1):
        out = F.when(rank % len(curriculum) == i, inverse(curriculum[i])).otherwise(out)
    return out


def planned(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(doc_id, key, size, source_size, target, rank, begin, taken, repeats) of every row; key is a key of its text.

    begin is the document's offset in its source's stream. A stream of `source_size` words
    passes until `target` words are taken; a document counts in a pass if its middle lies
    before the target, so a source misses its target by half a document at most.
    """
    # md5 is the order, so that SQL can state it; three hex digits of it choose the bucket
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = written(docs.select("doc_id", "source", text_key().alias("key"), sizes().alias("size"), order.alias("order")), "sizes")
    rows = sized.withColumns({"name": F.coalesce("source", F.lit("")), "none": F.col("source").isNull(), "bucket": F.conv(F.substring("order", 1, 3), 16, 10).cast("int")})
    at = ["name", "none", "bucket"]
    buckets = rows.groupBy(*at).agg(F.sum("size").alias("in"), F.first("source").alias("source"))
    ahead = Window.partitionBy("name", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("in").over(ahead), F.lit(0)))  # at most BUCKETS rows a source
    goals = targets(buckets.groupBy("name", "none").agg(F.sum("in").alias("source_size"), F.first("source").alias("source")), weights, most)
    goals = goals.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "source_size", "rank", "target")
    met = rows.drop("source").join(buckets.select(*at, "ahead").join(goals, ["name", "none"]), at)
    within = Window.partitionBy(*at).orderBy("order", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("begin", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    passes = F.floor((F.col("target") - F.col("begin") - F.col("size") / 2) / F.col("source_size")) + 1
    repeats = F.when(F.col("size") > 0, F.least(F.greatest(passes, F.lit(0)), F.lit(math.ceil(most)))).otherwise(0).cast("long")
    out = met.withColumn("repeats", repeats)
    out = out.select("doc_id", "key", "size", "source_size", "target", "rank", "begin", (F.col("repeats") * F.col("size")).alias("taken"), "repeats")
    out._clausal_path = sized._clausal_path  # so that dropped() deletes what it is read from
    return out


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, curriculum: Sequence[Schedule] = CURRICULUM) -> DataFrame:
    """The training sequence: the columns of docs, a row for each time that a document is taken, range-sorted by training position.

    The plan has no texts; they join it once and move once more to their range. Borders
    of ranges are quantiles of the plan's positions. Rows equal in id and text share
    their places: each is taken as often as its own place in the stream says.
    """
    plan = planned(docs, weights, most)
    turns = plan.filter("repeats > 0").select("doc_id", "key", "rank", "begin", "repeats", "source_size", "target").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("repeats").cast("int") - 1)))
    share = (F.col("begin") + F.col("turn") * F.col("source_size")) / F.col("target")
    spots = turns.select("doc_id", "key", position(share, F.col("rank"), curriculum).alias("at"))
    # rows equal in id and text: all their places go to one of them
    spots = written(spots.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("at")).alias("spots")), "plan")
    dropped(plan)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = spots.select(F.explode("spots").alias("at")).agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    by, key, all_at, at = unused(docs, "id", "key", "spots", "at")
    keyed = docs.withColumns({by: F.coalesce("doc_id", F.lit(LAST)), key: text_key()}).dropDuplicates([by, key])
    goals = spots.select(F.coalesce("doc_id", F.lit(LAST)).alias(by), F.col("key").alias(key), F.col("spots").alias(all_at))
    placed = keyed.join(goals, [by, key]).withColumn(at, F.explode(all_at))
    limits = F.array(*[F.lit(float(b)) for b in borders or []]).cast("array<double>")
    part = F.size(F.filter(limits, lambda b: b < F.col(at)))
    return placed.repartitionById(parts, part).sortWithinPartitions(at, by).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_report(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, curriculum: Sequence[Schedule] = CURRICULUM) -> DataFrame:
    """A row for each document, range-sorted by the position at which it is first taken: (doc_id, size, source_size, target, taken, position)."""
    plan = planned(docs, weights, most)
    share = F.when(F.col("repeats") > 0, F.col("begin") / F.col("target"))
    placed = plan.withColumn("position", F.when(share.isNotNull(), position(share, F.col("rank"), curriculum)))
    placed = written(placed.select("doc_id", "size", "source_size", "target", "taken", "position"), "placed")
    dropped(plan)
    return placed.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


#: DuckDB SQL for mix_report without positions.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
-- reshare until no open source is above its limit
f(turn, rank, target, full_) AS (
  SELECT 0, rank, (SELECT sum(source_size) FROM s)::DOUBLE * weight / (SELECT sum(weight) FROM w), false FROM w
  UNION ALL
  SELECT turn + 1, rank,
         CASE WHEN now THEN cap
              ELSE weight * (total - sum(CASE WHEN now THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN now THEN 0 ELSE weight END) OVER (), 0) END, now
  FROM (SELECT f.*, w.cap, w.weight, f.full_ OR f.target >= w.cap AS now, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM f JOIN w USING (rank)) WHERE turn < 40),
t AS (SELECT w.source, w.source_size, least(f.target, w.cap) AS target FROM f JOIN w USING (rank) WHERE turn = 40),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * least(greatest(floor((target - begin_ - size / 2.0) / source_size) + 1, 0), 3) END AS BIGINT) AS taken
FROM p
"""
