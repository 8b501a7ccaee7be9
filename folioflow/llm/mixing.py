"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their ids, form blocks. A source whose target is q of
every `period` blocks releases its k-th block (from 0) at slot floor(k * period / q), with the deadline
ceil((k + 1) * period / q); earliest deadline first gives each slot to one released block. Quotas are
the given weights themselves, as whole numbers over the sum of them all, so nothing is rounded: every
source is at every slot less than one block from its target share, in every period, and the schedule
repeats each period: one period is laid out, and every block's slot follows from it by arithmetic. Every
document is placed once. A source that has run out leaves its slots empty, and the others keep their order
and their shares of what is left. Sources of weight zero come after all others.

DataFrame functions throughout.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import documents, own_name, ship, written

#: Documents of a block; slots of a period without weights given, or SLOTS_EACH for each source if that is more.
BLOCK, PERIOD, SLOTS_EACH = 16, 1024, 8
#: Without weights given, a source's target is the square root of its number of documents.
SCALE = 1000
#: Slots of the longest period that given weights may need.
MOST_SLOTS = 1 << 17


def source_tag(c: str = "source") -> Column:
    """Tells a null source from any named one."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def order_key(docs: DataFrame) -> Column:
    """The hash that orders a source; rows without an id by all they hold, so that they don't keep together."""
    return F.md5(F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("null"), F.xxhash64(*[docs[c] for c in docs.columns if not docs.schema[c].dataType.typeName().startswith(("map", "variant"))]).cast("string"))))


def whole_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The smallest whole numbers in the proportions of `weights`, taken as the decimals that they are written as."""
    exact = {k: Fraction(str(x)) for k, x in weights.items()}
    if any(x < 0 for x in exact.values()):
        raise ValueError("weights are not negative")
    shared = lcm(*(x.denominator for x in exact.values()))
    whole = {k: int(x * shared) for k, x in exact.items()}
    divisor = gcd(*whole.values()) or 1
    whole = {k: x // divisor for k, x in whole.items()}
    if sum(whole.values()) > MOST_SLOTS:
        raise ValueError(f"weights need a period of {sum(whole.values())} slots, {MOST_SLOTS} at most: give them with fewer digits")
    return whole


def targets(counts: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """tag, n -> tag, n, quota, period, i: each source's blocks of a period.

    Given weights are the quotas, in lowest terms; a source without one has none. Otherwise quotas share PERIOD, or
    more, by square roots and largest remainders, one each at least; ties by name.
    """
    all_, by_rest = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "tag")
    if weights is not None:
        given = whole_weights(weights) if weights else {None: 0}
        by_tag = F.create_map(*[F.lit(v) for name, x in given.items() for v in ("null" if name is None else f"={name}", x)])
        w = F.coalesce(F.try_element_at(by_tag, F.col("tag")), F.lit(0))
        # weights of sources that aren't there have no slots
        t = counts.withColumn("quota", w.cast("long")).withColumn("period", F.sum("quota").over(all_))
    else:
        t = counts.withColumn("w", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n").cast("double")) * SCALE)).cast("long"))
        t = t.withColumn("total", F.sum("w").over(all_)).withColumn("sources", F.count("*").over(all_)).withColumn("period", F.greatest(F.lit(PERIOD), F.col("sources") * SLOTS_EACH))
        t = t.withColumn("share", (F.col("period") - F.col("sources")) * F.col("w")).withColumn("quota", 1 + F.expr("share div total")).withColumn("rest", F.col("share") % F.col("total"))
        t = t.withColumn("left", F.col("period") - F.sum("quota").over(all_)).withColumn("place", F.row_number().over(by_rest))
        t = t.withColumn("quota", F.col("quota") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0))
    return t.select("tag", "n", "quota", "period", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tag")) - 1).alias("i"))


#: Slots that are laid out at once; a period is a run of such stretches.
STRETCH = 256
#: The slots of one period in turn; `next` holds each source's next release and deadline, `picks` the sources chosen.
_EDF = f"""
aggregate(
  sequence(0L, (period - 1) div {STRETCH}),
  named_struct('next', transform(quotas, (q, i) -> named_struct('deadline', (period + q - 1) div q, 'i', i, 'release', 0L, 'k', 0L)), 'picks', cast(array() as array<array<int>>)),
  (whole, stretch) -> transform(array(aggregate(
    sequence(stretch * {STRETCH}, least(period, (stretch + 1) * {STRETCH}) - 1),
    named_struct('next', whole.next, 'picks', cast(array() as array<int>)),
    (s, t) -> transform(
      array(array_min(filter(s.next, x -> x.release <= t))),
      best -> named_struct(
        'next', transform(s.next, x -> if(x.i = best.i, named_struct(
          'deadline', ((x.k + 2) * period + quotas[x.i] - 1) div quotas[x.i], 'i', x.i, 'release', ((x.k + 1) * period) div quotas[x.i], 'k', x.k + 1), x)),
        'picks', concat(s.picks, array(best.i))))[0])),
    done -> named_struct('next', done.next, 'picks', concat(whole.picks, array(done.picks))))[0],
  whole -> flatten(whole.picks))
"""


def schedule(target: DataFrame) -> DataFrame:
    """tag, quota, period, slots, shift: the slots of each source's blocks in one period; a source without a quota follows, a block a slot, `shift` slots on."""
    some = target.filter("quota > 0").withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tag")) - 1)
    laid = some.groupBy("period").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "quota"))), lambda x: x["quota"]).alias("quotas"))
    picks = laid.select(F.posexplode(F.expr(_EDF)).alias("slot", "i")).groupBy("i").agg(F.array_sort(F.collect_list(F.col("slot").cast("long"))).alias("slots"))
    some = some.join(picks, "i").withColumn("last", F.expr(f"(n - 1) div {BLOCK}"))
    some = some.withColumn("end", F.expr("(last div quota) * period + slots[cast(last % quota as int)] + 1"))
    none = target.filter("quota = 0").select("tag", F.lit(1).cast("long").alias("quota"), F.lit(1).cast("long").alias("period"), F.array(F.lit(0).cast("long")).alias("slots"), F.expr(f"(n - 1) div {BLOCK} + 1").alias("blocks"), F.lit(0).cast("long").alias("end"))
    both = some.select("tag", "quota", "period", "slots", F.lit(0).cast("long").alias("blocks"), "end").unionByName(none)
    before = Window.partitionBy(F.lit(0)).orderBy("tag").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.when(F.col("blocks") > 0, F.max("end").over(Window.partitionBy(F.lit(0))) + F.coalesce(F.sum("blocks").over(before), F.lit(0))).otherwise(0)
    return both.select("tag", "quota", "period", "slots", shift.cast("long").alias("shift"))


def placed(docs: DataFrame, weights: dict[str | None, float] | None = None, name: str = "mix") -> DataFrame:
    """`docs` with a struct: block (of its source), release, deadline, slot, position.

    Position orders the mixture: slot * BLOCK + place in the block; positions of slots left empty are not
    used. A column of that name is replaced, others pass through. Null source is a source of its own; rows of equal
    id take neighbouring places in any order; rows without an id lie by the hash of all their columns. Texts aren't
    read, whatever their length. Sources without a weight, or with zero, come after all others, one after another. An
    empty table gives an empty one.
    """
    ship(docs.sparkSession)
    # the hash's first digits split a source, however large, into 256 runs of its order
    cut = lambda df: df.withColumn("salt", F.substring("key", 1, 2))
    counts = written(cut(docs.select(source_tag().alias("tag"), order_key(docs).alias("key"))).groupBy("tag", "salt").agg(F.count("*").alias("n")), "mix-counts")
    before = Window.partitionBy("tag").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tag", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    plan = written(schedule(targets(counts.groupBy("tag").agg(F.sum("n").alias("n")), weights)), "mix-plan")
    rows = cut(docs.select(F.struct("*").alias("row"), source_tag().alias("tag"), order_key(docs).alias("key")))
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy("tag", "salt").orderBy("key", "row.doc_id")) - 1)
    rows = rows.join(starts, ["tag", "salt"]).join(plan, "tag").withColumn("rank", F.col("own") + F.col("start"))
    rows = rows.withColumn("block", F.expr(f"rank div {BLOCK}")).withColumn("turn", F.expr("shift + (block div quota) * period")).withColumn("k", F.expr("block % quota"))
    rows = rows.withColumn("slot", F.expr("turn + slots[cast(k as int)]"))
    mix = F.struct(
        F.col("block").cast("long").alias("block"),
        F.expr("turn + (k * period) div quota").cast("long").alias("release"),
        F.expr("turn + ((k + 1) * period + quota - 1) div quota").cast("long").alias("deadline"),
        F.col("slot").cast("long").alias("slot"),
        F.expr(f"slot * {BLOCK} + rank % {BLOCK}").cast("long").alias("position"),
    )
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != name.lower()], mix.alias(name))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """The rows of `docs`, with its columns, in the order of the mixture: partitions, and rows in them, ascend."""
    name = own_name(docs, "mix")
    return placed(docs, weights, name).repartitionByRange(F.col(name)["position"]).sortWithinPartitions(F.col(name)["position"]).drop(name)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(documents(spark, sf_dir).select("doc_id", "source")).select("doc_id", "source", "mix.*")


OP9_SQL = f"""
WITH RECURSIVE counts AS (
  SELECT coalesce('=' || source, 'null') AS tag, count(*) AS n FROM documents GROUP BY 1),
weighed AS (
  SELECT tag, greatest(1, cast(floor(sqrt(cast(n AS DOUBLE)) * {SCALE}) AS BIGINT)) AS w FROM counts),
totals AS (
  SELECT cast(sum(w) AS BIGINT) AS total, count(*) AS sources, greatest({PERIOD}, count(*) * {SLOTS_EACH}) AS period FROM weighed),
shares AS (
  SELECT tag, period, 1 + ((period - sources) * w) // total AS quota, ((period - sources) * w) % total AS rest FROM weighed, totals),
target AS (
  SELECT tag, period, row_number() OVER (ORDER BY tag) AS i,
    quota + CASE WHEN row_number() OVER (ORDER BY rest DESC, tag) <= period - sum(quota) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
laid AS (
  SELECT any_value(period) AS period, list(cast(quota AS BIGINT) ORDER BY i) AS quotas FROM target),
edf(t, done, pick) AS (
  SELECT cast(-1 AS BIGINT), list_transform(quotas, lambda q: cast(0 AS BIGINT)), cast(0 AS BIGINT) FROM laid
  UNION ALL
  SELECT t, list_transform(done, lambda d, j: d + CASE WHEN j = best.i THEN 1 ELSE 0 END), cast(best.i AS BIGINT)
  FROM (
    SELECT edf.t + 1 AS t, done, list_min(list_filter(list_transform(quotas, lambda q, j:
      CASE WHEN done[j] < q AND (done[j] * period) // q <= edf.t + 1
        THEN {{'deadline': ((done[j] + 1) * period + q - 1) // q, 'i': j}} END), lambda x: x IS NOT NULL)) AS best
    FROM edf, laid WHERE edf.t + 1 < period)),
slots AS (
  SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM edf WHERE t >= 0),
ranked AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS tag,
    row_number() OVER (PARTITION BY source ORDER BY md5(cast(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents)
SELECT doc_id, source, cast(r // {BLOCK} AS BIGINT) AS block,
  cast((r // {BLOCK} // quota) * period + (k * period) // quota AS BIGINT) AS release,
  cast((r // {BLOCK} // quota) * period + ((k + 1) * period + quota - 1) // quota AS BIGINT) AS deadline,
  cast((r // {BLOCK} // quota) * period + slot AS BIGINT) AS slot,
  cast(((r // {BLOCK} // quota) * period + slot) * {BLOCK} + r % {BLOCK} AS BIGINT) AS position
FROM ranked JOIN target USING (tag) JOIN slots ON slots.i = target.i AND slots.k = (r // {BLOCK}) % quota
"""
