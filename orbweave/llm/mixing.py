"""Mixing sources to target weights with a time-varying curriculum. DataFrame functions only.

Sizes are words. Each source has a target: its share, by weight, of ``share`` times all words, but at most ``most``
times its own words; what lies above is shared again by weight until no target is above its limit. That fixed point is
``least(most * size, level * weight)`` with one common level: it starts where no source is held back and rises, in rounds
of one aggregate each, until no further source reaches its limit.

A source's documents stand in the order of a hash. The mix takes each document as often as whole passes fit into the
target, then a further time the documents at the front whose sum fits into the rest, then, ``refine`` times, the further
document whose size is nearest to what is missing. Where that misses the target by more than ``slack`` of it
and more than an average document (a giant document at the border shuts out those behind it, or is picked though too
large), the picks are undone and rounds follow: of the documents not yet taken that fit into what is missing, those at
the front whose sum fits, until none fits; then the document of nearest size. No document is taken more than ``most``
times.

Curriculum: source s is drawn at time t in (0, 1) with weight 1 + slope * (2t - 1) times its target. The integral of that
schedule is the source's cumulative demand, and the sum of these integrals over all sources the mix's cumulative token
demand D(t). Each time a document is taken, the source's integral is inverted at the document's middle in its source's
demand, which gives the time t; D(t), the words of all sources that are due by then, is its training position. What is
taken of a document is counted from the positions that it was assigned; ``training_order`` range-sorts by them.

Scale: only slim rows (id, source, size, hash) are shuffled. A hot source is split into ``BUCKETS`` ranges of the hash,
whose sums are added up first, so no task holds a source. Sources may be many (domains): their places in the order of
names come from range partitions and prefix sums, and only numbers of all sources reach the driver.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; repeated rows are documents of
their own; documents of size 0 are never taken a further time; if all sizes are 0, all targets are; empty tables give an
empty result; further columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.ranks import placed
from orbweave.storage import materialise

WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (-0.6, 0.0, 0.6)  # the first kind of source fades out, the third fades in
SHARE = 1.5
MOST = 2
REFINE = 3
SLACK = 0.01
SEED = "mix"
BUCKETS = 4096  # of the hash, by its first three hexadecimal digits


def n_words(text: str = "text") -> Column:
    """The number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(F.translate(marks, "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size), one row each, with ``kind`` (its place modulo the weights), ``weight`` and ``target``."""
    ranked = placed(sources.withColumn("unnamed", F.col("source").isNull()), ["unnamed", "source"]).withColumn("kind", F.col("place") % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("kind") + 1).cast("int")))
    ranked = ranked.withColumn("limit", (F.lit(most) * F.col("source_size")).cast("double")).withColumn("at", F.col("limit") / F.col("weight"))
    ranked = materialise(ranked.select("source", "source_size", "kind", "weight", "limit", "at"), "sources")
    level, before = 0.0, None
    while level != before:  # the sources held back by the level so far, and what the others may then have
        held = F.col("at") < level
        got = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(held, F.col("limit")).otherwise(0.0)).alias("full"), F.sum(F.when(held, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        if not got.rest:
            break
        level, before = (share * got.all - got.full) / got.rest, level
    return ranked.select("source", "source_size", "kind", "weight", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def _order(doc_id: str = "doc_id") -> Column:
    """The hash that documents of a source are ordered by; rows without an id are told apart by their text."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    return F.md5(F.concat_ws("|", F.lit(SEED), name).cast("binary"))


def _sized(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(*keep, "doc_id", "source", n_words().alias("size"), _order().alias("h"))


def mix(docs: DataFrame, keep: tuple[str, ...] = (), refine: int = REFINE, slack: float = SLACK) -> DataFrame:
    """``keep``, doc_id, size, source_size, target, positions (one for each time it is taken), position (the first) and taken.

    ``docs`` has doc_id, source and text; ``keep`` names further columns to carry, not among those and the result's.
    """
    slim = materialise(_sized(docs, keep).withColumn("uid", F.monotonically_increasing_id()), "sizes")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # null-safe, so that joins stay plain
    slim = slim.withColumn("skey", key).withColumn("bucket", F.substring("h", 1, 3))
    sums = slim.groupBy("source", "skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("skey", key).withColumn("passes", full.cast("long")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).drop("source")

    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).select("skey", "bucket", "base")
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed_rows = slim.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["skey", "bucket"])
    placed_rows = placed_rows.withColumn("cum", F.col("base") + F.col("inside")).drop("base", "inside", "bucket", "source").join(plan, "skey")
    placed_rows = materialise(placed_rows.withColumn("extra", ((F.col("cum") + F.col("size") <= F.col("rest")) & (F.col("size") > 0)).cast("int")), "placed")

    left = placed_rows.groupBy("skey").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("extra") == 1, F.col("size"))), F.lit(0))).alias("gap"), F.max("rest").alias("rest"), F.greatest(slack * F.max("target"), F.avg("size")).alias("near"))
    left = first = materialise(left, "gaps")
    picked = None  # skey, uid and at (what the further pass has taken before it) of those taken a further time beside the front
    free = placed_rows.where("extra = 0 and size > 0").select("skey", "h", "doc_id", "size", "uid")
    for _ in range(refine):
        left, best = _nearest(_untaken(free, picked), left)
        picked = best if picked is None else picked.union(best)
    missed = materialise(left.where(F.abs("gap") > F.col("near")).select("skey"), "missed")  # a row per source at most
    if not missed.isEmpty():
        left = first.join(missed, "skey", "left_semi")
        picked = None if picked is None else picked.join(missed, "skey", "left_anti")
        while not (filled := _front(_untaken(free, picked), left)).isEmpty():
            sums = filled.groupBy("skey").agg(F.sum("size").alias("sum"))
            left = materialise(left.join(sums, "skey", "left").select("skey", (F.col("gap") - F.coalesce("sum", F.lit(0))).alias("gap"), "rest", "near"), "gaps")
            picked = filled.select("skey", "uid", "at") if picked is None else picked.union(filled.select("skey", "uid", "at"))
        _, best = _nearest(_untaken(free, picked), left)
        picked = best if picked is None else picked.union(best)
    if picked is not None:
        placed_rows = placed_rows.join(picked.select("uid", "at", F.lit(1).alias("late")), "uid", "left").withColumn("extra", F.greatest("extra", F.coalesce("late", F.lit(0)))).drop("late")
        placed_rows = placed_rows.withColumn("at", F.coalesce("at", "cum"))
    else:
        placed_rows = placed_rows.withColumn("at", F.col("cum").cast("double"))

    thousandths = lambda x: F.coalesce(F.sum(F.round(x * 1000).cast("long")), F.lit(0))  # noqa: E731  whole numbers, so that sums don't depend on their order
    demand = plan.agg(thousandths(F.col("target")).alias("flat"), thousandths(F.col("target") * _slope(F.col("kind"))).alias("sloped")).first()
    due = lambda t: F.floor((F.lit(float(demand.flat)) * t + F.lit(float(demand.sloped)) * (t * t - t)) / 1000)
    starts = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda j: (j * F.col("source_size") + F.col("cum")).cast("double"))).otherwise(F.array().cast("array<double>"))
    starts = F.when(F.col("extra") == 1, F.concat(starts, F.array(F.col("passes") * F.col("source_size") + F.col("at")))).otherwise(starts)
    done = placed_rows.withColumn("positions", F.transform(starts, lambda x: due(_when((x + F.col("size") / 2) / F.col("target"), F.col("kind")))))
    taken = F.size("positions") * F.col("size")
    return done.select(*keep, "doc_id", "size", "source_size", "target", "positions", F.array_min("positions").alias("position"), taken.alias("taken"))


def _untaken(free: DataFrame, picked: DataFrame | None) -> DataFrame:
    return free if picked is None else free.join(picked.select("uid"), "uid", "left_anti")


def _nearest(free: DataFrame, left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``left`` (skey, gap, rest, near) after the document whose size is nearest to the gap, and that document (skey, uid, at).

    A source that no document brings nearer keeps its gap.
    """
    fits = free.join(left, "skey").where(F.col("size") < 2 * F.col("gap"))
    nearest = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "h", "doc_id", "uid", "size")).alias("b")
    best = materialise(fits.groupBy("skey").agg(nearest, (F.max("rest") - F.max("gap")).alias("at")).select("skey", F.col("b.uid").alias("uid"), F.col("b.size").alias("size"), "at"), "picks")
    after = left.join(best.select("skey", "size"), "skey", "left").select("skey", (F.col("gap") - F.coalesce("size", F.lit(0))).alias("gap"), "rest", "near")
    return after, best.select("skey", "uid", "at")


def _front(free: DataFrame, short: DataFrame) -> DataFrame:
    """skey, uid, size, at of the documents that fit into the gap of their source and stand at the front until their sum fills it."""
    fits = free.join(short, "skey").where(F.col("size") <= F.col("gap")).withColumn("bucket", F.substring("h", 1, 3))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = fits.groupBy("skey", "bucket").agg(F.sum("size").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    summed = fits.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["skey", "bucket"])
    upto = F.col("base") + F.col("inside")
    return materialise(summed.where(upto + F.col("size") <= F.col("gap")).select("skey", "uid", "size", (F.col("rest") - F.col("gap") + upto).alias("at")), "filled")


def _when(share: Column, kind: Column) -> Column:
    """The time at which a source of this kind has met ``share`` of its demand: the inverse of t + slope * (t * t - t)."""
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    slope = _slope(kind)
    root = (slope - 1 + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * y)) / F.when(slope == 0, 1.0).otherwise(2 * slope)
    return F.when(slope == 0, y).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))


def _slope(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SLOPES)), (kind % len(SLOPES) + 1).cast("int"))


def training_order(docs: DataFrame) -> DataFrame:
    """The mixed documents with the columns of ``docs``: each as often as it is taken, range-sorted by training position."""
    names = docs.columns
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    plan = mix(numbered, ("__row",)).select("__row", F.posexplode("positions").alias("__pass", "__position"))
    mixed = numbered.join(plan, "__row")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "__position", "__row").sortWithinPartitions("__position", "__row", "__pass").select(*names)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][kind + 1] AS weight, (2 * source_size)::DOUBLE AS lim FROM r),
o AS (
  SELECT *, lim / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total,
    coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM w),
v AS (SELECT min_by((total - below) / rest_w, ratio) FILTER (WHERE (total - below) / rest_w <= ratio) AS level FROM o),
t AS (SELECT source, source_size, kind, [-0.6::DOUBLE, 0.0::DOUBLE, 0.6::DOUBLE][kind + 1] AS slope, coalesce(least(lim, level * weight), lim) AS target FROM o, v),
demand AS (SELECT sum(round(target * 1000)::BIGINT)::DOUBLE AS flat, sum(round(target * slope * 1000)::BIGINT)::DOUBLE AS sloped FROM t),
p AS (
  SELECT d.*, source_size, target, slope, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, target - passes * source_size AS rest FROM p),
x AS (SELECT *, (cum + size <= rest AND size > 0)::INT AS extra FROM q),
g0 AS (SELECT source, max(rest) - coalesce(sum(size) FILTER (WHERE extra = 1), 0) AS gap, max(rest) AS rest, greatest(0.01 * max(target), avg(size)) AS near FROM x GROUP BY source),
free AS (SELECT source, h, doc_id, size FROM x WHERE extra = 0 AND size > 0),
pick AS (
  SELECT source, 0 AS k, gap, rest, near, []::STRUCT(doc_id BIGINT, since DOUBLE)[] AS docs FROM g0
  UNION ALL
  SELECT source, k + 1, gap - b.size, rest, near, docs || [{'doc_id': b.doc_id, 'since': (rest - gap)::DOUBLE}] FROM (
    SELECT p.source, k, gap, rest, near, docs, min({'off': abs(size - gap), 'h': h, 'doc_id': f.doc_id, 'size': size}) AS b FROM pick p JOIN free f ON f.source IS NOT DISTINCT FROM p.source
    WHERE k < 3 AND size < 2 * gap AND NOT list_contains(list_transform(docs, lambda d: d.doc_id), f.doc_id) GROUP BY ALL)),
picked AS (SELECT * FROM pick QUALIFY k = max(k) OVER (PARTITION BY source)),
fill AS (
  SELECT g0.source, 0 AS k, g0.gap, g0.rest, []::STRUCT(doc_id BIGINT, since DOUBLE)[] AS docs FROM g0 JOIN picked p ON p.source IS NOT DISTINCT FROM g0.source WHERE abs(p.gap) > p.near
  UNION ALL
  SELECT source, k + 1, gap - sum(size), rest, docs || list({'doc_id': doc_id, 'since': (rest - gap + upto)::DOUBLE}) FROM (
    SELECT p.source, k, gap, rest, docs, f.doc_id, size, sum(size) OVER (PARTITION BY p.source ORDER BY h, f.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS upto FROM fill p JOIN free f ON f.source IS NOT DISTINCT FROM p.source
    WHERE size <= gap AND NOT list_contains(list_transform(docs, lambda d: d.doc_id), f.doc_id))
  WHERE upto + size <= gap GROUP BY source, k, gap, rest, docs),
filled AS (SELECT * FROM fill QUALIFY k = max(k) OVER (PARTITION BY source)),
last AS (
  SELECT min({'off': abs(size - gap), 'h': h, 'doc_id': f.doc_id}) AS b, any_value(rest - gap) AS since FROM filled p JOIN free f ON f.source IS NOT DISTINCT FROM p.source
  WHERE size < 2 * gap AND NOT list_contains(list_transform(docs, lambda d: d.doc_id), f.doc_id) GROUP BY p.source),
late AS (
  SELECT d.doc_id AS doc_id, d.since AS since FROM (SELECT unnest(docs) AS d FROM picked WHERE abs(gap) <= near UNION ALL SELECT unnest(docs) FROM filled) UNION ALL SELECT b.doc_id, since::DOUBLE FROM last),
y AS (
  SELECT x.*, since IS NOT NULL OR extra = 1 AS further,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CASE WHEN passes > 0 OR extra = 1 THEN cum::DOUBLE ELSE since END + size / 2.0::DOUBLE) / target)) AS share FROM x LEFT JOIN late ON x.doc_id = late.doc_id),
z AS (
  SELECT *, CASE WHEN slope = 0 THEN share
    ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope))) END AS time FROM y)
SELECT doc_id, size, source_size, round(target, 6) AS target, ((passes + further::INT) * size)::BIGINT AS taken,
  CASE WHEN passes > 0 OR further THEN floor((flat * time + sloped * (time * time - time)) / 1000)::BIGINT END AS position
FROM z, demand
"""
