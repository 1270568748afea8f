"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1, given by its values at evenly spaced knots and linear between
them. Its integral is the share of the source's words that training has asked for until then (cumulative token demand).
The words of a source form a stream: its documents in a fixed shuffled order, again and again. A copy of a document whose
middle lies at word m of the stream, with the source's target t, is taken if m < t, and its training position is the time
at which the cumulative demand reaches m / t: the inverse of the integral, in closed form. Sorting by position (a range
sort) gives the training order.

Scale: sizes are counted once and written with a key per row; only those few numbers move until all positions are known. The running
sums have two levels, buckets of the shuffled order and rows within a bucket, so that a source with a third of all rows is
spread over as many tasks as its rows need. For an output of whole documents texts move twice: to their positions, by key,
and in the range sort.

Cases: a null text has size 0; a null source is a source of its own, the last; rows with the same id are different rows,
told apart by their size and text, and rows that are equal in all columns by a number within them; a source without words has
target 0 and no copies; an empty table gives an empty result; ordered() reads docs twice, so it has to be a table or files, and
gives all its columns as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, materialize, n_words, packed, row_key, table, text_of, unpacked

#: Values at the knots, by the source's place in order modulo their number: early, even and late sources.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Most times that a document is used.
MOST = 3
#: Documents of a source in a bucket of its order, about.
BUCKET = 4096


def integrals(values: Sequence[float]) -> list[float]:
    """Cumulative demand at the knots, 1 at the end."""
    step, at = 1 / (len(values) - 1), [0.0]
    for a, b in zip(values, values[1:]):
        at.append(at[-1] + step * (a + b) / 2)
    return [x / at[-1] for x in at]


def position(share: Column, values: Sequence[float]) -> Column:
    """The time at which the cumulative demand of a schedule is the share: a root of a quadratic in each piece."""
    at, n = integrals(values), len(values) - 1
    area = sum((a + b) / 2 for a, b in zip(values, values[1:])) / n
    out = F.lit(1.0)
    for k in reversed(range(n)):
        a, slope, rest = values[k] / area, (values[k + 1] - values[k]) * n / area, share - at[k]
        root = F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * rest))
        out = F.when(share < at[k + 1], k / n + 2 * rest / F.greatest(a + root, F.lit(1e-12))).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def targets(sources: DataFrame, weights: Sequence[int], most: int = MOST) -> DataFrame:
    """sources (source, source_size, n_docs), a row each: adds place, weight and target.

    The level of the water: sources in the order in which they reach their cap; the first at which the level that is
    left for it and all later ones doesn't pass its cap stays below it, as do the later ones."""
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    capped = W.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = capped.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    return (
        sources.withColumn("place", F.row_number().over(ordered) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("_cap", most * F.col("source_size").cast("double"))
        .withColumn("_left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.when(F.col("weight") * (F.col("_left") / F.col("_weights")) <= F.col("_cap"), F.struct(F.col("_weights").alias("w"), F.col("_left").alias("l"))))
        .withColumn("_level", F.max("_level").over(everything))  # the first that fits has the largest weights left
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("weight") * (F.col("_level.l") / F.col("_level.w")), F.col("_cap"))))
        .select("source", "source_size", "n_docs", "place", "target")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """_m (a row's columns) and its key."""
    rows = packed(docs)
    return rows.withColumn("key", row_key(F.col("_m"), rows.schema["_m"].dataType))


def _sized(docs: DataFrame) -> DataFrame:
    """key, doc_id, source, size, and what orders the documents of a source, written to the shared folder."""
    m = F.col("_m")
    rows = _keyed(docs).select("key", m.doc_id.alias("doc_id"), m.source.alias("source"), F.coalesce(m.text, F.lit("")).alias("text"))
    return materialize(rows.select("key", "doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("turn"), F.md5("text").alias("tie")))


def _placed(sized: DataFrame, weights: Sequence[int], schedules: Sequence[Sequence[float]], most: int) -> DataFrame:
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most)
    wide = F.ceil(F.log2(F.greatest(F.col("n_docs") / BUCKET, F.lit(1.0))))  # bits of the turn that tell buckets apart, 28 at most
    rows = sized.join(wanted.withColumnRenamed("source", "_source").withColumn("_bits", F.least(wide, F.lit(28)).cast("int")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("turn", 1, 7), 16, 10).cast("double") / F.pow(F.lit(2.0), 28 - F.col("_bits"))).cast("int"))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_in")).select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_in").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = W.partitionBy("source", "_bucket").orderBy("turn", "size", "tie", "key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_at", F.col("_in") + F.col("_before") + F.col("size") / 2)
    middles = F.filter(F.transform(F.array(*[F.lit(k) for k in range(most)]), lambda k: F.col("_at") + k * F.col("source_size")), lambda m: m < F.col("target"))

    def times(share: Column) -> Column:
        out = position(share, schedules[-1])
        for k, values in enumerate(schedules[:-1]):
            out = F.when(F.col("place") % len(schedules) == k, position(share, values)).otherwise(out)
        return out

    rows = rows.withColumn("_middles", middles)
    return rows.select(
        "key", "doc_id", "source", "size", "source_size", "target", F.size("_middles").cast("bigint").alias("copies"), (F.size("_middles") * F.col("size")).cast("bigint").alias("taken"),
        F.transform("_middles", lambda m: times(m / F.col("target"))).alias("positions"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), schedules: Sequence[Sequence[float]] = SCHEDULES, most: int = MOST) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, taken, positions (of each copy)."""
    return _placed(_sized(docs), weights, schedules, most).drop("key")


def ordered(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), schedules: Sequence[Sequence[float]] = SCHEDULES, most: int = MOST) -> DataFrame:
    """The mix itself: the documents' rows, as often as taken, range-sorted by training position."""
    sized = _sized(docs)
    each = _placed(sized, weights, schedules, most).groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list("positions")).alias("_each"))  # as many as there are equal rows
    each = materialize(each.where(F.exists("_each", lambda x: F.size(x) > 0)))
    forget(sized)
    rows = _keyed(docs).join(each, F.col("key") == F.col("_key"))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("key")))
    rows = rows.select("_m", "key", F.posexplode(F.get("_each", F.col("_n") - 1)).alias("_copy", "_position"))
    return unpacked(rows.orderBy("_position", F.col("_m.doc_id"), "_copy", "key"), docs.columns)


def op9_curriculum(spark, sf_dir: str) -> DataFrame:
    """Documents in the order in which training first meets them, those that aren't taken last."""
    out = mix(table(spark, sf_dir, "documents"))
    at = [F.round(F.get("positions", F.lit(k)), 9).alias(f"position_{k + 1}") for k in range(MOST)]
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", *at).orderBy(F.col("position_1").asc_nulls_last(), "doc_id")


def sql_position(share: str, values: Sequence[float]) -> str:
    """position() as SQL."""
    at, n = integrals(values), len(values) - 1
    area = sum((a + b) / 2 for a, b in zip(values, values[1:])) / n
    out = "1.0::DOUBLE"
    for k in reversed(range(n)):
        a, slope, rest = values[k] / area, (values[k + 1] - values[k]) * n / area, f"({share} - {at[k]!r}::DOUBLE)"
        out = f"CASE WHEN {share} < {at[k + 1]!r}::DOUBLE THEN {k / n!r}::DOUBLE + 2 * {rest} / greatest({a!r}::DOUBLE + sqrt(greatest(0.0::DOUBLE, {a * a!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest})), 1e-12::DOUBLE) ELSE {out} END"
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {out}))"


def _sql_positions() -> str:
    out = []
    for k in range(MOST):
        middle = f"(middle + {k} * source_size)"
        cases = " ".join(f"WHEN place % {len(SCHEDULES)} = {i} THEN {sql_position(f'({middle} / target)', v)}" for i, v in enumerate(SCHEDULES))
        out.append(f"CASE WHEN {middle} < target THEN round(CASE {cases} END, 9) END AS position_{k + 1}")
    return ",\n       ".join(out)


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key, md5(coalesce(text, '')) AS tie
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sources),
weighed AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, 3 * source_size::DOUBLE AS cap FROM placed),
levels AS (
  SELECT *, sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER before, 0) AS remaining, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT remaining, weights FROM levels WHERE weight * (remaining / weights) <= cap ORDER BY weights DESC LIMIT 1),
targets AS (SELECT source, source_size, place, least(cap, coalesce(weight * ((SELECT remaining FROM chosen) / (SELECT weights FROM chosen)), cap)) AS target FROM weighed),
rows_at AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((middle < target)::BIGINT + (middle + source_size < target)::BIGINT + (middle + 2 * source_size < target)::BIGINT) * size AS taken,
       (middle < target)::BIGINT + (middle + source_size < target)::BIGINT + (middle + 2 * source_size < target)::BIGINT AS copies,
       POSITIONS
FROM rows_at
""".replace("POSITIONS", _sql_positions())
