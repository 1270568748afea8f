"""How many intervals are open at a time, and with what weight, by group: a sweep over dense difference arrays.

Each interval adds to its group's array at its begin and takes away at its end. Time is cut into chunks of SLOTS slots of GRAIN
seconds; a group's chunk (a cell) is a dense array indexed by slot. A task bins what its rows bring into such arrays and passes on
the slots that aren't zero; what all tasks have for a cell is binned again, and its running sums and their maximum are taken.
Chunks know nothing of what was open before them: each one's totals are carried to the next ones, a row a cell.

Scale: intervals move for the joins only (their hot keys have a written, aggregated side, so Spark splits them); after that a task sends at most
SLOTS numbers a cell and flush, however many intervals it has seen, so a group with a third of all rows is as much as any other. A cell
is summed by one task as a stream. The carry is a window over cells by group: as many rows as the time has chunks.

Cases: a null begin, or an end that isn't after it, takes no part; a null end is never; a null weight is 0; a null or unknown group is
-1; every interval counts once more for the group ALL. Equal rows count each. Of several rows of a client the least nation counts.
An empty table gives an empty result; other columns are ignored. Times may be with or without a zone (then they are UTC)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

GRAIN, SLOTS = 60, 1440
#: The group of all intervals, and that of those without one.
ALL, NONE = -2, -1
#: Changes that a task bins at once.
FLUSH = 1 << 19


def slot_of(df: DataFrame, name: str) -> Column:
    """Which slot since 1970 (UTC) a time is in, whatever the session's zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        seconds = F.expr(f"cast(cast(`{name}` - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS decimal(38, 6))")
        return F.floor(F.floor(seconds) / GRAIN).cast("bigint")
    return F.floor(F.unix_seconds(F.col(name)) / GRAIN).cast("bigint")


def binned(slots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Dense sums by slot, exact for 64-bit integers: the upper and lower halves are counted apart."""
    low = np.bincount(slots, (values & 0xFFFFFFFF).astype(np.float64), SLOTS)
    high = np.bincount(slots, (values >> 32).astype(np.float64), SLOTS)
    return low.astype(np.int64) + (high.astype(np.int64) << 32)


SPARSE = pa.schema([("grp", pa.int32()), ("chunk", pa.int64()), ("slots", pa.list_(pa.int16())), ("n", pa.list_(pa.int64())), ("weight", pa.list_(pa.int64()))])
SPARSE_DDL = "grp int, chunk bigint, slots array<smallint>, n array<bigint>, weight array<bigint>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def differences(intervals: DataFrame) -> DataFrame:
    """intervals (grp, begin, stop: slots, weight): per task, flush and cell the slots whose count or weight changes."""

    def cells(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        grp, slot, n, weight = (np.concatenate(x) for x in zip(*parts))
        chunk = slot // SLOTS
        order = np.lexsort((chunk, grp))
        grp, chunk, slot, n, weight = grp[order], chunk[order], (slot - chunk * SLOTS)[order], n[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(grp) != 0) | (np.diff(chunk) != 0)]))
        out = []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(grp)]):
            dn, dw = binned(slot[i:j], n[i:j]), binned(slot[i:j], weight[i:j])
            some = np.flatnonzero((dn != 0) | (dw != 0))
            if len(some):
                out.append((grp[i], chunk[i], some.astype(np.int16), dn[some], dw[some]))
        g, c, s, dn, dw = zip(*out) if out else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array(np.array(g, np.int32)), pa.array(np.array(c, np.int64)), _lists(list(s), pa.int16()), _lists(list(dn), pa.int64()), _lists(list(dw), pa.int64())], schema=SPARSE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            grp, begin, weight = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            ends = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            stop = b.column(2).fill_null(0).to_numpy(zero_copy_only=False)[ends]
            slot, n = np.concatenate([begin, stop]), np.concatenate([np.ones(len(begin), np.int64), np.full(len(stop), -1, np.int64)])
            w, g = np.concatenate([weight, -weight[ends]]), np.concatenate([grp, grp[ends]])
            held += [(g, slot, n, w), (np.full(len(g), ALL, g.dtype), slot, n, w)]
            size += 2 * len(g)
            if size >= FLUSH:
                yield cells(held)
                held, size = [], 0
        if size:
            yield cells(held)

    return intervals.select("grp", "begin", "stop", "weight").mapInArrow(run, SPARSE_DDL)


LOCAL = "grp int, chunk bigint, slot bigint, next bigint, n bigint, weight bigint, high bigint"


def swept(changes: DataFrame) -> DataFrame:
    """grp, chunk, slot, next, n, weight, high: the slots with a change, the next one in the same cell, and the running sums and the largest count
    so far, all as if nothing had been open before the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, n, weight = None, np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)

        def out() -> pa.RecordBatch:
            some = np.flatnonzero((n != 0) | (weight != 0))
            open_ = np.cumsum(n)[some]
            at = some + cell[1] * SLOTS
            following = pa.array(np.append(at[1:], 0)[: len(at)], mask=np.arange(len(at)) == len(at) - 1)
            columns = [np.full(len(some), cell[0], np.int32), np.full(len(some), cell[1], np.int64), at, following, open_, np.cumsum(weight)[some], np.maximum.accumulate(open_) if len(some) else open_]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in LOCAL.split(", ")])

        for b in batches:
            values = [b.column(k).flatten().to_numpy() for k in (2, 3, 4)]
            sizes = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy())])
            for k, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if key != cell:
                    if cell is not None:
                        yield out()
                    cell, n, weight = key, np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
                at, dn, dw = (v[sizes[k] : sizes[k + 1]] for v in values)
                n += binned(at, dn)
                weight += binned(at, dw)
        if cell is not None:
            yield out()

    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return changes.repartition(parts, "grp", "chunk").sortWithinPartitions("grp", "chunk").mapInArrow(run, LOCAL)


def concurrency(intervals: DataFrame) -> DataFrame:
    """intervals (grp int, begin, stop: slots, weight long): grp, slot, next, n, weight, high, peak: a row a group and slot in which
    its count or weight changes; next is the group's next such slot, high its largest count so far, peak whether weight is its largest."""
    local = materialize(swept(differences(intervals.where("begin IS NOT NULL AND (stop IS NULL OR stop > begin)"))))
    cells = local.groupBy("grp", "chunk").agg(F.max_by("n", "slot").alias("n"), F.max_by("weight", "slot").alias("w"), F.max("n").alias("most"), F.max("weight").alias("heaviest"), F.min("slot").alias("first"))
    by = W.partitionBy("grp").orderBy("chunk")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumns({"_n": F.coalesce(F.sum("n").over(before), F.lit(0)), "_w": F.coalesce(F.sum("w").over(before), F.lit(0)), "_next": F.lead("first").over(by)})
    cells = cells.withColumns({"_high": F.max(F.col("_n") + F.col("most")).over(before), "_peak": F.max(F.col("_w") + F.col("heaviest")).over(W.partitionBy("grp"))})
    cells = materialize(cells.select(F.col("grp").alias("_grp"), F.col("chunk").alias("_chunk"), "_n", "_w", "_next", "_high", "_peak"))
    rows = local.join(cells.hint("merge"), (F.col("grp") == F.col("_grp")) & (F.col("chunk") == F.col("_chunk")))
    weight = F.col("weight") + F.col("_w")
    return rows.select("grp", "slot", F.coalesce("next", "_next").alias("next"), (F.col("n") + F.col("_n")).alias("n"), weight.alias("weight"), F.greatest("_high", F.col("_n") + F.col("high")).alias("high"), (weight == F.col("_peak")).alias("peak"))


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, days: int = 7) -> DataFrame:
    """grp, begin, stop, weight: from when a sale is made until some days after its first line is shipped, in its client's nation, with
    its total in cents."""
    shipped = materialize(lines.groupBy(F.col("sale_id").alias("_sale")).agg(F.min("shipped_at").alias("_shipped")).where("_sale IS NOT NULL AND _shipped IS NOT NULL"))
    home = materialize(clients.where("client_id IS NOT NULL").groupBy(F.col("client_id").alias("_client")).agg(F.min("nation_id").cast("int").alias("_nation")))
    cents = F.floor(F.coalesce(F.col("total").cast("double"), F.lit(0.0)) * 100 + F.lit(0.5)).cast("bigint")
    rows = sales.where("sold_at IS NOT NULL").select("sale_id", "client_id", slot_of(sales, "sold_at").alias("begin"), cents.alias("weight"))
    stop = (slot_of(shipped, "_shipped") + days * 86400 // GRAIN).alias("stop")
    rows = rows.join(shipped.select("_sale", stop).hint("merge"), F.col("sale_id") == F.col("_sale"), "left")
    rows = rows.where("stop IS NULL OR stop > begin").select("client_id", "begin", "stop", "weight")
    return rows.join(home.hint("merge"), F.col("client_id") == F.col("_client"), "left").select(F.coalesce("_nation", F.lit(NONE)).alias("grp"), "begin", "stop", "weight")


def op12_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sales of a nation are open, from when to when, and what they are worth."""
    out = concurrency(open_sales(*[table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clients")]))
    return out.select(
        F.col("grp").alias("nation_id"), (F.col("slot") * GRAIN).alias("from_s"), (F.col("next") * GRAIN).alias("to_s"), F.col("n").alias("n_open"), F.col("weight").alias("open_cents"),
        F.col("high").alias("high_open"), F.col("peak").alias("is_peak"),
    )


OP12_SQL = """WITH shipped AS (SELECT sale_id, min(shipped_at) AS shipped_at FROM sale_lines GROUP BY sale_id),
home AS (SELECT client_id, min(nation_id) AS nation_id FROM clients GROUP BY client_id),
every AS (
  SELECT coalesce(h.nation_id, -1)::INTEGER AS nation_id, (floor(epoch_us(s.sold_at) / 60000000) * 60)::BIGINT AS begin_s, (floor(epoch_us(l.shipped_at) / 60000000) * 60)::BIGINT + 604800 AS stop_s,
    coalesce(floor(100 * s.total + 0.5), 0)::BIGINT AS cents
  FROM sales s LEFT JOIN shipped l ON l.sale_id = s.sale_id LEFT JOIN home h ON h.client_id = s.client_id WHERE s.sold_at IS NOT NULL),
part AS (SELECT * FROM every WHERE stop_s IS NULL OR stop_s > begin_s),
twice AS (SELECT * FROM part UNION ALL SELECT -2, begin_s, stop_s, cents FROM part),
changes AS (SELECT nation_id, begin_s AS t, 1 AS n, cents FROM twice UNION ALL SELECT nation_id, stop_s, -1, -cents FROM twice WHERE stop_s IS NOT NULL),
moments AS (SELECT nation_id, t, sum(n) AS n, sum(cents) AS cents FROM changes GROUP BY nation_id, t HAVING sum(n) <> 0 OR sum(cents) <> 0),
open_ AS (SELECT nation_id, t, lead(t) OVER w AS to_s, sum(n) OVER w AS n, sum(cents) OVER w AS cents FROM moments WINDOW w AS (PARTITION BY nation_id ORDER BY t))
SELECT nation_id, t AS from_s, to_s, n::BIGINT AS n_open, cents::BIGINT AS open_cents, max(n::BIGINT) OVER (PARTITION BY nation_id ORDER BY t) AS high_open, cents = max(cents) OVER (PARTITION BY nation_id) AS is_peak FROM open_"""
