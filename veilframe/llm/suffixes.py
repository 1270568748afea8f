"""Repeated strings by a distributed merge sort of suffixes that knows common prefixes.

Every byte that a string of LENGTH bytes covers goes if the string also starts somewhere else, in any document. Strings that
are equal stand next to each other among the sorted suffixes, so it is enough to sort suffixes and look at the common prefix of
neighbours. Each task sorts what its documents bring into runs (equal ones become one), which are written in
front-coded blocks: how much a suffix shares with the one before, and the rest (compressed). Runs are cut at the limits of ranges of the order, which
are a sample, so that each block belongs to one range and goes there once. A range merges its runs by a loser tree whose players carry the length of what they share with
the last winner: the longer one wins, only equal lengths need comparing, and only from there on. The merge alone decides what is repeated.

Hashes leave out what can't have a twin, and tell which neighbouring suffixes go together as one key:
1. A string has an anchor, the least (leftmost) hash of its GRAM-byte substrings. Equal strings have equal anchors at equal
   places, so strings whose anchor's hash occurs once are unique.
2. The strings that share an anchor's occurrence are a span. Spans whose hash (128 bits of it) occurs twice go to the sort whole, as suffixes
   cut behind their last string: where two are equal, all strings of both are repeated. Where an anchor's hash has several such
   hashes, one span of each goes on, as its strings may have twins in the others.
3. Those spans are cut into blocks of STARTS starts, at fixed distances from the anchor. The bytes that all strings of a block
   share are its core; where the core's hash occurs once, none of its strings has a twin. Blocks whose hash occurs twice go to the sort whole,
   as spans do, and if a core has several hashes, the suffixes of one block of each go there one by one, cut after LENGTH bytes.

Scale: texts are shuffled once, into a table bucketed by row number, which all steps read in place; the rest moves hashes and places.
Runs collapse equal suffixes, so a string that a third of all documents share comes to a range once per run. Ranges are made
so that each has about RANGE * CODED suffixes at any size: limits that come to the driver are bounded, beyond them each range is cut again by the order of
its own blocks, and blocks that reach over such a cut are divided there. So every suffix is moved once, or twice. A document's spans come together by its row number, bounded by its length.

Cases: null is the empty text; texts shorter than LENGTH keep everything; rows with equal ids are documents of their own (so equal
texts of LENGTH bytes or more go entirely); an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, materialize, shared_dir, slices, table, tidy

LENGTH, GRAM, STARTS = 400, 64, 8
#: Kinds of keys in the sort: a suffix cut after LENGTH bytes, a whole block, a whole span.
SUFFIX, WHOLE, SPAN = b"\x00", b"\x01", b"\x02"
#: Suffixes in a front-coded block, full blocks in a range (about), most limits that come to the driver,
#: and bytes whose anchors are found at once (fewer than 2^28, as places are packed beside hashes).
CODED, RANGE, LIMITS, PART = 256, 192, 5000, 1 << 24
#: Bytes of keys in a run.
MEMORY = 48_000_000

_rng = np.random.default_rng(8_080)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[-1][0]) <= n:
        base, size = int(BASE), 1 << max(12, int(n).bit_length())
        _POWERS[:] = [tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))]
    return _POWERS[-1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any substrings of some bytes, or of a sequence of 64-bit numbers."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((BYTE[raw] if raw.dtype == np.uint8 else raw) * up[: len(raw)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def anchors(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM, most: int = PART) -> tuple[np.ndarray, ...]:
    """document, place of the anchor, first and last start of the strings that it stands for (all within the document), hash of
    the anchor, hash of all bytes of the strings. More than `most` bytes are taken in parts that share length - 1 bytes, so each string
    is in one of them; an anchor's strings may so be in two rows."""
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    if len(raw) < length:
        return none
    if len(raw) > (most := max(most, length)):
        found = []
        for p in range(0, len(raw) - length + 1, most - length + 1):
            here = np.clip(at - p, 0, min(most, len(raw) - p))
            doc, a, lo, hi, h, w = anchors(raw[p : p + most], here, length, gram, most)
            moved = p + here[doc] - at[doc]
            found.append((doc, a + moved, lo + moved, hi + moved, h, w))
        return tuple(np.concatenate(x) for x in zip(*found))
    h = Hashes(raw)
    begin = np.arange(len(raw) - gram + 1)
    grams = h.of(begin, begin + gram)
    least = grams & ~np.uint64(0xFFFFFFF) | begin.astype(np.uint64)
    wide, size = length - gram + 1, 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if wide > size:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    fits = np.zeros(len(raw) + 1, np.int8)  # starts of strings that end within their document
    long = np.diff(at) >= length
    fits[at[:-1][long]] += 1
    fits[at[1:][long] - length + 1] -= 1
    fits = np.cumsum(fits)[: len(least)] > 0
    new = fits.copy()
    new[1:] &= ~fits[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(new)
    if not len(start):
        return none
    stop = fits.copy()
    stop[:-1] &= ~fits[1:] | (least[1:] != least[:-1])
    place = (least[start] & np.uint64(0xFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(at, start, "right") - 1
    last = np.flatnonzero(stop)
    return doc, place - at[doc], start - at[doc], last - at[doc], grams[place], h.of(start, last + length)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: texts dealt by row number into a bucketed table in the shared folder."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    name = f"texts_{uuid.uuid4().hex}"
    with tidy(spark):
        rows.repartition(parts, "row").write.bucketBy(parts, "row").option("path", shared_dir(spark)).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name alone: files with a path of their own stay, and out has found them
    return out


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """row, a, lo, hi (all within the text), h, w: the anchors whose hash h occurs more than once; w is the hash of their span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, 1, 2000, 1_500_000):
                doc, a, lo, hi, h, w = anchors(*joined(some.column(1)))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(doc)), *[pa.array(x.astype(np.int32)) for x in (a, lo, hi)], pa.array(h.view(np.int64)), pa.array(w.view(np.int64))], names=["row", "a", "lo", "hi", "h", "w"])

    found = materialize(texts.select("row", "text").mapInArrow(run, "row long, a int, lo int, hi int, h long, w long"))
    twice = materialize(found.groupBy("h").count().where("count > 1").select(F.col("h").alias("_h")))  # a written side: the join can split a hot hash
    out = materialize(found.join(twice, F.col("h") == F.col("_h"), "left_semi"))
    for done in (found, twice):
        forget(done)
    return out


def span_classes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """twice (row, lo, hi): spans whose hash another one has; and mixed (row, spans: array<struct<a, lo, hi>>): one span of each hash
    where an anchor's hash has several."""
    key = [F.col("h"), F.col("w"), (F.col("lo") - F.col("a")).alias("x"), (F.col("hi") - F.col("lo")).alias("y")]
    keyed = found.select("row", "a", "lo", "hi", *key)
    classes = materialize(keyed.groupBy("h", "w", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("row", "a", "lo", "hi")).alias("one")))
    several = materialize(classes.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("k")).where("k > 1").select("_h"))
    many = classes.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in "hwxy"])
    twice = materialize(keyed.join(many, (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left_semi").select("row", "lo", "hi"))
    mixed_up = materialize(classes.join(several, F.col("h") == F.col("_h"), "left_semi").groupBy("one.row").agg(F.collect_list(F.struct("one.a", "one.lo", "one.hi")).alias("spans")))
    for done in (classes, several):
        forget(done)
    return twice, mixed_up


def _spans(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document of each span, and the spans' fields."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten()
    fields = values.flatten() if pa.types.is_struct(values.type) else [values]
    return np.repeat(np.arange(len(column)), sizes), [f.to_numpy(zero_copy_only=False) for f in fields]


def blocks(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """row, st, core, f: the blocks of spans, with the hashes of core and whole; a block that a document's end cuts has a whole of
    its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, 1, 2000, 1_500_000):
                raw, at = joined(some.column(1))
                doc, fields = _spans(some.column(2))
                a, lo, hi = (x.astype(np.int64) for x in fields)
                first, last = (lo - a) // STARTS, (hi - a) // STARTS
                n = last - first + 1
                doc, k = np.repeat(doc, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                st = np.repeat(a, n) + (np.repeat(first, n) + k) * STARTS
                doc, st = np.divmod(np.unique((doc << 40) + st + STARTS), 1 << 40)  # each once
                st -= STARTS
                begin, end = at[doc], at[doc + 1]
                h = Hashes(raw)
                core = h.of(begin + st + STARTS - 1, begin + st + LENGTH)
                whole = (st >= 0) & (begin + st + LENGTH + STARTS - 1 <= end)
                x, y = np.maximum(begin + st, begin), np.minimum(begin + st + LENGTH + STARTS - 1, end)
                row = some.column(0).to_numpy()[doc]
                own = mixed(row.astype(np.uint64) * BASE + st.astype(np.uint64))
                f = np.where(whole, h.of(x, y), own)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(st.astype(np.int32)), *[pa.array(v.view(np.int64)) for v in (core, f)]], names=["row", "st", "core", "f"])

    return texts.select("row", "text").join(spans, "row").select("row", "text", "spans").mapInArrow(run, "row long, st int, core long, f long")


def shared_prefix(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix of two byte strings that agree in the first `at` bytes."""
    n, step = min(len(x), len(y)), 16
    while at + step <= n and x[at : at + step] == y[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        while at + step <= n and x[at : at + step] == y[at : at + step]:
            at += step
    return at


def front_coded(run: list[tuple[bytes, int, int, int]], size: int = CODED) -> Iterator[tuple]:
    """A sorted run (key, row, lo, hi) in blocks: number, first and last key, lengths shared, lengths, rows, los, his, the rest of each."""
    for k in range(0, len(run), size):
        some, before, shared, rest = run[k : k + size], b"", [], []
        for s, *_ in some:
            n = shared_prefix(before, s, 0)
            shared.append(n)
            rest.append(s[n:])
            before = s
        columns = [np.array(shared, "<u2"), np.array([len(x[0]) for x in some], "<u2"), np.array([x[1] for x in some], "<i8"), np.array([x[2] for x in some], "<i4"), np.array([x[3] for x in some], "<i4")]
        yield k // size, some[0][0], some[-1][0], *columns, b"".join(rest)


def decoded(shared: np.ndarray, lengths: np.ndarray, rest: bytes) -> Iterator[tuple[int, bytes]]:
    """Keys of a block, each with what it shares with the one before."""
    at, before = 0, b""
    for n, length in zip(shared.tolist(), lengths.tolist()):
        before = before[:n] + rest[at : at + length - n]
        at += length - n
        yield n, before


def merged(runs: list[Iterator[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Runs (shared with the one before, suffix, what) merged by a loser tree; each suffix comes with what it shares with the one before.

    A player's length is what it shares with the last winner that passed it, so of two players the one with the longer wins,
    and only at equal lengths the rest is compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    shared, text, what = [-1] * k, [b""] * k, [None] * k

    def advance(r: int) -> None:
        got = next(runs[r], None) if r < len(runs) else None
        shared[r], text[r], what[r] = got if got else (-1, b"", None)  # a run at its end loses always

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's length becomes what it shares with the winner."""
        a, b = shared[x], shared[y]
        if a != b:
            return (x, y) if a > b else (y, x)
        if a < 0:
            return x, y
        n = shared_prefix(text[x], text[y], a)
        if text[x][n:] <= text[y][n:]:
            shared[y] = n
            return x, y
        shared[x] = n
        return y, x

    for r in range(k):
        advance(r)
        if shared[r] >= 0:
            shared[r] = 0
    loser, winners = [0] * k, [*range(k)]
    level = k
    while level > 1:  # the first tournament
        pairs = []
        for i in range(0, level, 2):
            w, lost = play(winners[i], winners[i + 1])
            loser[(level + i) // 2] = lost
            pairs.append(w)
        winners, level = pairs, level // 2
    top = winners[0]
    while shared[top] >= 0:
        yield shared[top], text[top], what[top]
        advance(top)
        node = (k + top) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


RUNS = "part int, run long, no int, low binary, high binary, shared binary, lengths binary, rows binary, los binary, his binary, rest binary"


def arrow_blocks(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 8)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=[x.split()[0] for x in RUNS.split(", ")])


def cut(run: list[tuple[bytes, int, int, int]], limits: list[bytes]) -> Iterator[tuple[int, list]]:
    """The parts of a sorted run that lie between limits: number of the range (that of all keys below the first limit is 0), keys."""
    at = 0
    while at < len(run):
        part = bisect_right(limits, run[at][0])
        stop = len(run) if part == len(limits) else bisect_left(run, (limits[part],), at)
        yield part, run[at:stop]
        at = stop


def sorted_runs(texts: DataFrame, wanted: DataFrame, limits: list[bytes]) -> DataFrame:
    """wanted: row, keys: array<struct<kind, lo, hi>>. Runs of the keys: front-coded blocks, each of one range, and rows without a number for keys
    that occur twice within a run already (in any range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, size = TaskContext.get().partitionId(), 0, 0
        held: dict[bytes, tuple[int, int, int]] = {}
        twice: list[tuple[int, int, int]] = []

        def made():
            nonlocal count, size
            name = part + (count << 24)
            whole = sorted((s, *what) for s, what in held.items())
            out = [(own, name, no, low, high, *[x.tobytes() for x in columns], zstandard.compress(rest)) for own, some in cut(whole, limits) for no, low, high, *columns, rest in front_coded(some)]
            if twice:
                out.append(((name * 0x9E3779B1 >> 8) % (len(limits) + 1), name, None, None, None, None, None, *[np.array(x, t).tobytes() for x, t in zip(zip(*twice), ("<i8", "<i4", "<i4"))], None))
            count, size = count + 1, 0
            held.clear()
            twice.clear()
            return arrow_blocks(out)

        def add(s: bytes, *what: int):
            nonlocal size
            if s in held:
                twice.extend((what, held[s]))
            else:
                held[s] = what
                size += len(s)

        for b in batches:
            rows, data = b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())
            doc, (kinds, los, his) = _spans(b.column(2))
            ends = np.searchsorted(doc, np.arange(len(rows) + 1))
            for k, row in enumerate(rows):
                text, these = data[k].as_py(), slice(ends[k], ends[k + 1])
                kind, lo, hi = kinds[these], los[these], his[these]
                single = kind == 0
                starts = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(lo[single].tolist(), hi[single].tolist())])) if single.any() else lo[:0]
                for t in starts[(starts >= 0) & (starts <= len(text) - LENGTH)].tolist():
                    add(SUFFIX + text[t : t + LENGTH], row, t, t)
                    if size > MEMORY:
                        yield made()
                for which, x, y in zip(kind[~single].tolist(), lo[~single].tolist(), hi[~single].tolist()):
                    add((WHOLE if which == 1 else SPAN) + text[x : y + LENGTH], row, x, y)
                    if size > MEMORY:  # a run's memory is bounded
                        yield made()
        if held:
            yield made()

    return texts.select("row", "text").join(wanted, "row").select("row", "text", "keys").mapInArrow(run, RUNS)


def limits_of(texts: DataFrame, wanted: DataFrame) -> tuple[int, list[bytes]]:
    """Ranges for the keys of sorted_runs(), and at most LIMITS of their limits, about: keys chosen by a hash, which only balance the work."""
    spark = texts.sparkSession
    weight = F.aggregate("keys", F.lit(0).cast("bigint"), lambda acc, k: acc + F.when(k["kind"] == 0, STARTS).otherwise(1))
    n = wanted.agg(F.sum(weight)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (RANGE * CODED) + 1)
    share = int(min(1.0, min(LIMITS, 30 * ranges) / max(1, n)) * (1 << 30))
    some = wanted.select("row", F.filter("keys", lambda k: F.pmod(F.xxhash64("row", k["lo"], k["kind"]), 1 << 30) < share).alias("keys")).where(F.size("keys") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, (doc, (kinds, los, his)) = b.column(1).cast(pa.large_binary()), _spans(b.column(2))
            out = []
            for d, kind, lo, hi in zip(doc.tolist(), kinds.tolist(), los.tolist(), his.tolist()):
                text, lo = data[d].as_py(), max(lo, 0)
                out.append(((SUFFIX, WHOLE, SPAN)[kind] + text[lo : (lo if kind == 0 else hi) + LENGTH]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["low"])

    lows = sorted({r.low for r in texts.select("row", "text").join(some, "row").select("row", "text", "keys").mapInArrow(run, "low binary").collect()})
    parts = min(ranges, len(lows) or 1)
    return ranges, sorted({lows[len(lows) * k // parts] for k in range(1, parts)})


def divided(runs: DataFrame, limits: list[bytes]) -> DataFrame:
    """runs with sub: their ranges cut again, so that each part has about RANGE * CODED keys; blocks over a cut are divided."""
    blocks = runs.where("no IS NOT NULL").select("part", "low", (F.octet_length("lengths") / 2).cast("bigint").alias("n"))
    by = W.partitionBy("part").orderBy("low")
    k = F.floor(F.sum("n").over(by) / (RANGE * CODED))
    cuts = blocks.withColumn("k", k).withColumn("before", F.lag("k").over(by)).where("k > before")
    cuts = materialize(cuts.groupBy(F.col("part").alias("_part")).agg(F.array_sort(F.collect_set("low")).alias("cuts")))
    rows = runs.join(cuts, F.col("part") == F.col("_part"), "left").select(*runs.columns, F.coalesce("cuts", F.array().cast("array<binary>")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, subs = [], []
            for *row, cuts in zip(*[c.to_pylist() for c in b.columns]):
                part, name, no, low, high, shared, lengths, rows, los, his, rest = row
                first, last = (0, 0) if no is None else (bisect_right(cuts, low), bisect_right(cuts, high))
                if first == last:
                    out.append(row)
                    subs.append(first)
                    continue
                what = [np.frombuffer(x, t).tolist() for x, t in ((rows, "<i8"), (los, "<i4"), (his, "<i4"))]
                keys = [s for _, s in decoded(np.frombuffer(shared, "<u2"), np.frombuffer(lengths, "<u2"), zstandard.decompress(rest))]
                for sub, some in cut(list(zip(keys, *what)), cuts):
                    for _, low, high, *columns, rest in front_coded(some):
                        out.append((part, name, no, low, high, *[x.tobytes() for x in columns], zstandard.compress(rest)))
                        subs.append(sub)
            yield arrow_blocks(out).append_column("sub", pa.array(subs, pa.int32()))

    return rows.mapInArrow(run, RUNS + ", sub int")


def twins(runs: DataFrame, wanted: int, limits: list[bytes]) -> DataFrame:
    """row, lo, hi: strings that start there have twins, as two runs (or one) have the key."""
    if wanted > 2 * (len(limits) + 1):  # more ranges than limits
        dealt = divided(materialize(runs), limits)
    else:
        dealt = runs.withColumn("sub", F.lit(0))
    names = ["part", "sub", "run", "shared", "lengths", "rows", "los", "his", "rest"]
    dealt = dealt.repartition(wanted, "part", "sub").sortWithinPartitions("part", "sub", "run", "no").select(*names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def keys(blocks: list):
            before = None
            for shared, lengths, rows, los, his, rest in blocks:
                what = zip(*(np.frombuffer(x, t).tolist() for x, t in ((rows, "<i8"), (los, "<i4"), (his, "<i4"))))
                for (n, s), w in zip(decoded(np.frombuffer(shared, "<u2"), np.frombuffer(lengths, "<u2"), zstandard.decompress(rest)), what):
                    # the first of a block is written whole; what it shares with the one before is seen here
                    yield (n if n or before is None else shared_prefix(before, s, 0)), s, w
                    before = s

        def out():
            found, before, last, told = [], None, b"", False
            for n, s, what in merged([keys(x) for x in held.values()]):
                same = n == len(s) == len(last)
                if same:
                    if not told:
                        found.append(before)
                    found.append(what)
                told, before, last = same, what, s
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["row", "lo", "hi"])

        for b in batches:
            for part, sub, run, *block in zip(*[c.to_pylist() for c in b.columns]):
                if block[0] is None:  # twins within a run
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, t)) for x, t in zip(block[2:5], ("<i8", "<i4", "<i4"))], names=["row", "lo", "hi"])
                    continue
                if (part, sub) != key and held:
                    yield out()
                    held = {}
                key = (part, sub)
                held.setdefault(run, []).append(block)
        if held:
            yield out()

    return dealt.mapInArrow(merge, "row long, lo int, hi int")


def repeats(texts: DataFrame) -> DataFrame:
    """row, ranges: array<struct<lo, hi>> of starts that repeat, both included, of stored() texts."""
    anchored = repeated_anchors(texts)
    spans, mixed_up = span_classes(anchored)
    forget(anchored)
    found = materialize(blocks(texts, mixed_up))
    classes = materialize(found.groupBy("core", "f").agg(F.count("*").alias("n"), F.min(F.struct("row", "st")).alias("one")))
    many = classes.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ("core", "f")])
    whole = materialize(found.join(many, (F.col("core") == F.col("_core")) & (F.col("f") == F.col("_f")), "left_semi").select("row", "st"))
    forget(found)
    cores = materialize(classes.groupBy(F.col("core").alias("_core")).agg(F.count("*").alias("k")).where("k > 1").select("_core"))
    singles = materialize(classes.join(cores, F.col("core") == F.col("_core"), "left_semi").select("one.row", "one.st"))
    for done in (classes, cores):
        forget(done)
    block = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("st").alias("lo"), (F.col("st") + STARTS - 1).alias("hi"))
    keys = spans.select("row", F.struct(F.lit(2).alias("kind"), "lo", "hi").alias("key")).unionByName(whole.select("row", block(1).alias("key"))).unionByName(singles.select("row", block(0).alias("key")))
    wanted = materialize(keys.groupBy("row").agg(F.collect_list("key").alias("keys")))
    for done in (spans, mixed_up, whole, singles):
        forget(done)
    ranges, limits = limits_of(texts, wanted)
    out = materialize(twins(sorted_runs(texts, wanted, limits), ranges, limits).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    forget(wanted)
    return out


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_share double, text string"


def removed(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Flags of the bytes that go, from the ranges of starts that repeat."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(lo, 0), 1)
    np.add.at(edge, np.minimum(hi, n - LENGTH) + LENGTH, -1)
    return np.cumsum(edge)[:n] > 0


def dedup(docs: DataFrame, schema: str, of) -> DataFrame:
    """of(doc_id, text, flags) gives a row of the schema for each document."""
    texts = stored(docs)
    found = repeats(texts)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for whole in batches:
            for b in slices(whole, 1, 2000, 4_000_000):
                rows, data = [], b.column(1).cast(pa.large_binary())
                for k, doc_id in enumerate(b.column(0).to_pylist()):
                    text, ranges = data[k].as_py(), b.column(2)[k]
                    lo, hi = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in ranges.values.flatten()) if ranges.is_valid else (none, none)
                    rows.append(of(doc_id, text, removed(len(text), lo, hi)))
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(zip(*rows) if rows else [[]] * len(names), schema.split(", "))], names=names)

    return texts.join(found, "row", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema)


def digest(doc_id, text: bytes, gone: np.ndarray) -> tuple:
    """What is left as text: a character that a cut runs through becomes a replacement character."""
    n = int(gone.sum())
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text
    spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1)) if n else 0
    return doc_id, len(text), n, spans, hashlib.sha256(kept).hexdigest(), n / len(text) if text else 0.0, kept.decode("utf-8", "replace")


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id, kept: the bytes that stay (which may cut a character)."""
    return dedup(docs, "doc_id long, kept binary", lambda doc_id, text, gone: (doc_id, np.frombuffer(text, np.uint8)[~gone].tobytes()))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), OUT, digest)
