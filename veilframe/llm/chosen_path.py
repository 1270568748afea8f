"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles: every five neighbouring words (fewer than five words: all of them as one shingle).
Documents with equal sets are one text class; the join is between classes. Each class has a signature of TOKENS minhash
values, a sample of its set at each of TOKENS places. A run starts with a few places chosen for all; a class then lies in the
bucket of each chosen place and its value there. A bucket that is small, or in which the members are alike anyway, is solved by brute
force; any other is split again: its own seed chooses places, and each member goes on to the buckets of its values there. A pair
shares a place's value with the probability of its similarity, so pairs that are alike go the same way, and others part. The
first split of a bucket chooses `wide` places, which repeats the recursion that often; later ones choose 1 / threshold places on
average and at least one. Runs and `wide` are such that the probability that a pair at the threshold has met nowhere, or is left out
by the filter on signatures, is below 1 - RECALL even if all buckets are split down to the last level.

Brute force compares signatures first, then verifies the pairs that are left on the shingles themselves. A pair that meets in several
buckets counts in the first of them alone, which either member's list of buckets tells; so links are counted without listing pairs.

Large groups of near copies are settled before: classes that share a band of the signature with more than CORE others are compared with one
of them, the leader, on the shingles. With n shingles of the leader, of which a class lacks x and has y others, x + t y <= n (1 - t) / 2 is
its distance from the centre of a core: any two such classes have at least n - x - x' shingles in common and at most n + y + y' together,
so they are linked. A core's links are a sum; its members meet only what lies outside of it.

Scale: a level of the recursion is a count per bucket (partial sums first, written) joined to its members, in a join that can split a hot
bucket; only members of large buckets with something to compare go on. Large buckets of alike members are cut into blocks of
BLOCK members, and each pair of blocks is a task's group, so no task holds more than two blocks, whatever the size of the group;
blocks of one core aren't paired. A core's members are compared with copies of the leader's text, one for each BLOCK members. Texts move only
for classes with a pair whose signatures agree. What leaves the brute force is a number of links and at most one edge per member and
group, not the pairs; classes are joined by iterated minimum labels over these edges, each round written to the shared folder. The
work on a group of near copies that isn't a core (alike at the threshold, far from each other) is quadratic, as its links are.

Cases: null and empty texts (without words) have no shingles, are linked to nothing and are classes of their own; repeated rows
count as documents; null ids take part, but the least id that isn't null names a class; texts of any length are whole; an empty table gives
an empty result; other columns are ignored by join() and given as they are by distinct(). Documents are read several times, so they have to
be a table or files."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import settled
from .common import forget, materialize, packed, row_key, slices, table, unpacked

WORDS, THRESHOLD = 5, 0.8
TOKENS, RECALL = 64, 0.9999
#: Places that all classes of a run are dealt by at first, members that a bucket is solved with at most, members in a block at most.
ROOTS, SMALL, BLOCK = 2, 4096, 2048
#: Near copies of one class from which on they are made a core.
CORE = 64
#: Bytes of texts in a block, about.
ROOM = 1 << 24
DEPTH = 6
#: Bands of a signature in which near copies are looked for, places in a band.
BANDS, BAND = 6, 8

_rng = np.random.default_rng(20_240_601)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
SEEDS = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and its inverses, modulo 2^64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        have = _POWERS[int(base)] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (base, inverse))
    return have


def shingles(text: bytes | pa.Buffer, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the shingles of a UTF-8 text, ascending, each once."""
    raw = np.frombuffer(text, np.uint8)
    blank = np.concatenate([[True], BLANK[raw], [True]])
    change = np.flatnonzero(blank[1:] != blank[:-1])
    if not len(change):
        return np.empty(0, np.uint64)
    begin, end = change[::2], change[1::2]
    up, down = powers(BASE, len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * up[: len(raw)])])
    word = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * STEP)
    n, out = min(words, len(word)), np.zeros(max(1, len(word) - words + 1), np.uint64)
    for k in range(n):
        out = mixed(out * STEP + word[k : k + len(out)])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The least of TOKENS hashes of a set that isn't empty, 32 bits of each."""
    out = np.empty(TOKENS, np.uint64)
    for i in range(0, TOKENS, 8):
        part = (s[None, :] ^ SEEDS[i : i + 8, None]) * STEP
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(32)
        out[i : i + 8] = part.min(1)
    return (out >> np.uint64(16)).astype(np.uint32)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def keyed(docs: DataFrame) -> DataFrame:
    """_m (a row's columns), key (equal for equal rows only) and text."""
    rows = packed(docs)
    return rows.select("_m", row_key(F.col("_m"), rows.schema["_m"].dataType).alias("key"), F.coalesce(F.col("_m.text"), F.lit("")).alias("text"))


def sketches(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Of keyed() rows: key, doc, bytes of the text, set (digest of the shingle set, null without shingles) and signature, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, 2):
                sets, signs = [], []
                for t in some.column(2):
                    s = shingles(t.as_buffer(), words)
                    sets.append(digest(s) if len(s) else None)
                    signs.append(signature(s).tobytes() if len(s) else None)
                size = pc.binary_length(some.column(2)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*some.columns[:2], size, pa.array(sets, pa.binary()), pa.array(signs, pa.binary())], names=["key", "doc", "bytes", "set", "signature"])

    rows = rows.select("key", F.col("_m.doc_id").cast("bigint").alias("doc"), "text")
    return materialize(rows.mapInArrow(run, "key struct<a:long,b:long>, doc long, bytes long, set binary, signature binary"))


def with_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, ...) with the text of its key; equal rows give one."""
    texts = rows.select(F.col("key").alias("_key"), "text")
    some = wanted.select(F.col("key").alias("_some")).distinct()
    texts = texts.join(some.hint("merge"), F.col("_key") == F.col("_some"), "left_semi")  # texts are dealt by key at any size
    texts = texts.withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy("_key"))).where("_n = 1").drop("_n")
    return wanted.join(texts, F.col("key") == F.col("_key")).drop("_key")


def chosen(seed: np.ndarray, threshold: float, wide: int = 0) -> np.ndarray:
    """Which places the nodes with these seeds choose: rows of TOKENS flags, `wide` of them set, or 1 / threshold on average (one of
    the whole numbers next to it)."""
    order = np.argsort(mixed(seed[:, None] + SEEDS[None, :]), axis=1)
    if wide:
        n = np.full(len(seed), wide)
    else:
        low = min(int(1 / threshold), TOKENS)
        n = low + ((mixed(seed ^ STEP) >> np.uint64(11)).astype(np.float64) / 2.0**53 < 1 / threshold - low)
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, np.arange(TOKENS)[None, :] < n[:, None], axis=1)
    return out


def roots(runs: int, start: int = 0) -> np.ndarray:
    """Places of each run, no place twice while there are others."""
    order = np.random.default_rng(7).permutation(TOKENS)
    return np.array([[order[(r * ROOTS + k) % TOKENS] for k in range(ROOTS)] for r in range(start, start + runs)])


def runs_for(recall: float, threshold: float) -> int:
    """A pair at the threshold misses all places of all runs with (1 - threshold)^places."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold) / ROOTS))


def least_agreement(recall: float, threshold: float) -> int:
    """Places at which signatures have to agree for a pair to be verified: a pair at the threshold has fewer with at most (1 - recall) / 5."""
    m, below = 0, 0.0
    while m < TOKENS and (below := below + math.comb(TOKENS, m) * threshold**m * (1 - threshold) ** (TOKENS - m)) <= (1 - recall) / 5:
        m += 1
    return m


def missed(threshold: float, runs: int, wide: int, least: int, depth: int = DEPTH) -> float:
    """Probability that a pair at the threshold is left out if no bucket above the last level is solved. Signatures agree at m
    places, a binomial number; which of them are chosen is independent given m, but for places of one node, which differ."""
    low = min(int(1 / threshold), TOKENS)
    more = 1 / threshold - low if low < TOKENS else 0.0

    def lost(m: int, n: int, on: float) -> float:  # n different places, each agreeing one is met again with probability `on`
        return sum(math.comb(m, j) * math.comb(TOKENS - m, n - j) * (1 - on) ** j for j in range(n + 1)) / math.comb(TOKENS, n)

    out = 0.0
    for m in range(TOKENS + 1):
        on = 1.0
        for _ in range(depth - 1):
            on = 1 - (1 - more) * lost(m, low, on) - (more * lost(m, low + 1, on) if more else 0.0)
        on = 1 - lost(m, wide, on) if depth else 1.0
        p = lost(m, min(runs * ROOTS, TOKENS), on) if m >= least else 1.0
        out += math.comb(TOKENS, m) * threshold**m * (1 - threshold) ** (TOKENS - m) * p
    return out


@functools.lru_cache
def plan(recall: float, threshold: float, runs: int = 0, depth: int = DEPTH) -> tuple[int, int]:
    """Runs (the fewest, or as given) and `wide`, with which missed() is below 1 - recall; all places at once where runs are too few for it."""
    fixed, runs, least = runs > 0, runs or runs_for(recall, threshold), least_agreement(recall, threshold)
    while not fixed and runs * ROOTS < TOKENS and missed(threshold, runs, TOKENS, least, depth) >= 1 - recall:
        runs += 1
    return runs, next((w for w in range(1, TOKENS) if missed(threshold, runs, w, least, depth) < 1 - recall), TOKENS)


NODE = "id long, unit long, node long"


def _nodes(members: DataFrame, of) -> DataFrame:
    """Rows (id, unit, node) that of(signatures, further columns) makes: rows and their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, node = of(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS), b)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(node.view(np.int64))], names=["id", "unit", "node"])

    return members.mapInArrow(run, NODE)


def first_nodes(classes: DataFrame, runs: int) -> DataFrame:
    """A row for each class, run and place of the run."""
    places = roots(runs).ravel()
    seeds = mixed(np.arange(len(places), dtype=np.uint64) + np.uint64(1))

    def of(signs: np.ndarray, b: pa.RecordBatch):
        return np.repeat(np.arange(len(signs)), len(places)), mixed(seeds[None, :] + signs[:, places].astype(np.uint64) * STEP).ravel()

    return _nodes(classes.select("id", "unit", "signature"), of)


def next_nodes(members: DataFrame, threshold: float, wide: int = 0) -> DataFrame:
    """members (id, unit, signature, node): the node's seed chooses places, each member goes on by its values there."""

    def of(signs: np.ndarray, b: pa.RecordBatch):
        seed = b.column(3).to_numpy().view(np.uint64)
        row, place = np.nonzero(chosen(seed, threshold, wide))
        return row, mixed(seed[row] * STEP + mixed(place.astype(np.uint64) + (signs[row, place].astype(np.uint64) << np.uint64(8))))

    return _nodes(members.select("id", "unit", "signature", "node"), of)


def band_nodes(classes: DataFrame) -> DataFrame:
    """A row for each class and band of its signature."""

    def of(signs: np.ndarray, b: pa.RecordBatch):
        out = np.zeros((len(signs), BANDS), np.uint64)
        for k in range(BANDS):
            out[:, k] = mixed(np.full(len(signs), k + 1, np.uint64))
            for place in range(k * BAND, (k + 1) * BAND):
                out[:, k] = mixed(out[:, k] * STEP + signs[:, place])
        return np.repeat(np.arange(len(signs)), BANDS), out.ravel()

    return _nodes(classes.select("id", F.col("id").alias("unit"), "signature"), of)


def cores(rows: DataFrame, classes: DataFrame, threshold: float, words: int, small: int = CORE, block: int = BLOCK) -> DataFrame:
    """id, core: the classes near a leader (the core's name, itself among them), any two of which are linked."""
    bands = materialize(band_nodes(classes).drop("unit"))
    heads = materialize(bands.groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("n"), F.min("id").alias("leader")).where(F.col("n") > small).drop("n"))
    picks = materialize(bands.join(heads, F.col("node") == F.col("_node")).groupBy("id").agg(F.min("leader").alias("leader")))
    forget(bands)
    if picks.isEmpty():
        return classes.select("id", F.col("id").alias("core")).limit(0)
    picks = materialize(picks.join(classes.select("id", "signature"), "id"))
    leaders = materialize(picks.where("id = leader").select(F.col("id").alias("_leader"), F.col("signature").alias("_sign")))
    held = picks.where("id <> leader").join(leaders, F.col("leader") == F.col("_leader"))
    held = materialize(held.where(agreement(F.col("signature"), F.col("_sign")) >= (1 + threshold) / 2).select("id", "leader"))  # others are seldom that near
    counts = materialize(held.groupBy(F.col("leader").alias("_leader")).agg(F.count("*").alias("n")).where(F.col("n") > small).select("_leader", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    if counts.isEmpty():
        return classes.select("id", F.col("id").alias("core")).limit(0)
    members = held.join(counts, F.col("leader") == F.col("_leader")).select("id", "leader", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(False).alias("head"))
    heads = counts.select(F.col("_leader").alias("id"), F.col("_leader").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("head"))
    wanted = materialize(members.unionByName(heads).join(classes.select("id", "key"), "id"))
    dealt = with_texts(rows, wanted).select("leader", "part", "head", "id", "text").repartition("leader", "part").sortWithinPartitions("leader", "part", F.desc("head"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, None
        for b in batches:
            found = []
            for leader, part, head, k, text in zip(*[b.column(c).to_pylist() for c in range(4)], b.column(4)):
                s = shingles(text.as_buffer().to_pybytes(), words)
                if head:
                    key, centre = (leader, part), s
                elif key == (leader, part):
                    both = len(np.intersect1d(centre, s, assume_unique=True))
                    if len(centre) - both + threshold * (len(s) - both) <= len(centre) * (1 - threshold) / 2 - 1e-9:
                        found.append((k, leader))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["id", "core"])

    found = materialize(dealt.mapInArrow(near, "id long, core long"))
    return found.unionByName(found.select(F.col("core").alias("id"), "core").distinct())


def leaves(classes: DataFrame, threshold: float = THRESHOLD, runs: int = 3, small: int = SMALL, depth: int = DEPTH, *, recall: float = RECALL) -> DataFrame:
    """id, unit, node, n: the buckets that brute force solves, and their members, of classes (id, unit, signature). Buckets all
    in one unit (a core, or a class alone) have nothing to compare."""
    level, out, wide = materialize(first_nodes(classes, runs)), None, plan(recall, threshold, runs, depth)[1]
    for k in range(depth + 1):
        counts = materialize(level.groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("n"), F.min("unit").alias("_low"), F.max("unit").alias("_high")).where("_low <> _high").select("_node", "n"))
        met = materialize(level.join(counts, F.col("node") == F.col("_node")).drop("_node"))
        forget(level)
        out = (lambda x: x if out is None else out.unionByName(x))(met.where(F.col("n") <= small if k < depth else F.lit(True)))
        if k == depth or (large := met.where(F.col("n") > small)).isEmpty():
            break
        signed = materialize(large.join(classes.select("id", "signature"), "id"))
        alike = materialize(_alike(signed, threshold))
        both = materialize(signed.join(alike, F.col("node") == F.col("_node")).drop("_node"))
        forget(signed)
        out = out.unionByName(both.where("_alike").select("id", "unit", "node", "n"))
        rest = both.where("NOT _alike")
        if rest.isEmpty():
            break
        level = materialize(next_nodes(rest, threshold, 0 if k else wide))
    return out


def _alike(signed: DataFrame, threshold: float) -> DataFrame:
    """_node, _alike: whether the members of a bucket agree with one of three of them at 0.9 of the threshold, on the mean. Such a bucket is
    solved, as splitting it would hardly part its members."""
    ends = materialize(signed.groupBy(F.col("node").alias("_node")).agg(F.array(F.min("signature"), F.max("signature"), F.min_by("signature", "id")).alias("_ends")))
    near = signed.join(ends, F.col("node") == F.col("_node")).groupBy("_node")
    near = near.agg(*[F.avg(agreement(F.col("signature"), F.col("_ends")[k])).alias(f"_{k}") for k in range(3)])
    return near.select("_node", (F.greatest("_0", "_1", "_2") >= 0.9 * threshold).alias("_alike"))


def agreement(a, b):
    """Part of the places at which two signatures are equal."""
    equal = [F.when(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4), 1).otherwise(0) for k in range(TOKENS)]
    return sum(equal[1:], equal[0]) / TOKENS


def blocks(met: DataFrame, sizes: DataFrame, most: int = BLOCK, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """lists (id, nodes): the leaves of each class (sizes: id, bytes); and dealt (id, node, p, q, side): the groups that brute force solves.

    A leaf of at most `size` members (`most`, fewer if texts are so long that these may not fit into `room`) is one group (0, 0). A larger one is cut into blocks. Members of one core are linked; members whose
    first leaf is the same, and another one than this, have met each other there. The largest set of such members is cut into blocks of its
    own (the last ones), which are only paired with the others. A leaf of such members alone is done."""
    lists = met.groupBy("id").agg(F.sort_array(F.collect_set("node")).alias("nodes"))  # runs and places bound the list
    first = F.get("nodes", F.lit(0))
    members = met.join(lists, "id").join(sizes, "id").select("id", "node", "bytes", F.when(F.col("unit") != F.col("id"), F.struct(F.lit(True).alias("core"), F.col("unit").alias("name"))).otherwise(F.struct(F.lit(False).alias("core"), first.alias("name"))).alias("label"))
    members = materialize(members.withColumn("met", F.col("label.core") | (F.col("label.name") != F.col("node"))))
    ranked = members.groupBy("node", "label", "met").agg(F.count("*").alias("k"), F.max("bytes").alias("bytes")).groupBy(F.col("node").alias("_node"))
    ranked = ranked.agg(F.max(F.when(F.col("met"), F.struct("k", "label"))).alias("top"), F.sum("k").alias("all"), F.max("bytes").alias("bytes"))
    size = F.least(F.lit(most), F.greatest(F.lit(8), F.floor(room / F.col("bytes")))).cast("double")
    ranked = materialize(ranked.select("_node", "all", F.col("top.label").alias("top"), F.coalesce("top.k", F.lit(0)).alias("known"), size.alias("size")).where("known < all"))
    parts = lambda n: F.ceil(n / F.col("size")).cast("int")
    rows = members.join(ranked, F.col("node") == F.col("_node"))
    one, hashed = F.col("all") <= F.col("size"), F.xxhash64("id", "node")
    news, olds = parts(F.col("all") - F.col("known")), parts(F.col("known"))
    old = F.coalesce(F.col("label") == F.col("top"), F.lit(False))
    block = F.when(one, 0).when(old, news + F.pmod(hashed, olds)).otherwise(F.pmod(hashed, news)).cast("int")
    others = F.when(one, F.array(F.lit(0))).when(old, F.sequence(F.lit(0), news - 1)).otherwise(F.sequence(F.lit(0), news + olds - 1))
    dealt = rows.withColumn("b", block).withColumn("o", F.explode(others))
    dealt = dealt.select("id", "node", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), (F.col("b") > F.col("o")).alias("side"))
    return lists, dealt


def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At how many places each signature of x equals each of y."""
    if len(x) * len(y) <= 4096:
        return (x[:, None, :] == y[None, :, :]).sum(2)
    same = np.zeros((len(x), len(y)), np.uint8)
    for k in range(TOKENS):
        same += x[:, k][:, None] == y[:, k][None, :]
    return same


def products(owner: np.ndarray, column: np.ndarray, n: int, few: int = 32) -> np.ndarray:
    """How many columns each two of n owners share: pairs of the owners of a column that has few, matrix products for all others."""
    out, wide = np.zeros((n, n), np.float32), 2048
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    begin = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
    count = np.diff(np.append(begin, len(column)))
    for k in range(2, few + 1):
        at = begin[count == k]
        for some in np.array_split(at, max(1, len(at) * k * k // 4_000_000)):
            x = owner[some[:, None] + np.arange(k)]
            np.add.at(out, (np.repeat(x, k, axis=1), np.tile(x, k)), 1)
    large = np.flatnonzero(count > few)
    for lo in range(0, len(large), wide):
        some = large[lo : lo + wide]
        dense = np.zeros((n, len(some)), np.float32)
        for c, k in enumerate(some):
            dense[owner[begin[k] : begin[k] + count[k]], c] = 1
        out += dense @ dense.T
    return out


def pairs(node: int, within: bool, units: np.ndarray, side: np.ndarray, signs: np.ndarray, lists: list, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group (places of members) whose signatures agree at enough places, of different units, in the first leaf that both are in."""
    a = np.arange(len(units)) if within else np.flatnonzero(~side)
    b = a if within else np.flatnonzero(side)
    maybe = (agree(signs[a], signs[b]) >= least) & (units[a][:, None] != units[b][None, :])
    if within:
        maybe &= a[:, None] < b[None, :]
    i, j = np.nonzero(maybe)
    i, j = a[i], b[j]
    if len(i):
        owner, other = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
        owner, other = owner[other < node], other[other < node]
        _, column, counts = np.unique(other, return_inverse=True, return_counts=True)
        column, owner = (np.cumsum(counts > 1) - 1)[column[counts[column] > 1]], owner[counts[column] > 1]  # leaves that two of them are in
        if len(column):
            met = products(owner, column, len(lists))[i, j] > 0
            i, j = i[~met], j[~met]
    return i, j


def solve(i: np.ndarray, j: np.ndarray, size: np.ndarray, texts: list, threshold: float, words: int):
    """Brute force on the pairs of a group: the links' weight of each member, and edges (places of members) that keep what is connected."""
    links = np.zeros(len(size), np.int64)
    if not len(i):
        return links, ([], [])
    used = np.unique(np.concatenate([i, j]))
    sets, at = [shingles(texts[k], words) for k in used], np.zeros(len(size), np.int64)
    at[used] = np.arange(len(used))
    n = np.array([len(s) for s in sets])
    x, y = at[i], at[j]
    fit = np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9
    i, j, x, y = i[fit], j[fit], x[fit], y[fit]
    if len(x) > 4 * len(used):
        # many pairs: the shingles that several of them have are columns of a matrix, and products are sizes of intersections
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared, owner = counts[column] > 1, np.repeat(np.arange(len(sets)), n)
        common = products(owner[shared], (np.cumsum(counts > 1) - 1)[column[shared]], len(sets))[x, y].round().astype(np.int64) if shared.any() else np.zeros(len(x), np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x, y)], np.int64)
    linked = common >= threshold * (n[x] + n[y] - common) - 1e-9
    i, j = i[linked], j[linked]
    np.add.at(links, i, size[j])
    np.add.at(links, j, size[i])
    return links, forest(len(size), i, j)


GROUP = "node", "p", "q"


def grouped(rows: DataFrame, names: list[str], schema: str, of) -> DataFrame:
    """of(key, columns by name) gives a batch for each group (node, p, q) of two rows or more, dealt by group and sorted by id."""
    rows = rows.select(*GROUP, *names).repartition(*GROUP).sortWithinPartitions(*GROUP, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            both = pa.Table.from_batches(held).combine_chunks()
            return of(key, {n: both.column(n).combine_chunks() for n in names})

        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(c).to_numpy() for c in range(3)]
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0), [True]])
            begins = np.flatnonzero(new).tolist()
            for x, y in zip(begins, begins[1:]):
                now = tuple(int(k[x]) for k in keys)
                if now != key:
                    if sum(h.num_rows for h in held) > 1:
                        yield out()
                    key, held = now, []
                held.append(b.slice(x, y - x))
        if sum(h.num_rows for h in held) > 1:
            yield out()

    return rows.mapInArrow(run, schema)


def _group_pairs(key: tuple, c: dict, least: int) -> tuple[np.ndarray, np.ndarray]:
    signs = np.frombuffer(b"".join(c["signature"].to_pylist()), np.uint32).reshape(-1, TOKENS)
    nodes, ends = c["nodes"].flatten().to_numpy(), c["nodes"].offsets.to_numpy() - c["nodes"].offsets[0].as_py()
    lists = [nodes[x:y] for x, y in zip(ends, ends[1:])]
    return pairs(key[0], key[1] == key[2], c["unit"].to_numpy(), c["side"].to_numpy(zero_copy_only=False), signs, lists, least)


def candidates(rows: DataFrame, least: int) -> DataFrame:
    """rows (node, p, q, id, side, unit, nodes, signature): those of a pair whose signatures agree."""

    def of(key: tuple, c: dict) -> pa.RecordBatch:
        used = np.unique(np.concatenate(_group_pairs(key, c, least)))
        n = len(used)
        return pa.RecordBatch.from_arrays([*[pa.array(np.full(n, k), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))], *[c[x].take(pa.array(used)) for x in ("id", "side")]], names=[*GROUP, "id", "side"])

    return grouped(rows, ["id", "side", "unit", "nodes", "signature"], "node long, p int, q int, id long, side boolean", of)


FOUND = "id long, links long, other long"


def solved(rows: DataFrame, threshold: float, words: int, least: int) -> DataFrame:
    """rows (node, p, q, id, side, unit, size, nodes, signature, text), dealt by group: the links of members (other is null), and edges (id > other)."""

    def of(key: tuple, c: dict) -> pa.RecordBatch:
        ids, texts = c["id"].to_numpy(), c["text"].cast(pa.large_binary())
        links, (i, j) = solve(*_group_pairs(key, c, least), c["size"].to_numpy(), _Lazy(texts), threshold, words)
        some = np.flatnonzero(links)
        x, y = ids[i], ids[j]
        other = [None] * len(some) + np.minimum(x, y).tolist()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], np.maximum(x, y)]).astype(np.int64)), pa.array(np.concatenate([links[some], np.zeros(len(x), np.int64)])), pa.array(other, pa.int64())], names=["id", "links", "other"])

    return grouped(rows, ["id", "side", "unit", "size", "nodes", "signature", "text"], FOUND, of)


class _Lazy:
    """Values of an array, each made when it is asked for."""

    def __init__(self, values: pa.Array):
        self.values = values

    def __getitem__(self, k: int) -> bytes:
        return self.values[int(k)].as_py()


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that keep what the links connect: at most one per member."""
    parent, out = list(range(n)), ([], [])

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for p, q in zip(i.tolist(), j.tolist()):
        x, y = root(p), root(q)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out[0].append(p)
            out[1].append(q)
    return out


def components(edges: DataFrame) -> DataFrame:
    """id, label (the least id of its component), from edges (id > other): rounds of least neighbours and of shortcuts."""
    labels = materialize(edges.select("id").union(edges.select("other")).distinct().select("id", F.col("id").alias("label")))
    both = materialize(edges.select(F.col("id").alias("a"), F.col("other").alias("b")).union(edges.select("other", "id")).distinct())
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("_near"))
        less = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("old"), F.least("label", "_near").alias("label"))
        # the one that gave the label may have a lesser one by now: the label's own label
        up = labels.select(F.col("id").alias("_id"), F.col("label").alias("_up"))
        new = materialize(less.join(up, F.col("label") == F.col("_id"), "left").select("id", "old", F.least("label", "_up").alias("label")))
        done = new.where("label <> old").isEmpty()
        forget(labels)
        labels = new.select("id", "label")
        if done:
            return labels


def linked(rows: DataFrame, found: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """Of keyed() rows and their sketches(): set, rep (key of the class's first document), text_class, class_id, first (whether the
    class is its component's first), n_links (documents linked to one of it), a row per text class."""
    least = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("key").alias("key"))
    classes = found.where(F.col("set").isNotNull()).groupBy("set").agg(F.min(least).alias("k"), F.count("*").alias("size"), F.max("bytes").alias("bytes"), F.min("signature").alias("signature"))
    classes = materialize(classes.select("set", "k.key", "k.doc", "size", "bytes", "signature", F.monotonically_increasing_id().alias("id")))
    near = materialize(cores(rows, classes, threshold, words))
    weights = near.join(classes.select("id", "size"), "id").groupBy(F.col("core").alias("_core")).agg(F.sum("size").alias("weight"))
    near = materialize(near.join(weights, F.col("core") == F.col("_core")).drop("_core").withColumnRenamed("id", "_near"))
    classes = materialize(classes.join(near, F.col("id") == F.col("_near"), "left").select("set", "key", "doc", "size", "bytes", "signature", "id", F.coalesce("core", "id").alias("unit"), (F.coalesce("weight", "size") - F.col("size")).alias("within")))
    lists, dealt = blocks(leaves(classes, threshold, plan(recall, threshold)[0], recall=recall), classes.select("id", "bytes"))
    signed = materialize(lists.join(classes.select("id", "unit", "size", "signature", "key"), "id"))
    agreeing = materialize(candidates(dealt.join(signed, "id"), least_agreement(recall, threshold)))
    wanted = materialize(agreeing.join(signed, "id"))
    found = materialize(solved(with_texts(rows, wanted), threshold, words, least_agreement(recall, threshold)))
    forget(wanted)
    links = found.where("other IS NULL").groupBy(F.col("id").alias("_l")).agg(F.sum("links").alias("links"))
    edges = found.where("other IS NOT NULL").select("id", "other").unionByName(classes.where("unit <> id").select("id", F.col("unit").alias("other")))
    labels = components(edges).select(F.col("id").alias("_c"), "label")
    out = classes.join(links, F.col("id") == F.col("_l"), "left").join(labels, F.col("id") == F.col("_c"), "left")
    out = materialize(out.select("set", "key", "id", "doc", "size", (F.coalesce("links", F.lit(0)) + F.col("within") + F.col("size") - 1).alias("n_links"), F.coalesce("label", "id").alias("label")))
    first = materialize(out.groupBy(F.col("label").alias("_label")).agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "id")).alias("k")))
    return out.join(first, F.col("label") == F.col("_label")).select("set", F.col("key").alias("rep"), F.col("doc").alias("text_class"), F.col("k.doc").alias("class_id"), (F.col("k.id") == F.col("id")).alias("first"), "n_links")


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, text_class (least id of the documents with the same shingles), class_id (least id of the documents that links
    connect), n_links (documents linked to it), a row per document."""
    rows = keyed(docs.select("doc_id", "text"))
    found = sketches(rows, words)
    classes = settled(docs.sparkSession, lambda: linked(rows, found, threshold, words, recall).withColumnRenamed("set", "_set"))
    out = found.select("doc", "set").join(classes, F.col("set") == F.col("_set"), "left")
    own = lambda c: F.when(F.col("set").isNull(), F.col("doc")).otherwise(F.col(c)).alias(c)
    return out.select(F.col("doc").alias("doc_id"), own("text_class"), own("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def distinct(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One document of each group that links connect, the one with the least id, and all without shingles; all columns."""
    rows = keyed(docs)
    found = sketches(rows, words)
    empty = found.where("set IS NULL").select(F.col("key").alias("_stay"), F.lit(True).alias("_all")).distinct()
    first = lambda: linked(rows, found, threshold, words, recall).where("first").select(F.col("rep").alias("_stay"), F.lit(False).alias("_all"))
    stay = settled(docs.sparkSession, lambda: first().unionByName(empty))
    forget(found)
    out = rows.select("_m", "key").join(stay, F.col("key") == F.col("_stay")).withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy("key")))
    return unpacked(out.where("_all OR _n = 1"), docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
