"""Repeated passages by seed and extend: documents meet at anchors of their words, and matches grow from there to both sides.

A passage is repeated if WORDS consecutive words of it (a window) also stand earlier: in a document with a smaller id, or before in
the same one. The first occurrence stays, the words of all later ones go.

1. Seeds. The anchor of a window is the least (leftmost) hash of its GRAM-word strings: winnowing, so equal windows have equal anchors at
   equal places. Anchors whose hash occurs once are dropped: their windows are unique.
2. A seed's context is all words of the windows that it stands for. Seeds with equal contexts are one class, whose first member (by id
   and place) is its head; the whole context of every other member is repeated, as a match that grew as far as its seed goes.
3. Where an anchor has several classes, heads can share a part of their contexts. Each window of a head has a first occurrence among
   the heads; that head is its partner. So a head has at most WORDS - GRAM + 1 partners, and no group's pairs are ever made.
4. From each such pair of seeds the match is extended word by word to the left and to the right, on the words themselves, as far as
   they agree; matches of WORDS words and more are kept. What touches or overlaps is one maximal passage.

Scale: texts are shuffled once, into a table bucketed by row number, which each step reads in place; the rest moves hashes and places, and
the contexts (at most 2 WORDS - GRAM words) of heads in mixed groups. Hot anchors and classes: counts and firsts are aggregated before the
shuffle, joins have a written side, so Spark splits them. A document's passages come together by its row number, bounded by its length.

Cases: null has no words; texts with fewer than WORDS words keep all; a null id comes before all others; rows with equal ids are
documents of their own, in the order in which they are read (which of equal rows stays is so undefined, but one does); an empty table gives an
empty result; other columns are ignored. Words are compared by their bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, slices, table
from .suffixes import Hashes, _spans, anchors, joined, stored

WORDS, GRAM = 20, 8
#: Bytes that stand between words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def worded(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """The bytes of all texts, where each word begins and ends in them, its hash, and the number of the first word of each text (and the end)."""
    raw, at = joined(texts)
    inside = ~BLANK[raw]
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    before[at[:-1][at[:-1] < len(raw)]] = False  # a text's first byte goes on with nothing
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    after[at[1:][at[1:] > 0] - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return raw, begin, end, Hashes(raw).of(begin, end), np.searchsorted(begin, at)


def seeds(texts: DataFrame) -> DataFrame:
    """doc_id, row, a, lo, hi, h, w: anchors (the a-th word of a row's text) whose hash h occurs more than once, the first and last start of the windows that each
    stands for, and the hash w of all words of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, 2, 2000, 1_500_000):
                _, _, _, ids, at = worded(some.column(2))
                doc, a, lo, hi, h, w = anchors(ids, at, WORDS, GRAM)
                index = pa.array(doc)
                yield pa.RecordBatch.from_arrays([some.column(0).take(index), some.column(1).take(index), *[pa.array(x.astype(np.int32)) for x in (a, lo, hi)], pa.array(h.view(np.int64)), pa.array(w.view(np.int64))], names=["doc_id", "row", "a", "lo", "hi", "h", "w"])

    found = materialize(texts.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, a int, lo int, hi int, h long, w long"))
    twice = materialize(found.groupBy("h").count().where("count > 1").select(F.col("h").alias("_h")))
    out = materialize(found.join(twice, F.col("h") == F.col("_h"), "left_semi"))
    for done in (found, twice):
        forget(done)
    return out


def classes_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """repeated (row, lo, hi): windows of seeds whose whole context another seed has before; and heads (row, spans: array<struct<a, lo, hi>>, h with
    each) of anchors with several contexts."""
    place = F.struct("doc_id", "row", "a")
    keyed = found.select("doc_id", "row", "a", "lo", "hi", "h", "w", (F.col("lo") - F.col("a")).alias("x"), (F.col("hi") - F.col("lo")).alias("y"))
    classes = materialize(keyed.groupBy("h", "w", "x", "y").agg(F.count("*").alias("n"), F.min(place).alias("one")))
    many = classes.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in ("h", "w", "x", "y", "one")])
    same = (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    repeated = materialize(keyed.join(many, same).where((F.col("row") != F.col("_one.row")) | (F.col("a") != F.col("_one.a"))).select("row", "lo", "hi"))
    several = materialize(classes.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("k")).where("k > 1").select("_h"))
    span = F.struct(F.col("one.a").alias("a"), (F.col("one.a") + F.col("x")).alias("lo"), (F.col("one.a") + F.col("x") + F.col("y")).alias("hi"), "h")
    heads = materialize(classes.join(several, F.col("h") == F.col("_h"), "left_semi").groupBy("one.row").agg(F.collect_list(span).alias("spans")))
    for done in (classes, several):
        forget(done)
    return repeated, heads


HEADS = "doc_id long, row long, a int, h long, lo int, windows array<long>, left int, context binary"


def contexts(texts: DataFrame, heads: DataFrame) -> DataFrame:
    """HEADS: each head with the hashes of its windows and the words around it, of which `left` stand before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in slices(b, 2, 2000, 1_500_000):
                raw, begin, end, ids, at = worded(some.column(2))
                doc, (a, lo, hi, h) = _spans(some.column(3))
                a, lo, hi = (x.astype(np.int64) for x in (a, lo, hi))
                n = hi - lo + 1
                first = np.repeat(at[doc] + lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(Hashes(ids).of(first, first + WORDS).view(np.int64)))
                low = np.maximum(at[doc] + a - (WORDS - GRAM), at[doc])
                high = np.minimum(at[doc] + a + WORDS, at[doc + 1])
                data = raw.tobytes()
                context = [data[x:y] for x, y in zip(begin[low].tolist(), end[high - 1].tolist())]
                index = pa.array(doc)
                columns = [some.column(0).take(index), some.column(1).take(index), pa.array(a.astype(np.int32)), pa.array(h), pa.array(lo.astype(np.int32)), windows, pa.array((at[doc] + a - low).astype(np.int32)), pa.array(context, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "a", "h", "lo", "windows", "left", "context"])

    return materialize(texts.select("doc_id", "row", "text").join(heads, "row").select("doc_id", "row", "text", "spans").mapInArrow(run, HEADS))


def agreeing(x: list[bytes], y: list[bytes]) -> int:
    """How many words two lists have in common before the first that differs."""
    for k, (p, q) in enumerate(zip(x, y)):
        if p != q:
            return k
    return min(len(x), len(y))


def extended(heads: DataFrame) -> DataFrame:
    """row, lo, hi: starts of windows in the matches of heads with their partners."""
    window = heads.select("doc_id", "row", "a", "h", "lo", F.posexplode("windows").alias("k", "f")).select("doc_id", "row", "a", "h", "f", (F.col("lo") + F.col("k") - F.col("a")).alias("x"))
    firsts = window.groupBy(*[F.col(c).alias(f"_{c}") for c in ("h", "f", "x")]).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "a")).alias("one"))
    firsts = materialize(firsts.where("n > 1").select("_h", "_f", "_x", F.col("one.row").alias("prow"), F.col("one.a").alias("pa")))
    met = window.join(firsts, (F.col("h") == F.col("_h")) & (F.col("f") == F.col("_f")) & (F.col("x") == F.col("_x")))
    pairs = materialize(met.where((F.col("row") != F.col("prow")) | (F.col("a") != F.col("pa"))).select("row", "a", "prow", "pa").distinct())
    own = heads.select(F.col("row").alias("_row"), F.col("a").alias("_a"), "left", "context")
    both = materialize(pairs.join(own, (F.col("row") == F.col("_row")) & (F.col("a") == F.col("_a"))).select("row", "a", "prow", "pa", "left", "context"))
    theirs = heads.select(F.col("row").alias("_row"), F.col("a").alias("_a"), F.col("left").alias("pleft"), F.col("context").alias("pcontext"))
    both = both.join(theirs, (F.col("prow") == F.col("_row")) & (F.col("pa") == F.col("_a"))).select("row", "a", "left", "context", "pleft", "pcontext")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, los, his = [], [], []
            for row, a, left, x, pleft, y in zip(*[c.to_pylist() for c in b.columns]):
                x, y = x.split(), y.split()
                back, ahead = agreeing(x[:left][::-1], y[:pleft][::-1]), agreeing(x[left:], y[pleft:])
                if back + ahead >= WORDS:
                    rows.append(row)
                    los.append(a - back)
                    his.append(a + ahead - WORDS)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(los, pa.int32()), pa.array(his, pa.int32())], names=["row", "lo", "hi"])

    out = materialize(both.mapInArrow(run, "row long, lo int, hi int"))
    for done in (firsts, pairs):
        forget(done)
    return out


def repeats(texts: DataFrame) -> DataFrame:
    """row, ranges: array<struct<lo, hi>> of the windows that also stand earlier, by the first and last word at which one starts, of stored() texts."""
    found = seeds(texts)
    repeated, spans = classes_of(found)
    forget(found)
    heads = contexts(texts, spans)
    forget(spans)
    more = extended(heads)
    out = materialize(repeated.unionByName(more).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    for done in (heads, repeated, more):
        forget(done)
    return out


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, passages array<struct<begin:int,end:int>>, text string"


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, passages (the maximal runs of words that go: first and behind the last) and text (the
    words that stay, joined by one space)."""
    texts = stored(docs)
    found = repeats(texts)
    fields = pa.struct([("begin", pa.int32()), ("end", pa.int32())])

    def of(words: list[bytes], lo: np.ndarray, hi: np.ndarray) -> tuple:
        edge = np.zeros(len(words) + 2, np.int64)
        np.add.at(edge, lo + 1, 1)
        np.add.at(edge, hi + WORDS + 1, -1)
        gone = np.cumsum(edge) > 0  # between two flags that are never set
        turns = np.flatnonzero(np.diff(gone.astype(np.int8)))
        kept, at = [], 0
        for begin, end in turns.reshape(-1, 2).tolist():
            kept += words[at:begin]
            at = end
        text = b" ".join(kept + words[at:])
        return len(words), int(gone.sum()), hashlib.sha256(text).hexdigest(), [{"begin": x, "end": y} for x, y in turns.reshape(-1, 2).tolist()], text.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        for whole in batches:
            for b in slices(whole, 1, 2000, 4_000_000):
                rows, data = [], b.column(1).cast(pa.large_binary())
                for k in range(b.num_rows):
                    ranges = b.column(2)[k]
                    rows.append(of(data[k].as_py().split(), *((x.to_numpy(zero_copy_only=False).astype(np.int64) for x in ranges.values.flatten()) if ranges.is_valid else (none, none))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(fields), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)]], names=[x.split()[0] for x in OUT.split(", ")])

    return texts.join(found, "row", "left").select("doc_id", "text", "ranges").mapInArrow(run, OUT)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
words AS (SELECT doc_id, w[i] AS w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
flags AS (SELECT x.doc_id, x.w, x.i, max(y.i IS NOT NULL) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM words x LEFT JOIN later y ON y.doc_id = x.doc_id AND y.i = x.i),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM flags GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
