"""Fill in the middle: a text is cut at two places between its tokens, and the middle goes behind the rest.

A token is a run of Latin letters or any other single character. Whether one begins at a byte can be told from that byte and
the one before it, so a text is decomposed into chunks that overlap by a byte, and tokens are counted in each chunk by itself. Sums over
the chunks before tell how many tokens begin before each, so the chunk that has the token of a given rank is known, and only that chunk
is looked at again for its place. Texts of up to DEALT bytes are a few chunks that one task has at hand anyway. Longer ones are
dealt chunk by chunk over all tasks, counted there and written; the sums are a window over slim rows, and both ranks go to their chunks by
a join. Both ways use the same functions, and give the same rows.

Scale: a short text isn't shuffled at all. A long one moves once as chunks and once when it becomes a row again. A task holds one text at
most, as its row does.

Cases: null is the empty text, which stays plain; n is then 0. A null id is hashed as an empty string. Rows with equal ids are cut
alike if their texts are equal. An empty table gives an empty result; other columns are ignored. A text that contains one of the marks
stays plain, so the text can always be had back from output and form."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, slices, table
from .suffixes import joined

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are cut at all, and of those the ones whose suffix comes first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of a chunk, and of a text beyond which its chunks are dealt to many tasks.
CHUNK, DEALT = 1 << 14, 1 << 16


def begins(raw: np.ndarray) -> np.ndarray:
    """Flags of the bytes at which a token begins, judged by each byte and the one before (the first byte: as if nothing stood before)."""
    letter = ((raw | 0x20) - np.uint8(97)).astype(np.uint8) < 26
    out = (raw & 0xC0) != 0x80  # the others go on with a character
    out[1:] &= ~(letter[1:] & letter[:-1])
    return out


def place_in(raw: np.ndarray, overlap: int, rank: int) -> int:
    """Where in a chunk (without the bytes that it shares with the one before) the token of a rank begins, by a scan of that chunk alone."""
    return int(np.flatnonzero(begins(raw)[overlap:])[rank])


def ranks(doc_id: Column, n: Column, seed: int = 1) -> list[Column]:
    """After how many tokens prefix and middle end, and two numbers below 100, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    x, y = F.pmod(h[0], n + 1), F.pmod(h[1], n + 1)
    return [F.least(x, y), F.greatest(x, y), F.pmod(h[2], F.lit(100)), F.pmod(h[3], F.lit(100))]


CUTS = "doc_id long, text binary, n long, p long, m long"


def cut_in_rows(docs: DataFrame, seed: int, chunk: int) -> DataFrame:
    """CUTS of texts that a task takes whole: p and m are the bytes after which prefix and middle end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, 4000, 4_000_000):
                raw, at = joined(b.column(1))
                # chunks: each text's, cut at multiples of their size
                n_chunks = np.maximum(1, -(-np.diff(at) // chunk))
                doc = np.repeat(np.arange(len(n_chunks)), n_chunks)
                first = np.cumsum(n_chunks) - n_chunks
                lo = at[doc] + (np.arange(len(doc)) - first[doc]) * chunk
                hi = np.minimum(lo + chunk, at[doc + 1])
                flags = begins(raw)
                heads = at[:-1][np.diff(at) > 0]
                flags[heads] = True  # texts lie side by side here, and don't go on with each other's tokens
                sums = np.concatenate([[0], np.cumsum(flags)])
                counts = sums[hi] - sums[lo]
                total = np.add.reduceat(counts, first) if len(first) else counts
                before = np.cumsum(counts) - counts
                before -= before[first][doc] if len(first) else before
                cuts = np.empty((2, len(total)), np.int64)
                for d, (doc_id, n) in enumerate(zip(b.column(0).to_pylist(), total.tolist())):
                    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
                    own = slice(first[d], first[d] + n_chunks[d])
                    for which, rank in enumerate(sorted(int(digest[8 * k : 8 * k + 8], 16) % (n + 1) for k in (0, 1))):
                        if rank == n:
                            cuts[which, d] = at[d + 1] - at[d]
                            continue
                        k = own.start + int(np.searchsorted(before[own], rank, "right")) - 1  # the chunk that has it
                        overlap = int(lo[k] > at[d])
                        cuts[which, d] = lo[k] - at[d] + place_in(raw[lo[k] - overlap : hi[k]], overlap, rank - int(before[k]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.binary()), *[pa.array(x) for x in (total, *cuts)]], names=[x.split()[0] for x in CUTS.split(", ")])

    return docs.mapInArrow(run, CUTS)


def chunked(docs: DataFrame, chunk: int) -> DataFrame:
    """row, doc_id, no, begin, n, data: the chunks of long texts, each with the byte before it, dealt over all tasks and counted there."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = text.as_buffer()
                for no, begin in enumerate(range(0, max(1, raw.size), chunk)):
                    data = raw.slice(max(0, begin - 1), min(chunk, raw.size - begin) + (begin > 0)).to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((row, pa.int64()), (doc_id, pa.int64()), (no, pa.int32()), (begin, pa.int64()), (data, pa.binary()))], names=["row", "doc_id", "no", "begin", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(begins(np.frombuffer(x.as_buffer(), np.uint8))[int(at > 0) :].sum()) for x, at in zip(b.column(4), b.column(3).to_pylist())]
            yield b.append_column("n", pa.array(n, pa.int64()))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "row long, doc_id long, no int, begin long, data binary"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(split, schema)
    return materialize(rows.repartition(parts, "row", "no").mapInArrow(count, schema + ", n long"))


def cut_by_chunks(docs: DataFrame, seed: int, chunk: int) -> DataFrame:
    """The same of long texts, whose chunks are counted wherever they are."""
    chunks = chunked(docs, chunk)
    by = W.partitionBy("row")
    sums = chunks.select("row", "doc_id", "no", "n").withColumns({"before": F.coalesce(F.sum("n").over(by.orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(by)})
    p, m, *_ = ranks(F.col("doc_id"), F.col("total"), seed)
    sums = sums.withColumn("rank", F.explode(F.array(F.struct(F.lit(0).alias("which"), p.alias("k")), F.struct(F.lit(1).alias("which"), m.alias("k")))))
    mine = (F.col("rank.k") >= F.col("before")) & (F.col("rank.k") < F.col("before") + F.col("n"))
    owners = sums.where(mine).select(F.col("row").alias("_row"), F.col("no").alias("_no"), "rank.which", (F.col("rank.k") - F.col("before")).alias("k"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [begin + place_in(np.frombuffer(x.as_buffer(), np.uint8), int(begin > 0), k) for begin, x, k in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64())], names=["row", "which", "at"])

    found = owners.join(chunks, (F.col("row") == F.col("_row")) & (F.col("no") == F.col("_no"))).select("row", "which", "begin", "data", "k").mapInArrow(scan, "row long, which int, at long")
    at = lambda k: F.max(F.when(F.col("which") == k, F.col("at")))  # noqa: E731  no chunk owns the end of a text
    found = found.groupBy(F.col("row").alias("_row")).agg(at(0).alias("p"), at(1).alias("m"))
    own = F.when(F.col("begin") > 0, F.expr("substring(data, 2)")).otherwise(F.col("data"))
    whole = chunks.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("no", own.alias("x")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["x"].cast("string")), "").cast("binary")
    whole = whole.join(found, F.col("row") == F.col("_row"), "left").withColumn("text", text)
    end = F.octet_length("text").cast("bigint")
    return whole.select("doc_id", "text", "n", F.coalesce("p", end).alias("p"), F.coalesce("m", end).alias("m"))


def fill_in_middle(docs: DataFrame, seed: int = 1, chunk: int = CHUNK, dealt: int = DEALT) -> DataFrame:
    """docs (doc_id, text): doc_id, n (tokens), form (plain, psm: prefix, suffix, middle; spm: suffix first), output, prefix, middle (texts; null if
    plain)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.octet_length("text") > dealt
    cut = cut_in_rows(rows.where(~long), seed, chunk).unionByName(cut_by_chunks(rows.where(long), seed, chunk))
    part = lambda a, b=None: F.expr(f"substring(text, cast({a} AS int) + 1" + (f", cast({b} - {a} AS int))" if b else ")")).cast("string")
    text = F.col("text").cast("string")
    _, _, whether, which = ranks(F.col("doc_id"), F.col("n"), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((F.octet_length("text") == 0) | marked | (whether >= CUT), F.lit("plain")).when(which < SUFFIX_FIRST, F.lit("spm")).otherwise(F.lit("psm"))
    out = cut.select("doc_id", "n", form.alias("form"), text.alias("whole"), part("0", "p").alias("prefix"), part("p", "m").alias("middle"), part("m").alias("suffix"))
    output = F.when(F.col("form") == "plain", F.col("whole")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")).otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    return out.select("doc_id", "n", "form", output.alias("output"), *[F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix", "middle")])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: none of the marks can be in it, so each is found at its first place."""
    body = output.substr(F.lit(len(PREFIX) + 1), F.length(output))
    first = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = body.substr(F.length(first) + F.lit(len(SUFFIX) + 1), F.length(body))
    last = F.substring_index(rest, MIDDLE, 1)
    middle = rest.substr(F.length(last) + F.lit(len(MIDDLE) + 1), F.length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, last)).otherwise(F.concat(last, middle, first))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select(
        "doc_id", "n", "form", F.length("prefix").cast("bigint").alias("prefix_chars"), F.length("middle").cast("bigint").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT *, len(t)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS x FROM d),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS p, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS m,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
s AS (SELECT *, array_to_string(t[1:p], '') AS prefix, array_to_string(t[p + 1:m], '') AS middle, array_to_string(t[m + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN len(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM s"""
