"""Token ids in blocks of a static range asymmetric numeral system (rANS).

Format: a table of blocks in ascending order of document ids. A block holds the ids of neighbouring documents, whole documents
only, as one byte string: a header, checkpoints, and the 32-bit words of LANES interleaved coders that share
one static frequency table. Token i belongs to lane i mod LANES; a step codes one token of each lane. A checkpoint stores the
states and the place in the words every STEPS steps, so that parts of a block can be decoded independently. CRC-32 sums
guard the words (before decoding) and the ids (after). Beside the payload a block names its documents, their lengths and the number of
ids before it; blocks so can be found and decoded in any order, by any task.

The frequency table counts all ids of the corpus, scaled to 2^BITS with at least 1 for each id that occurs. It is a file too, with a
CRC-32 sum that each block's header names; what decodes gets its table from that file.

Scale: texts move once (a range partition by id, then a sort inside each partition); ids are written once, counted (the counts
meet as rows of at most the vocabulary's size) and coded where they lie. A task holds one block of BLOCK ids, more only for a
longer document. The number of ids before a partition is a sum over one row per partition.

Words are cached: a text is cut before single spaces and newlines, where the tokenizer's own cut always is, and only pieces that the
worker hasn't met go to the tokenizer, without the punctuation at their end, which is a piece of its own; texts with two white-space
characters in a row go to it whole, as do texts with a string of a special token.

Cases: a string of a special token within a text becomes that token, as the tokenizers library does on its own (`plain`: it is
ordinary text); a null or empty text has the end id alone; null ids come first; documents with equal ids are ordered by text; an empty
table gives an empty result; other columns are ignored."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, slices, table

MAGIC, TABLE = b"VRANS2", b"VRANST"
BITS, LANES, STEPS, BLOCK = 18, 1024, 256, 1 << 19
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<6sBIIIIIII")  # magic, bits, lanes, steps between checkpoints, ids, words, crc of words, crc of ids, crc of the table
TABLE_HEADER = struct.Struct("<6sBII")  # magic, bits, ids, crc of ids and frequencies


class Tables:
    """What the coders share, from the counts of the ids."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, bits: int = BITS):
        if len(ids) > 1 << bits:
            raise ValueError(f"{len(ids)} ids don't fit into 2^{bits} slots")
        order = np.argsort(ids)
        self.bits, self.ids, counts = bits, np.asarray(ids, np.uint32)[order], np.asarray(counts, np.float64)[order]
        room = (1 << bits) - len(counts)
        share = counts / max(1.0, counts.sum()) * room
        freq = 1 + np.floor(share).astype(np.int64)
        for i in np.argsort(np.floor(share) - share, kind="stable")[: (1 << bits) - int(freq.sum())] if len(counts) else ():
            freq[i] += 1
        self._laid(freq)

    def _laid(self, freq: np.ndarray) -> None:
        bits, ids = self.bits, self.ids
        self.crc = zlib.crc32(self._body(freq))
        self.freq, self.start = freq.astype(np.uint64), np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else freq.astype(np.uint64)
        self.most = self.freq << np.uint64(63 - bits)  # a state from here on gives a word away first
        self.place = np.zeros(int(self.ids.max()) + 1 if len(ids) else 1, np.int32)
        self.place[self.ids] = np.arange(len(ids))
        self._slots = None

    def _body(self, freq: np.ndarray) -> bytes:
        return self.ids.astype("<u4").tobytes() + freq.astype("<u4").tobytes()

    def packed(self) -> bytes:
        return TABLE_HEADER.pack(TABLE, self.bits, len(self.ids), self.crc) + self._body(self.freq)

    @classmethod
    def unpacked(cls, data: bytes) -> "Tables":
        magic, bits, n, crc = TABLE_HEADER.unpack_from(data)
        body = data[TABLE_HEADER.size :]
        if magic != TABLE or len(body) != 8 * n or zlib.crc32(body) != crc:
            raise ValueError("damaged table")
        both, out = np.frombuffer(body, "<u4").reshape(2, n), cls.__new__(cls)
        out.bits, out.ids = bits, both[0].astype(np.uint32)
        out._laid(both[1].astype(np.int64))
        return out

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.int32), self.freq.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, t: Tables, lanes: int = LANES, steps: int = STEPS) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    total = -(-n // lanes)
    at, shift, states = t.place[ids], np.uint64(t.bits), np.full(lanes, LOW, np.uint64)
    freq, start, most = t.freq[at], t.start[at], t.most[at]
    words, n_words, marks = [], 0, {}
    for step in range(total - 1, -1, -1):
        lo, hi = step * lanes, min(n, (step + 1) * lanes)
        x, f = states[: hi - lo], freq[lo:hi]
        full = np.flatnonzero(x >= most[lo:hi])
        if len(full):
            out = x.take(full)
            words.append(out.astype(np.uint32))  # the low half
            n_words += len(out)
            x[full] = out >> np.uint64(32)
        q = x // f
        states[: hi - lo] = (q << shift) + (x - q * f) + start[lo:hi]
        if step % steps == 0:
            marks[step] = (n_words, states.copy())
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    body = stream.astype("<u4").tobytes()
    points = b"".join(struct.pack("<I", n_words - m) + s.astype("<u8").tobytes() for _, (m, s) in sorted(marks.items()))
    return HEADER.pack(MAGIC, t.bits, lanes, steps, n, n_words, zlib.crc32(body), zlib.crc32(np.asarray(ids, "<u4").tobytes()), t.crc) + points + body


def decode_block(data: bytes, t: Tables, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or of its parts first..last (by checkpoint) alone."""
    magic, bits, lanes, steps, n, n_words, crc, crc_ids, crc_table = HEADER.unpack_from(data)
    if magic != MAGIC or bits != t.bits or crc_table != t.crc:
        raise ValueError("not a block of this format and table")
    total, size = -(-n // lanes), 4 + 8 * lanes
    parts = -(-total // steps)
    body = memoryview(data)[HEADER.size + parts * size :]
    if len(body) != 4 * n_words or zlib.crc32(body) != crc:
        raise ValueError("the words' checksum is wrong")
    stream = np.frombuffer(body, "<u4")
    last = parts if last is None else min(last, parts)
    out = np.empty(min(n, last * steps * lanes) - first * steps * lanes if first < last else 0, np.int32)
    mask, shift, slots, freq, begins = np.uint64((1 << bits) - 1), np.uint64(bits), t.slots, t.freq, t.start
    for part in range(first, last):
        begin = HEADER.size + part * size
        p, states = struct.unpack_from("<I", data, begin)[0], np.frombuffer(data, "<u8", lanes, begin + 4).astype(np.uint64)
        for step in range(part * steps, min(total, (part + 1) * steps)):
            lo, hi = step * lanes, min(n, (step + 1) * lanes)
            x = states[: hi - lo]
            slot = x & mask
            s = slots.take(slot.view(np.int64))
            out[lo - first * steps * lanes : hi - first * steps * lanes] = s
            x = freq.take(s) * (x >> shift) + slot - begins.take(s)
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x.take(low) << np.uint64(32)) | stream[p : p + len(low)]
                p += len(low)
            states[: hi - lo] = x
    ids = t.ids[out] if len(out) else np.empty(0, np.uint32)
    if first == 0 and last == parts and zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("the ids' checksum is wrong")
    return ids


#: A piece with white space (of any script) at its end, behind its first character, or first but for space and newline.
_S = r"[\s\pZ\x0b\x1c-\x1f\x85]"
ODD = rf"(?s)^.{_S}|{_S}$|^[\t\r\f\x0b\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]"
#: A Latin letter and punctuation from there to the end: the tokenizer always cuts between them and nowhere in the punctuation.
TAIL = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-&(-/:-@\[-`{-~]+)$"


class Encoder:
    """Texts to bytes of little-endian ids, by a tokenizers file; a worker keeps one for all its tasks.

    Texts are cut before every space and newline, and those pieces before the punctuation at their end. Between two white-space
    characters the tokenizer cuts elsewhere, so texts in which such a pair is seen go to it whole; all others are put together from
    their distinct parts. Parts and their ids are Arrow arrays, of at most 2 * MOST parts between batches."""

    MOST = 300_000
    kept: dict[tuple[str, bool], "Encoder"] = {}

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.parts, self.ids = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary())
        self.again = np.ones(1, bool)
        self.newline = self._of("\n")

    @classmethod
    def of(cls, path: str, plain: bool = False) -> "Encoder":
        if (path, plain) not in cls.kept:
            cls.kept[path, plain] = cls(path, plain)
        return cls.kept[path, plain]

    def _of(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _one_by_one(self, parts: pa.Array) -> pa.Array:
        return pa.array([self._of(x).tobytes() for x in parts.to_pylist()], pa.large_binary())

    def _together(self, parts: pa.Array) -> pa.Array:
        """Parts without white space but at their beginning, many at a time, a newline before each, which the tokenizer always keeps apart."""
        led, large = pc.starts_with(parts, "\n").to_numpy(zero_copy_only=False), pa.large_string()
        raw, at = _joined(pc.if_else(pa.array(led), parts, pc.binary_join_element_wise(pa.scalar("", large), parts, pa.scalar("\n", large))))
        ids, begins, n = [], [], 0
        for i in range(0, len(parts), 100):
            j = min(i + 100, len(parts))
            got = self._of(str(raw[at[i] : at[j]], "utf-8"))
            begin = np.flatnonzero(got == self.newline[0])
            if len(self.newline) != 1 or len(begin) != j - i:
                each = [np.concatenate([self.newline[: not led[k]], self._of(parts[k].as_py())]) for k in range(i, j)]
                got, begin = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
            ids.append(got)
            begins.append(begin + n)
            n += len(got)
        ids, begins = np.concatenate(ids), np.concatenate(begins)
        keep = np.ones(n, bool)
        keep[begins[~led]] = False
        ends = np.concatenate([[0], np.cumsum(np.diff(np.append(begins, n)) - ~led)]) * self.kind.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids[keep])])

    def _known(self, parts: pa.Array) -> pa.Array:
        """Ids of different parts; those not met before are learned."""
        at = pc.fill_null(pc.index_in(parts, self.parts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = at < 0
        self.again[at[~unknown]] = True
        if unknown.any():
            new, n = parts.filter(pa.array(unknown)), len(self.parts)
            odd = pc.or_(pc.match_substring_regex(new, ODD), pc.is_in(new, pa.array([" ", "\n"], pa.large_string()))).to_numpy(zero_copy_only=False)
            strange, plain = new.filter(pa.array(odd)), new.filter(pa.array(~odd))
            learned = [f(x) for f, x in ((self._one_by_one, strange), (self._together, plain)) if len(x)]
            self.parts, self.ids = pa.concat_arrays([self.parts, strange, plain]), pa.concat_arrays([self.ids, *learned])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            at[unknown] = n + np.where(odd, np.cumsum(odd), len(strange) + np.cumsum(~odd)) - 1
        out = self.ids.take(pa.array(at))
        if len(self.parts) > 2 * self.MOST:  # what was met again stays, if it isn't too much; many parts stand in one batch alone
            stay = self.again if self.again.sum() <= self.MOST else np.arange(len(self.again)) < 1
            self.parts, self.ids = self.parts.filter(pa.array(stay)), self.ids.filter(pa.array(stay))
            self.again = np.arange(int(stay.sum())) < 1
        return out

    def batch(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n"), "\x01")
        coded = pc.dictionary_encode(lists.values)
        pieces, at, first = coded.dictionary, coded.indices, lists.offsets.to_numpy()
        del lists, coded
        cut = pc.split_pattern(pc.replace_substring_regex(pieces, TAIL, "\\1\x01\\2"), "\x01", max_splits=1)
        parts = pc.dictionary_encode(cut.values)
        data, ends = _joined(self._known(parts.dictionary).take(parts.indices))
        values = pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends[cut.offsets.to_numpy()].astype(np.int64)), pa.py_buffer(data)])
        # 1: white space alone, which only may end a text; 2: white space at an end where the tokenizer may cut elsewhere
        alone = pc.is_in(pieces, pa.array([" ", "\n"], pa.large_string())).to_numpy(zero_copy_only=False)
        other = pc.match_substring_regex(pieces, ODD).to_numpy(zero_copy_only=False)
        odd = np.where(alone, 1, np.where(other, 2, 0)).astype(np.int8)[at.to_numpy()]
        odd[first[1:] - 1] &= 2
        whole = np.add.reduceat(odd, first[:-1], dtype=np.int64) > 0
        for mark in ("\x01", *self.special):
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        data, ends = _joined(values.take(at))
        ends = ends[first].tolist()
        return [self._of(texts[i].as_py()).tobytes() if w else bytes(data[x:y]) for i, (w, x, y) in enumerate(zip(whole.tolist(), ends, ends[1:]))]


def _joined(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of an array with large offsets and no nulls, and where its values begin (and the last ends)."""
    at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset) if len(values) else np.zeros(1, np.int64)
    return memoryview(values.buffers()[2] or b"")[at[0] : at[-1]], at - at[0]


IDS = "part int, before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, ids binary, counts binary"
SCHEMA = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.binary())])


def token_blocks(docs: DataFrame, path: str, end: int = 0, block: int = BLOCK, plain: bool = False) -> DataFrame:
    """Documents in ascending order of ids, tokenized, in blocks of plain ids; part and before (ids of the part before the block) tell the order."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, enc = TaskContext.get().partitionId(), 0, Encoder.of(path, plain)
        names, lengths, held, n = [], [], [], 0
        tail, counts = np.asarray([end], enc.kind).tobytes(), np.zeros(enc.tok.get_vocab_size(), np.int64)

        def made(last: bool = False):
            nonlocal counts
            ids = b"".join(held)
            counts = counts + np.bincount(np.frombuffer(ids, enc.kind), minlength=len(counts))
            some = np.flatnonzero(counts) if last else ()
            said = np.stack([some, counts[some]], 1).astype("<i8").tobytes() if last else None
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, before, n, names, lengths, ids, said), SCHEMA.types)], schema=SCHEMA)

        for b in batches:
            for some in slices(b, 1, 2500, 8_000_000):
                for name, ids in zip(some.column(0).to_pylist(), enc.batch(some.column(1))):
                    k = len(ids) // enc.kind.itemsize + 1
                    if n and n + k > block:
                        yield made()
                        names, lengths, held, n, before = [], [], [], 0, before + n
                    names.append(name)
                    lengths.append(k)
                    held += (ids, tail)
                    n += k
        if names:
            yield made(last=True)

    return rows.mapInArrow(run, IDS)


def frequencies(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """ids and their counts over the whole corpus: each partition's last block has its counts; at most as many as the vocabulary has meet here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                both = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["id", "n"])

    got = blocks.where("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return got.id.to_numpy(np.int64), got.n.to_numpy(np.int64)


CODED = "part int, before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def encode(docs: DataFrame, path: str, end: int = 0, bits: int = BITS, plain: bool = False) -> tuple[DataFrame, Tables]:
    """The coded blocks, with start (ids before the block), and the tables that they share, as read from their file."""
    kind = Encoder.of(path, plain).kind
    blocks = materialize(token_blocks(docs, path, end, plain=plain))
    tables = Tables(*frequencies(blocks), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                payload = encode_block(np.frombuffer(row.column(5)[0].as_buffer(), kind), tables)
                yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([payload], pa.binary())], names=[*SCHEMA.names[:5], "payload"])

    coded = blocks.mapInArrow(run, CODED)
    rows, at, starts = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()), 0, []
    for part, n in rows:  # a row per partition
        starts.append((part, at))
        at += n
    parts = blocks.sparkSession.createDataFrame(starts, "part int, _start long")
    return materialize(coded.join(parts, "part").withColumn("start", F.col("_start") + F.col("before")).drop("_start")), read_tables(write_tables(blocks.sparkSession, tables))


def write_tables(spark: SparkSession, tables: Tables) -> str:
    """Writes the tables as a file of their own to the shared folder: its path."""
    path = shared_dir(spark)
    spark.createDataFrame([(tables.packed(),)], "tables binary").coalesce(1).write.parquet(path)
    return path


def read_tables(path: str) -> Tables:
    return Tables.unpacked(bytes(SparkSession.active().read.parquet(path).first()[0]))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def decode(coded: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian 32-bit), a row per document."""
    return _read(coded, tables, "doc_id long, start long, n_tokens long, ids binary", lambda x: x, pa.binary())


def checksums(coded: DataFrame, tables: Tables) -> DataFrame:
    return _read(coded, tables, READ, zlib.crc32, pa.int64())


def _read(coded: DataFrame, tables: Tables, schema: str, of, kind: pa.DataType) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_ids, lengths, payload, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                raw = memoryview(decode_block(payload.as_py(), tables).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array([of(bytes(raw[4 * i : 4 * j])) for i, j in zip(begins.tolist(), ends.tolist())], kind)], names=names)

    return coded.select("doc_ids", "lengths", "payload", "start").mapInArrow(run, schema)


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded, tables = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(coded, tables)
