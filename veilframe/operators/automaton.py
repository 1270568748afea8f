"""Many literal variants found at once: a trie in arrays that walks from all places of a batch of texts together, and the cascade of rules
that runs on what it finds.

A rule is a row of rewrite.rules(); its rank is its place in their order. Rules are cut into shards by rank; each shard's trie is built in a
task of its own and is a row of a table. The trie branches only where variants do: below its last branching point a variant is compared
with the text directly. One step of the walk is a look-up of (state, character) pairs in a sorted array, for all places that are still
alive; most end after a step or two.

The cascade gives what running all rules in turn gives: a rule changes a text only if its variant is there at its turn, and it can be there
only because it was at first or because an id that has been inserted completes it. So the rules of variants found at first wait in
order; each one that replaces something adds the rules of what stands in, or reaches into, its id and that come later. Of rules with one variant only the next
one waits, and the one behind it if the variant is still there then: a table may have very many of them."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import materialize, numbered
from .detect import CATEGORIES

#: Rules of a shard, and bytes of rules that are sent to executors at a time.
SHARD, SENT = 1 << 17, 128_000_000
#: What Java's \b (with Unicode classes) takes for a character of a word.
_IN_WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]")
#: Between texts; no character.
_GAP = np.uint32(0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts with a gap behind each, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer("\U0010ffff".join([*texts, ""]).encode("utf-32-le"), np.uint32).copy() if texts else np.empty(0, np.uint32)
    begins = np.cumsum(sizes) - sizes
    raw[begins + sizes - 1] = _GAP
    return raw, begins


class Trie:
    """Finds which of some strings (none empty) occur in texts."""

    def __init__(self, strings: list[str]):
        """strings: sorted by their code points, each once."""
        self.codes, self.begins = _codes(strings)
        n = len(strings)
        sizes = np.diff(np.append(self.begins, len(self.codes))) - 1
        keys, children, ends, first_state = [], [], [], 0
        low, high, depth = np.array([0]), np.array([n]), 0  # the strings below each state of a level
        while len(low):
            count = high - low
            state = np.repeat(np.arange(len(low)), count)
            which = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            over = sizes[which] == depth  # a string that ends here is the first of its state
            end = np.full(len(low), -1, np.int64)
            end[state[over]] = which[over]
            ends.append(end)
            state, which = state[~over], which[~over]
            code = self.codes[self.begins[which] + depth].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (np.diff(state) != 0) | (np.diff(code) != 0)])) if len(state) else np.empty(0, np.int64)
            stop = np.append(new[1:], len(state)).astype(np.int64)
            size = stop - new
            keys.append((state[new] + first_state << 21) | code[new])
            child = -1 - which[new]  # a single string is compared, not walked
            branching = size > 1
            first_state += len(low)
            child[branching] = first_state + np.arange(branching.sum())
            children.append(child)
            low, high, depth = which[new][branching], which[new][branching] + size[branching], depth + 1
        # a worker has the tries of all shards that were sent, so numbers are small and there is no room for characters that no string begins with
        self.keys, self.children, self.ends = np.concatenate(keys), np.concatenate(children).astype(np.int32), np.concatenate(ends).astype(np.int32)
        at_root = self.keys < 1 << 21
        self.first = np.zeros(int(self.keys[at_root].max(initial=0)) + 2, np.int64)  # what a character leads to from the root; 0: nothing
        self.first[self.keys[at_root]] = self.children[at_root]
        self.begins, self.sizes = self.begins.astype(np.int32), sizes.astype(np.int32)

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which text and which string, each pair once."""
        raw, begins = _codes(texts)
        if not len(raw) or not len(self.sizes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = [(np.empty(0, np.int64),) * 2]
        state = self.first[np.minimum(raw, len(self.first) - 1)]
        at = np.flatnonzero(state)
        state, depth = state[at], 1
        while len(at):
            single = state < 0
            if single.any():  # compared from here on, character by character
                where, which, k = at[single], -1 - state[single], depth
                while len(where):
                    done = self.sizes[which] == k
                    found.append((where[done], which[done]))
                    where, which = where[~done], which[~done]
                    same = raw[where + k] == self.codes[self.begins[which] + k]
                    where, which, k = where[same], which[same], k + 1
                at, state = at[~single], state[~single]
            end = self.ends[state]
            found.append((at[end >= 0], end[end >= 0]))
            key = (state << 21) | raw[at + depth]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            alive = self.keys[place] == key
            at, state, depth = at[alive], self.children[place[alive]].astype(np.int64), depth + 1
        where, which = (np.concatenate(x) for x in zip(*found))
        text = np.searchsorted(begins, where, "right") - 1
        return np.divmod(np.unique(text * len(self.sizes) + which), len(self.sizes))


class Rules:
    """Rules with their trie: a shard's, as shards() has written them (by variant, then rank)."""

    def __init__(self, rows: pa.Table):
        """rows: rank, category (its number), variant, by, bounded."""
        self.ranks, self.categories, self.bounded = (rows[c].to_numpy() for c in ("rank", "category", "bounded"))
        self.variant, self.by = rows["variant"].combine_chunks(), rows["by"].combine_chunks()
        each = self.variant.to_pylist()
        first = [k for k, v in enumerate(each) if k == 0 or v != each[k - 1]]
        self.first = np.array([*first, len(each)], np.int32)
        self.trie = Trie([each[k] for k in first])
        self.used = set(np.unique(self.trie.codes).tolist())
        self.reach = int(self.trie.sizes.max(initial=0))

    def variants_in(self, texts: list[str]) -> list[list[int]]:
        """The variants (their numbers) that occur in each text."""
        out: list[list[int]] = [[] for _ in texts]
        for t, v in zip(*[x.tolist() for x in self.trie.find(texts)]):
            out[t].append(v)
        return out

    def in_texts(self, texts: list[str]) -> list[list[int]]:
        """The rules (rows) whose variants occur in each text."""
        return [[k for v in found for k in range(self.first[v], self.first[v + 1])] for found in self.variants_in(texts)]

    def after(self, v: int, rank: int) -> int | None:
        """The first rule (row) of a variant behind a rank."""
        begin, end = int(self.first[v]), int(self.first[v + 1])
        k = begin if self.ranks[begin] > rank else begin + int(np.searchsorted(self.ranks[begin:end], rank, "right"))
        return k if k < end else None


#: Ids whose variants a worker keeps.
KNOWN = 20_000


class Cascade:
    """All rules of some shards, run in turn on texts."""

    def __init__(self, shards: list[Rules]):
        self.shards, self.known = shards, {}

    def look(self, ids: list[str]) -> None:
        """Finds the variants (shard, number) within ids, all together."""
        if len(self.known) + len(ids) > KNOWN:
            self.known.clear()
        self.known |= {by: [] for by in ids}
        for s, r in enumerate(self.shards):
            for by, found in zip(ids, r.variants_in(ids)):
                self.known[by] += [(s, v) for v in found]

    def expect(self, found: list[list[tuple[int, int]]]) -> None:
        """Looks at ids that rules of these variants may insert, and at what may be inserted into those, as far as they are kept."""
        some = {x for own in found for x in own}
        seen: set[tuple[int, int]] = set()
        while some:
            ids = {self.shards[s].by[int(self.shards[s].first[v])].as_py() for s, v in some}
            new = [by for by in ids if by and by not in self.known][: KNOWN // 2]
            if len(self.known) + len(new) > KNOWN and seen:
                return
            self.look(new)
            seen |= some
            some = {x for by in new for x in self.known[by]} - seen

    def near(self, text: str, spans: list[tuple[int, int]], by: str) -> list[tuple[int, int]]:
        """Variants (shard, number) within an inserted id, or that reach into one of its places."""
        if by and by not in self.known:
            self.look([by])
        out = list(self.known[by]) if by else []
        for s, r in enumerate(self.shards):
            # only a variant with the id's first or last character can stand across its border
            if r.reach > 1 and (not by or ord(by[0]) in r.used or ord(by[-1]) in r.used):
                around = [text[max(0, b - r.reach + 1) : e + r.reach - 1] for b, e in spans]
                out += [(s, v) for found in r.variants_in(list(dict.fromkeys(around))) for v in found]
        return out

    def run(self, text: str, found: list[tuple[int, int]]) -> tuple[str, list[int]]:
        """The text after all rules and how often each category was replaced; found: the variants (shard, number) that it has at first."""
        counts, waiting, open_ = [0] * len(CATEGORIES), [], set()

        def wait(variants: list[tuple[int, int]], rank: int) -> None:
            for own in variants:
                if own not in open_ and (k := self.shards[own[0]].after(own[1], rank)) is not None:
                    open_.add(own)
                    heapq.heappush(waiting, (int(self.shards[own[0]].ranks[k]), k, own))

        wait(found, -1)
        while waiting:
            rank, k, own = heapq.heappop(waiting)
            open_.remove(own)
            r = self.shards[own[0]]
            variant, by = r.variant[k].as_py(), r.by[k].as_py()
            parts, spans, at, size = [], [], 0, 0
            place = text.find(variant)
            while place >= 0:
                stop = place + len(variant)
                if r.bounded[k] and not (edge(text, place) and edge(text, stop)):
                    place = text.find(variant, place + 1)
                    continue
                parts += (text[at:place], by)
                size += place - at
                spans.append((size, size + len(by)))
                size += len(by)
                at = stop
                place = text.find(variant, stop)
            if spans:
                text = "".join(parts) + text[at:]
                counts[r.categories[k]] += len(spans)
                wait(self.near(text, spans, by), rank)
            if variant in text:
                wait([own], rank)
        return text, counts

    def texts(self, texts: list[str]) -> list[tuple[str, list[int]]]:
        found: list[list] = [[] for _ in texts]
        for s, r in enumerate(self.shards):
            for own, ks in zip(found, r.variants_in(texts)):
                own += [(s, v) for v in ks]
        self.expect(found)
        return [self.run(t, f) for t, f in zip(texts, found)]


def edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    left = at > 0 and _IN_WORD.match(text[at - 1]) is not None
    right = at < len(text) and _IN_WORD.match(text[at]) is not None
    return left != right


SHARDS = "shard int, n long, size long, rules binary"


def shards(table: DataFrame, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The rules with their rank, and SHARDS: parts of them by rank, each an Arrow file that a task of its own has made. Both are written."""
    number = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).cast("int") - 1
    ranked = materialize(numbered(table, [F.col(c) for c in table.columns], "rank"))
    rows = ranked.select(F.floor(F.col("rank") / size).cast("int").alias("shard"), "rank", number.alias("category"), "variant", "by", "bounded")

    def packed(key: tuple[pa.Scalar, ...], rules: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        rules = rules.drop_columns(["shard"]).sort_by([("variant", "ascending"), ("rank", "ascending")])
        with pa.ipc.new_file(sink, rules.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_table(rules)
        columns = [pa.array([x], t) for x, t in zip((key[0].as_py(), rules.num_rows, rules.nbytes, sink.getvalue().to_pybytes()), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in SHARDS.split(", ")])

    return ranked, materialize(rows.groupBy("shard").applyInArrow(packed, SHARDS))


def together(written: DataFrame, most: int = SENT) -> list[list[int]]:
    """The shards that may be sent to executors at a time: such whose rules have at most so many bytes (or one)."""
    out, size = [], 0
    for r in written.select("shard", "size").orderBy("shard").toLocalIterator():
        if not out or size + r["size"] > most:
            out.append([])
            size = 0
        out[-1].append(r.shard)
        size += r["size"]
    return out


def sent(written: DataFrame, some: list[int]) -> tuple[str, Broadcast]:
    """A name, and the files of shards of bounded size, for loaded()."""
    files = [bytes(r.rules) for r in written.where(F.col("shard").isin(some)).orderBy("shard").select("rules").collect()]
    return uuid.uuid4().hex, written.sparkSession.sparkContext.broadcast(files)


_loaded: dict[str, list[Rules]] = {}


def loaded(name: str, files: Broadcast) -> list[Rules]:
    """The rules of shards that were sent, built once a worker (which keeps those it used last)."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = [Rules(pa.ipc.open_file(pa.py_buffer(x)).read_all()) for x in files.value]
    return _loaded[name]


def parts(values: list[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Texts in lists of so many characters at most (or one text)."""
    some, size = [], 0
    for v in values:
        if some and size + len(v or "") > most:
            yield some
            some, size = [], 0
        some.append(v)
        size += len(v or "")
    if some:
        yield some


def cascaded(text: Column, name: str, files: Broadcast) -> Column:
    """struct<text, counts>: the text after all rules of the shards that were sent, and replacements by category. Null stays null."""

    @F.arrow_udf("struct<text:string,counts:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Cascade(loaded(name, files))
        kind = pa.struct([("text", pa.string()), ("counts", pa.list_(pa.int64()))])
        for b in batches:
            out = []
            for at in range(0, len(b), 512):  # not all texts of a batch as Python's at once
                for some in parts(b.slice(at, 512).to_pylist()):
                    done = own.texts([t or "" for t in some])
                    out.append(pa.array([{"text": None if t is None else new, "counts": counts} for t, (new, counts) in zip(some, done)], kind))
            yield pa.concat_arrays(out) if out else pa.array([], kind)

    return run(text)


def met(texts: DataFrame, written: DataFrame, some: list[int]) -> DataFrame:
    """texts (_row, text): _row, rank of the rules of some shards whose variants occur there."""
    name, files = sent(written, some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(name, files)
        for b in batches:
            rows, at = b.column(0), 0
            for texts in parts(b.column(1).to_pylist()):
                for r in own:
                    found = r.in_texts([t or "" for t in texts])
                    index = np.repeat(np.arange(len(texts)), [len(x) for x in found]) + at
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array(index)), pa.array(r.ranks[np.array([k for x in found for k in x], np.int64)])], names=["_row", "rank"])
                at += len(texts)

    return texts.select("_row", "text").mapInArrow(run, "_row string, rank long")
