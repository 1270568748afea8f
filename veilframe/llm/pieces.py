"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has an edge for every vocabulary piece that matches at a place, with its log probability (the model's, or by
Zipf's law from the order of a merge model, whose N best are so this module's and not the library's), and one for each character that isn't a piece itself, with less than any piece's score; such a character is written as byte pieces. The best
path is found by a forward Viterbi pass. Its scores, the best from the start to each place, are exact heuristics for a
backward A* search from the end: paths leave the queue in order of their whole score, so the first N are the N best.
Ties are settled in a fixed way.

No piece goes beyond a word (a run of spaces and what follows, up to the next space or line end), so a text's lattice falls apart
there. Forward (and, for the least loss of any alternative, backward) passes run over all new words of a batch at once, place
by place; A* runs over the words of a text whose alternatives lose least, and the text's N best are put together from those.
That is exact: the N best of a sum of independent parts use, besides the best of each, only the N - 1 parts with the least losses.

Scale: a row needs no other row; nothing is shuffled. The memory of a worker is bounded (two generations of KEPT words).

Cases: a null or empty text has no pieces and one segmentation of score 0; every other text decodes to itself, white space,
line ends and characters outside the vocabulary included (but the mark itself, U+2581, becomes a space); with fewer than N segmentations all are returned; rows with equal
ids are treated one by one; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

BEST = 3
#: Ranks at the head of a merge model's order whose probabilities are about equal.
FLAT = 300
#: Scores are multiples of 1 / GRAIN, so that sums are exact in any order, and equal ones equal.
GRAIN = 1 << 20
SPACE = "▁"
MARK = SPACE.encode()


def log_probabilities(scores: dict[int, float]) -> dict[int, float]:
    """Scores that a lattice can add up. A unigram model's are log probabilities and stay. Those of a merge model are whole numbers, the places
    of its merges, most frequent first; sums of places mean nothing, so the piece of rank r gets the probability 1 / (r + FLAT) of the
    Zipf-Mandelbrot law: the first merges are mostly steps to longer pieces and seldom stand by themselves."""
    if any(s != int(s) for s in scores.values()):
        return scores
    ranked = sorted(scores, key=lambda i: (-scores[i], i))
    whole = math.log(sum(1 / (r + FLAT) for r in range(1, len(ranked) + 1)))
    return {i: -math.log(r + FLAT) - whole for r, i in enumerate(ranked, 1)}


class Model:
    """Pieces, scores and bytes of a SentencePiece file."""

    KEPT = 100_000
    #: Longer words are learned apart from shorter ones.
    LONG = 40
    loaded: dict[tuple[str, int], "Model"] = {}

    def __init__(self, path: str, best: int = BEST):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size, self.best = sp.get_piece_size(), best
        byte, skip = {}, set()
        for i in range(size):
            if sp.is_byte(i):
                byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                skip.add(i)
        self.bytes = [byte[b] for b in range(256)]
        byte_of = {i: b for b, i in byte.items()}
        self.spelled = pa.array([bytes([byte_of[i]]) if i in byte_of else b"" if i in skip else sp.id_to_piece(i).encode() for i in range(size)], pa.large_binary())
        own = {i: sp.get_score(i) for i in range(size) if i not in skip and i not in byte_of}
        self.pieces = {sp.id_to_piece(i): (round(s * GRAIN) / GRAIN, i) for i, s in log_probabilities(own).items()}
        self.unknown = min(s for s, _ in self.pieces.values()) - 10
        self.prefixes = {p[:i] for p in self.pieces for i in range(1, len(p))}
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.pieces):
            raise ValueError("a piece has a mark or a line end behind another character")
        # a trie in arrays: children by (node, code point), and what ends at a node
        nodes = {p: k for k, p in enumerate(sorted(self.prefixes | self.pieces.keys()), 1)}
        self.score, self.id = np.zeros(len(nodes) + 1), np.full(len(nodes) + 1, -1, np.int64)
        self.root, keys = np.zeros(0x110000, np.int64), []
        for p, k in nodes.items():
            if p in self.pieces:
                self.score[k], self.id[k] = self.pieces[p]
            if len(p) == 1:
                self.root[ord(p)] = k
            else:
                keys.append((nodes[p[:-1]] * 0x110000 + ord(p[-1]), k))
        keys.sort()
        self.keys, self.child = np.array([k for k, _ in keys]), np.array([c for _, c in keys])
        self.words: dict[str, tuple[bytes, float, float]] = {}
        self.old: dict[str, tuple[bytes, float, float]] = {}
        self.ranks: dict[str, list] = {}

    @classmethod
    def of(cls, path: str, best: int = BEST) -> "Model":
        if (path, best) not in cls.loaded:
            cls.loaded[path, best] = cls(path, best)
        return cls.loaded[path, best]

    def forget(self) -> None:
        """Gives back the memory of the words, for whatever the worker does next."""
        self.words, self.old, self.ranks = {}, {}, {}
        pa.default_memory_pool().release_unused()

    def edges(self, chunk: str) -> list[list[tuple[int, float, int]]]:
        """For each place the edges that end there: (from, score, id); id -1 is a character as bytes."""
        n, into = len(chunk), [[] for _ in range(len(chunk) + 1)]
        pieces, prefixes = self.pieces, self.prefixes
        for i in range(n):
            if chunk[i] not in pieces:
                into[i + 1].append((i, self.unknown, -1))
            j = i + 1
            while j <= n:
                p = chunk[i:j]
                if p in pieces:
                    into[j].append((i, *pieces[p]))
                if p not in prefixes:
                    break
                j += 1
        return into

    def forward(self, into: list) -> list[float]:
        best = [0.0]
        for edges in into[1:]:
            best.append(max(best[i] + s for i, s, _ in edges))
        return best

    def backward(self, into: list, best: list[float], n: int) -> list[tuple[float, tuple]]:
        """The n best paths (score, edges in order): A* from the end, the forward scores being exactly what is left.

        Of equal whole scores the path that is nearest to the start goes on, so ties don't widen the search. Paths are chains."""
        heap, out, turn = [(-best[-1], len(into) - 1, 0, 0.0, None)], [], 0
        while heap and len(out) < n:
            _, at, _, score, path = heapq.heappop(heap)
            if at == 0:
                edges = []
                while path:
                    edges.append(path[:2])
                    path = path[2]
                out.append((score, edges))
                continue
            for i, s, piece in into[at]:
                turn += 1
                heapq.heappush(heap, (-(best[i] + s + score), i, turn, score + s, (i, piece, path)))
        return out

    def ids(self, word: str, path: list) -> bytes:
        out = []
        for start, i in path:
            if i >= 0:
                out.append(i)
            else:
                out += [self.bytes[b] for b in word[start].encode()]
        return np.asarray(out, "<u4").tobytes()

    def searched(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """The n best of a word, by A*."""
        into = self.edges(word)
        return [(s, self.ids(word, p)) for s, p in self.backward(into, self.forward(into), n)]

    def ranked(self, word: str) -> list[tuple[float, bytes]]:
        """The best of a word, as learned, and the next ones (loss, ids)."""
        out = self.ranks.get(word)
        if out is None:
            best, score, _ = self.words[word]
            got = [(score - s, x) for s, x in self.searched(word, self.best)]
            rest = [x for x in got if x[1] != best]
            out = self.ranks[word] = [(0.0, best), *(rest if len(rest) < len(got) else rest[1:])]
        return out

    def learn(self, words: list[str]) -> None:
        """ids, score and least loss of an alternative of each word: forward and backward passes over all of them at once."""
        for long in (False, True):  # long ones among themselves, so that few words wait for the places of one
            some = [w for w in words if (len(w) > self.LONG) == long]
            ends = np.cumsum([len(w) for w in some])
            while len(some):
                n = max(1, int(np.searchsorted(ends, 250_000, "right")))
                self._learn(some[:n])
                some, ends = some[n:], ends[n:] - ends[n - 1]

    def _learn(self, words: list[str]) -> None:
        size = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        word, end = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size)
        # edges: place of the first character, length, score, id
        at, node, parts = np.arange(len(chars)), self.root[chars], []
        strange = np.flatnonzero(self.id[node] < 0)
        parts.append((strange, np.ones(len(strange), np.int64), np.full(len(strange), self.unknown), np.full(len(strange), -1)))
        length = 1
        while len(at):
            good = self.id[node] >= 0
            parts.append((at[good], np.full(int(good.sum()), length), self.score[node[good]], self.id[node[good]]))
            more = (node > 0) & (at + length < end[at])
            at, node = at[more], node[more]
            key = node * 0x110000 + chars[at + length]
            found = np.searchsorted(self.keys, key)
            found[found == len(self.keys)] = 0
            hit = self.keys[found] == key
            at, node, length = at[hit], self.child[found[hit]], length + 1
        at, step, score, piece = (np.concatenate(x) for x in zip(*parts))
        w = word[at]
        first = np.cumsum(size) - size
        low = at - first[w]
        high, base = low + step, (first + np.arange(len(words)))[w]  # a word has one place more than characters
        words_bits, place_bits = len(words).bit_length(), int(size.max()).bit_length()  # a batch's words and characters are bounded, so three fit into 63 bits
        order = np.argsort((((high << words_bits) | w) << place_bits) | low)  # by end, word, beginning
        w, low, high, base, score, piece = w[order], low[order], high[order], base[order], score[order], piece[order]
        places = len(chars) + len(words)
        ahead, behind, by = np.zeros(places), np.zeros(places), np.zeros(places, np.int64)
        limits = np.searchsorted(high, np.arange(1, size.max() + 2))
        for a, b in zip(limits, limits[1:]):  # each place from left to right: the best edge into it, the longest of equals
            value, to = ahead[base[a:b] + low[a:b]] + score[a:b], base[a:b] + high[a:b]
            group = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            top = np.maximum.reduceat(value, group)
            ahead[to[group]] = top
            reached = np.flatnonzero(value == np.repeat(top, np.diff([*group, b - a])))[::-1]
            by[to[reached]] = reached + a
        back = np.argsort(((size.max() - low) << words_bits) | w, kind="stable")  # from the last beginning to the first
        limits = np.searchsorted(-low[back], np.arange(-size.max() + 1, 2))
        for a, b in zip(limits, limits[1:]):
            e = back[a:b]
            value, of = behind[base[e] + high[e]] + score[e], base[e] + low[e]
            group = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            behind[of[group]] = np.maximum.reduceat(value, group)
        last = first + np.arange(len(words)) + size
        best, on, now, live = ahead[last], np.zeros(len(w), bool), last.copy(), np.arange(len(words))
        while len(live):
            e = by[now]
            on[e] = True
            now, go = base[e] + low[e], low[e] > 0
            now, live = now[go], live[go]
        other = np.where(on, -np.inf, ahead[base + low] + score + behind[base + high])
        least = np.full(len(words), -np.inf)
        np.maximum.at(least, w, other)
        path = np.flatnonzero(on)
        path = path[np.lexsort((low[path], w[path]))]
        ends = np.searchsorted(w[path], np.arange(len(words) + 1)).tolist()
        raw = piece[path].astype("<u4").tobytes()
        loss, scores = (best - least).tolist(), best.tolist()
        for k, x in enumerate(words):
            self.words[x] = (raw[4 * ends[k] : 4 * ends[k + 1]], scores[k], loss[k])
        for k in np.unique(w[path[piece[path] < 0]]).tolist():
            rows = path[ends[k] : ends[k + 1]]
            self.words[words[k]] = (self.ids(words[k], list(zip(low[rows].tolist(), piece[rows].tolist()))), scores[k], loss[k])

    def batch(self, texts: pa.Array) -> list[tuple]:
        """The N best of each text: ((score, bytes of ids), ...)."""
        if len(self.words) > self.KEPT:
            self.old, self.words = self.words, {}
        if len(self.ranks) > self.KEPT:
            self.ranks = {}
        large = pa.large_string()
        mark = next(c for c in map(chr, range(1, 0xD800)) if not pc.any(pc.match_substring(texts, c)).as_py())  # a character that isn't in the texts
        texts = pc.binary_join_element_wise(pa.scalar(SPACE, large), pc.replace_substring(texts.cast(large), " ", SPACE), pa.scalar("", large))
        cut = pc.replace_substring_regex(texts, f"([^{SPACE}])({SPACE})", f"\\1{mark}\\2")
        cut = pc.replace_substring(cut, "\n", f"{mark}\n{mark}")
        lists = pc.split_pattern(cut, mark)
        coded = pc.dictionary_encode(lists.values)
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.words[""] = (b"", 0.0, math.inf)
        known = list(map(self.words.get, distinct))
        if None in known:
            missing = [p for p, x in zip(distinct, known) if x is None]
            self.words.update((p, self.old[p]) for p in missing if p in self.old)
            self.learn([p for p in missing if p not in self.old])
            known = list(map(self.words.get, distinct))
        ids, scores, losses = zip(*known) if known else ((), (), ())
        values, sizes = pa.array(ids, pa.large_binary()), np.array([len(x) for x in ids], np.int64)[at] if known else at
        ends, first = np.concatenate([[0], np.cumsum(sizes)]), lists.offsets.to_numpy()
        data = bytes(pc.take(values, coded.indices).buffers()[2] or b"")
        score, loss, out = np.concatenate([[0.0], np.cumsum(np.array(scores)[at])]) if known else None, np.array(losses)[at] if known else None, []
        for k in range(len(texts)):
            a, b = first[k], first[k + 1]
            best, total, mine = data[ends[a] : ends[b]], float(score[b] - score[a]), loss[a:b]
            if len(best) == 0 or texts[k].as_buffer().size == len(MARK):  # an empty text
                out.append(((0.0, b""),))
                continue
            n = min(self.best - 1, len(mine))
            near = np.sort(np.argpartition(mine, n - 1)[:n]) if n else ()
            near = [i for i in near if mine[i] < math.inf]
            ways = [self.ranked(distinct[at[a + i]]) for i in near]
            got = [(total, best)]
            for lost, picks in least_sums([[x for x, _ in r] for r in ways], self.best)[1:]:
                done, parts = a, []
                for i, way, pick in zip(near, ways, picks):
                    parts += (data[ends[done] : ends[a + i]], way[pick][1])
                    done = a + i + 1
                got.append((total - lost, b"".join([*parts, data[ends[done] : ends[b]]])))
            out.append(tuple(got))
        return out

    def segment(self, text: str) -> tuple:
        return self.batch(pa.array([text]))[0]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """UTF-8 texts of ids: what their pieces spell, byte pieces among them, with spaces for marks and without the first one."""
        spelled = pc.take(self.spelled, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))
        if not len(spelled):
            return [b""] * len(ids)
        ends = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1)
        data, last = bytes(spelled.buffers()[2]), np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
        return [data[ends[i] : ends[j]].replace(MARK, b" ")[1:] for i, j in zip(last, last[1:])]


def least_sums(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums of one loss from each list (each ascending from 0), with their places: a queue of successors."""
    start = (0,) * len(losses)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        lost, picks = heapq.heappop(heap)
        out.append((lost, picks))
        for k in range(len(losses)):
            if picks[k] + 1 < len(losses[k]):
                after = (*picks[:k], picks[k] + 1, *picks[k + 1 :])
                if after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (lost - losses[k][picks[k]] + losses[k][picks[k] + 1], after))
    return out


def _mapped(docs: DataFrame, path: str, n: int, schema: str, of) -> DataFrame:
    """of(model, texts, N best of each) gives the columns behind doc_id."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [KINDS[x.split(maxsplit=1)[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path, n)
        for b in batches:
            for some in slices(b, 1, 1200, 4_000_000):
                columns = of(model, some.column(1), model.batch(some.column(1)))
                yield pa.RecordBatch.from_arrays([some.column(0).cast(kinds[0]), *[pa.array(x, k) for x, k in zip(columns, kinds[1:])]], names=names)
        model.forget()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def encode(docs: DataFrame, path: str, n: int = BEST) -> DataFrame:
    """doc_id, scores and ids (little-endian 32-bit) of the n best segmentations."""
    return _mapped(docs, path, n, "doc_id long, scores array<double>, ids array<binary>", lambda m, texts, best: ([[s for s, _ in x] for x in best], [[i for _, i in x] for x in best]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of the best segmentation of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode() for x in model.decode(b.column(1).to_pylist())], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.get("ids", F.lit(0)).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, n: int = BEST) -> DataFrame:
    """Per document: n_pieces, pieces_crc32, scores and checksums of the n best, and whether the best decodes to the text."""

    def of(model: Model, texts: pa.Array, best: list[tuple]) -> tuple:
        first = [x[0][1] for x in best]
        back = [x == t.as_buffer().to_pybytes() for x, t in zip(model.decode(first), texts)]
        return [len(x) // 4 for x in first], [zlib.crc32(x) for x in first], [x[0][0] for x in best], [[s for s, _ in x] for x in best], [[zlib.crc32(i) for _, i in x] for x in best], back

    return _mapped(docs, path, n, "doc_id long, n_pieces long, pieces_crc32 long, best_score double, n_best_scores array<double>, n_best_crc32 array<bigint>, round_trip boolean", of)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
