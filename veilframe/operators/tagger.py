"""A tagger of names and places, trained in Spark: a linear chain over tokens, weights by an averaged structured perceptron, the best labels
by Viterbi.

Features of a token are hashed: its letters, beginning, end and shape, and those of its neighbours. A token's scores are then the sum of what
its own word, the word before and the word after bring along, so each word is looked at once a batch, however often it stands there.
All sentences of a batch go through the chain together, the longest first.

Training is iterated parameter mixing: in each round every shard of the sentences starts from the same weights and goes once through its own, and the
mean of what the shards end with starts the next round. Labels can be silver: where names from a dictionary stand in texts. All sentences are
trained on, copies each: their shards have a bounded size (SHARD) and are read batch by batch, and weights have a fixed size; tagging is a narrow step over all texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import forget
from ..functions.frames import materialize as kept
from . import automaton
from .rewrite import rules

TYPES = ("PERSON", "LOCATION")
#: Labels by number: 0 is none, then the first and the further tokens of each type.
LABELS = 1 + 2 * len(TYPES)
#: Hashed features, different sentences of a shard (about), shards that are trained apart at least, rounds.
BUCKETS, SHARD, SHARDS, ROUNDS = 1 << 17, 50_000, 8, 5
TOKEN = re.compile(r"\w+(?:['’-]\w+)*|[^\w\s]|\n")
_ENDS = frozenset(".!?\n")


def shape(word: str) -> str:
    """Kinds of characters, each run as one."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1+", kinds)


def features(word: str) -> np.ndarray:
    """Places in the weights of what a word says of itself (8), of the word after it (3) and of the one before it (3)."""
    low, form = word.lower(), shape(word)
    own = (f"w={low}", f"s={form}", f"e={low[-3:]}", f"f={low[-2:]}", f"b={low[:3]}", f"c={low[:2]}", f"l={form}{min(len(word), 9)}", "any")
    side = (low, form, low[-2:])
    named = [*own, *[f"-{k}{x}" for k, x in enumerate(side)], *[f"+{k}{x}" for k, x in enumerate(side)]]
    return np.array([zlib.crc32(x.encode()) % BUCKETS for x in named], np.int64)


#: The same of words met again.
hashed = lru_cache(maxsize=100_000)(features)
OWN, SIDE = 8, 3
_EDGE = np.stack([features("\x02"), features("\x03")])  # before and behind a sentence


class Chain:
    """Weights, and what they say of sentences."""

    def __init__(self, emit: np.ndarray | None = None, follow: np.ndarray | None = None):
        self.emit = np.zeros((BUCKETS, LABELS)) if emit is None else emit
        self.follow = np.zeros((LABELS + 1, LABELS)) if follow is None else follow  # the last row: at the begin of a sentence
        self.rows: dict[str, int] = {}

    @classmethod
    def of(cls, flat: np.ndarray) -> "Chain":
        return cls(flat[: BUCKETS * LABELS].reshape(BUCKETS, LABELS), flat[BUCKETS * LABELS :].reshape(LABELS + 1, LABELS))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.emit.ravel(), self.follow.ravel()])

    def labels(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each sentence."""
        words = list(dict.fromkeys(w for s in sentences for w in s))
        number = {w: k for k, w in enumerate(words)}
        ids = np.concatenate([np.stack([features(w) for w in words]), _EDGE]) if words else _EDGE
        scores = self.emit[ids]
        own, after, before = (scores[:, a:b].sum(1) for a, b in ((0, OWN), (OWN, OWN + SIDE), (OWN + SIDE, OWN + 2 * SIDE)))
        order = sorted(range(len(sentences)), key=lambda k: -len(sentences[k]))
        sizes = np.array([len(sentences[k]) for k in order], np.int64)
        begins = np.cumsum(sizes) - sizes
        flat = np.array([number[w] for k in order for w in sentences[k]], np.int64)
        first, last = len(words), len(words) + 1
        left, right = np.concatenate([[first], flat[:-1]]), np.concatenate([flat[1:], [last]])
        some = sizes > 0
        left[begins[some]] = first
        right[begins[some] + sizes[some] - 1] = last
        emitted = own[flat] + after[left] + before[right] if len(flat) else np.zeros((0, LABELS))
        alive = int(some.sum())
        best, back = self.follow[-1] + emitted[begins[:alive]], []
        for t in range(1, int(sizes[0]) if alive else 0):
            n = int(np.searchsorted(-sizes, -t, "left"))  # sentences longer than t
            ways = best[:n, :, None] + self.follow[None, :-1]
            back.append(ways.argmax(1))
            best[:n] = ways.max(1) + emitted[begins[:n] + t]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sentences)
        labels = np.zeros(len(flat), np.int64)
        now = best.argmax(1)
        for t in range(len(back), -1, -1):
            n = int(np.searchsorted(-sizes, -t, "left"))
            if t < len(back):
                m = len(back[t])
                now[:m] = back[t][np.arange(m), now[:m]]
            labels[begins[:n] + t] = now[:n]
        for k, b, n in zip(order, begins.tolist(), sizes.tolist()):
            out[k] = labels[b : b + n]
        return out

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best labels of sentences one behind the other; ids: a row of features a token."""
        emitted, begins = self.emit[ids].sum(1), np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        sizes, begins = sizes[order], begins[order]
        best, back = self.follow[-1] + emitted[begins], []
        for t in range(1, int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t, "left"))
            ways = best[:n, :, None] + self.follow[None, :-1]
            back.append(ways.argmax(1))
            best[:n] = ways.max(1) + emitted[begins[:n] + t]
        out, now = np.zeros(len(ids), np.int64), best.argmax(1)
        for t in range(len(back), -1, -1):
            if t < len(back):
                m = len(back[t])
                now[:m] = back[t][np.arange(m), now[:m]]
            n = int(np.searchsorted(-sizes, -t, "left"))
            out[begins[:n] + t] = now[:n]
        return out

    def learned(self, sentences: Iterable[tuple]) -> np.ndarray:
        """Mean of the weights while they go through labelled sentences (words, labels, and how many copies of it follow each other) once: a sentence that gets wrong labels
        moves them. Until one does, weights stay, so sentences are looked at many together, and again only behind the first that is wrong."""
        spent = np.zeros_like(self.emit), np.zeros_like(self.follow)
        at = 0

        def moved(ids: np.ndarray, gold: np.ndarray, guess: np.ndarray) -> None:
            wrong = guess != gold
            for label, sign in ((gold, 1.0), (guess, -1.0)):
                np.add.at(self.emit, (ids[wrong], label[wrong, None]), sign)
                np.add.at(spent[0], (ids[wrong], label[wrong, None]), sign * at)
                before = np.concatenate([[LABELS], label[:-1]])
                np.add.at(self.follow, (before, label), sign)
                np.add.at(spent[1], (before, label), sign * at)

        for some in batched(sentences, 4096):
            sizes = np.array([len(x[0]) for x in some], np.int64)
            begins = np.append(0, np.cumsum(sizes))
            number: dict[str, int] = {}
            flat = np.array([number.setdefault(w, len(number)) for x in some for w in x[0]], np.int64)
            rows = np.concatenate([np.stack([hashed(w) for w in number]), _EDGE])
            left, right = np.append(len(number), flat[:-1]), np.append(flat[1:], len(number) + 1)
            left[begins[:-1]], right[begins[1:] - 1] = len(number), len(number) + 1
            ids, gold = np.concatenate([rows[flat, :OWN], rows[left, OWN : OWN + SIDE], rows[right, OWN + SIDE :]], 1), np.concatenate([x[1] for x in some])
            copies, long = [x[2] if len(x) > 2 else 1 for x in some], np.append(np.flatnonzero(sizes > 64), len(some))
            k, ahead = 0, 16
            while k < len(some):
                stop = min(k + ahead, max(k + 1, int(long[np.searchsorted(long, k)])))  # long ones alone
                guess = self.decoded(ids[begins[k] : begins[stop]], sizes[k:stop])
                wrong = guess != gold[begins[k] : begins[stop]]
                if not wrong.any():
                    at += sum(copies[k:stop])
                    k, ahead = stop, min(2 * ahead, 512)
                    continue
                j = int(np.searchsorted(begins, begins[k] + int(wrong.argmax()), "right")) - 1
                at += sum(copies[k:j])
                own = slice(begins[j], begins[j + 1])
                guess, left_ = guess[begins[j] - begins[k] : begins[j + 1] - begins[k]], copies[j]
                while left_ and (guess != gold[own]).any():
                    at, left_ = at + 1, left_ - 1
                    moved(ids[own], gold[own], guess)
                    guess = self.decoded(ids[own], sizes[j : j + 1]) if left_ else guess
                at += left_
                ahead = max(8, 2 * (j - k))
                k = j + 1
        return np.concatenate([(self.emit - spent[0] / (at + 1)).ravel(), (self.follow - spent[1] / (at + 1)).ravel()])


def sentences_of(text: str) -> list[list[tuple[str, int]]]:
    """Tokens with their places, a list a sentence."""
    out, now = [], []
    for m in TOKEN.finditer(text):
        if m[0] != "\n":
            now.append((m[0], m.start()))
        if m[0] in _ENDS and now:
            out.append(now)
            now = []
    return [*out, now] if now else out


def spans_of(tokens: list[tuple[str, int]], labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Type, begin and end of what the labels mark."""
    out: list[tuple[str, int, int]] = []
    before = 0
    for (word, at), label in zip(tokens, labels.tolist()):
        if label:
            kind = TYPES[(label - 1) // 2]
            if label % 2 == 0 and before in (label, label - 1):
                out[-1] = (kind, out[-1][1], at + len(word))
            else:
                out.append((kind, at, at + len(word)))
        before = label
    return out


class Tagger:
    """A trained tagger; model() is for Registry.add_model."""

    def __init__(self, weights: np.ndarray, score: float = 0.85):
        self.weights, self.score = weights, score

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        chain, each = Chain.of(self.weights), [sentences_of(t) for t in texts]
        labels = iter(chain.labels([[w for w, _ in s] for found in each for s in found]))
        return [[x for s in found for x in spans_of(s, next(labels))] for found in each]

    def model(self):
        """A function on batches with rows (doc_id, text), as the registry takes."""
        own, score = self, self.score

        def run(batches):
            import pandas as pd

            for b in batches:
                rows = [(d, *x, score) for d, found in zip(b.doc_id, own.spans(b.text.tolist())) for x in found]
                yield pd.DataFrame(rows, columns=["doc_id", "entity_type", "start", "end", "score"])

        return run

    def save(self, spark: SparkSession, path: str) -> None:
        some = np.flatnonzero(self.weights)
        spark.createDataFrame(pa.table({"k": some, "value": self.weights[some]})).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Tagger":
        return cls(dense(spark.read.parquet(path)))


def dense(rows: DataFrame) -> np.ndarray:
    """Weights from rows k, value: at most as many as there are weights, whatever the input."""
    out = np.zeros(BUCKETS * LABELS + (LABELS + 1) * LABELS)
    got = rows.select("k", "value").toArrow()
    out[got["k"].to_numpy()] = got["value"].to_numpy()
    return out


LABELLED = "tokens array<string>, labels array<int>"


def silver(docs: DataFrame, dictionary: DataFrame, most: int | None = None) -> DataFrame:
    """LABELLED sentences of the documents (text; equal ones once): tokens where a person or location of a dictionary (long form) stands
    are labelled so, the longest name first, all others are not. An empty dictionary gives no sentences. most: about so many documents, by a hash, for who wants no more."""
    wanted = dictionary.where(F.col("category").isin("person", "location"))
    texts = docs.where("text IS NOT NULL")
    if most is not None:
        texts = texts.where(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 30)) < int(most / max(most, texts.count(), 1) * (1 << 30)))
    texts = kept(texts.select(F.sha2("text", 256).alias("_row"), "text").dropDuplicates(["_row"]))
    ranked, written = automaton.shards(rules(wanted))
    found = None
    for some in automaton.together(written):
        part = kept(automaton.met(texts, written, some))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], LABELLED)
    own = found.join(ranked.select("rank", "category", "variant"), "rank").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("rank", "category", "variant"))).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, labels = [], []
            for text, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                taken = np.zeros(len(text), np.int8)  # 0: free, else the type; negative: where one begins
                for n in names or []:
                    kind, size = (1 if n["category"] == "person" else 2), len(n["variant"])
                    at = text.find(n["variant"])
                    while at >= 0:
                        if automaton.edge(text, at) and automaton.edge(text, at + size) and not taken[at : at + size].any():
                            taken[at : at + size] = kind
                            taken[at] = -kind
                        at = text.find(n["variant"], at + 1)
                for s in sentences_of(text):
                    kinds = [int(taken[at]) for _, at in s]
                    tokens.append([w for w, _ in s])
                    labels.append([0 if k == 0 else 2 * abs(k) - (k < 0) for k in kinds])
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))], names=["tokens", "labels"])

    return texts.join(own, "_row", "left").select("text", "names").mapInArrow(run, LABELLED)


def trained(labelled: DataFrame, rounds: int = ROUNDS, shards: int = SHARDS, size: int = SHARD) -> Tagger:
    """labelled: LABELLED sentences, all of which are used: in so many shards at least, and in as many as have about `size` different sentences."""
    spark = labelled.sparkSession
    some = kept(labelled.where(F.size("tokens") > 0).groupBy("tokens", "labels").agg(F.count("*").alias("copies")))
    shards = max(shards, -(-some.count() // size))
    dealt = some.select(F.pmod(F.xxhash64("tokens", F.lit(7)), F.lit(shards)).alias("shard"), F.xxhash64("tokens", F.lit(1)).alias("at"), "tokens", "labels", "copies")
    ordered = dealt.repartition(2 * shards, "shard").sortWithinPartitions("shard", "at", "tokens", "labels")  # twice, so that few partitions have several
    weights = np.zeros(BUCKETS * LABELS + (LABELS + 1) * LABELS)
    total = np.zeros_like(weights)
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(weights)

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = ((w, np.array(x), n) for b in batches for w, x, n in zip(*[b[c].to_pylist() for c in ("tokens", "labels", "copies")]))
            first = start.value  # noqa: B023
            chain = Chain.of(first.copy())
            mean = chain.learned(own)
            last = chain.flat()
            k = np.flatnonzero((last != first) | (mean != first))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(last[k] - first[k]), pa.array(mean[k] - first[k])], names=["k", "value", "mean"])

        out = kept(ordered.groupBy("shard").applyInArrow(run, "k long, value double, mean double").groupBy("k").agg(F.sum("value").alias("value"), F.sum("mean").alias("mean")))
        more, mean = (np.round(dense(out.select("k", F.col(c).alias("value"))) / shards, 9) for c in ("value", "mean"))  # sums come in any order
        total += weights + mean
        weights = weights + more
        start.destroy()
        forget(out)
    forget(some)
    return Tagger(total / max(rounds, 1))
