"""Places of matches, and arrays of spans: struct<entity_type, start, end, score>, in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, running

SPAN = "struct<entity_type:string,start:int,end:int,score:double>"
NONE = f"array<{SPAN}>"


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of all matches and what they match: running sums over the gaps between them and the matches."""

    def of(x: Column) -> Column:
        ends = let(F.transform(x["found"], lambda m, i: F.length(F.get(x["gaps"], i)) + F.length(m)), lambda e: running(e))
        return let(ends, lambda e: F.transform(x["found"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("m"))))

    # most texts have no match of most patterns: that is known after one pass, and ends at the first match of the others
    found = let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), of)
    return F.when(F.rlike(text, F.lit(pattern)), found).when(text.isNotNull(), F.array().cast("array<struct<start:int,end:int,m:string>>"))


def places_with(text: Column, pattern: str, before: int, shortest: int, of_bytes: bool = False) -> Column:
    """places() with before: so many characters at most that stand before a match; shortest: characters that a match has at least. With of_bytes also
    b and c: where a match begins and ends in the text's bytes. What stands before is joined from the gaps and matches next to it, so no match costs
    more the later it comes."""
    pieces = 2 * (before // shortest + 2)
    last = lambda x: F.right(x, F.lit(before))
    size = lambda x: F.struct(F.length(x).alias("n"), F.octet_length(x).alias("b")) if of_bytes else F.length(x)
    plus = lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), (x["b"] + y["b"]).alias("b")) if of_bytes else x + y

    def of(x: Column) -> Column:
        near = F.flatten(F.transform(x["found"], lambda m, i: F.array(last(F.get(x["gaps"], i)), last(m))))
        ends = let(F.transform(x["found"], lambda m, i: plus(size(F.get(x["gaps"], i)), size(m))), lambda e: running(e, plus))

        def match(e: Column, near: Column, m: Column, i: Column) -> Column:
            end = F.get(e, i)["n"] if of_bytes else F.get(e, i)
            begin = F.greatest(2 * i + 2 - pieces, F.lit(1))
            context = last(F.array_join(F.slice(near, begin, 2 * i + 2 - begin), ""))
            more = [(F.get(e, i)["b"] - F.octet_length(m)).alias("b"), F.get(e, i)["b"].alias("c")] if of_bytes else []
            return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m"), context.alias("before"), *more)

        return let(F.struct(ends.alias("e"), near.alias("near")), lambda y: F.transform(x["found"], lambda m, i: match(y["e"], y["near"], m, i)))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), of)


def span(entity_type, start: Column, end: Column, score) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(entity_type).alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), as_column(score).cast("double").alias("score"))


def ordered(spans: Column, priority: list[str]) -> Column:
    """Best first: score, then start, then length, then type."""
    rank = lambda s: F.array_position(F.array(*[F.lit(p) for p in priority]), s["entity_type"])
    keyed = F.transform(spans, lambda s: F.struct((-s["score"]).alias("a"), s["start"].alias("b"), (s["start"] - s["end"]).alias("c"), rank(s).alias("d"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda k: k["s"])


def without_contained(spans: Column, priority: list[str]) -> Column:
    """Spans that no better span of the same type contains."""
    inside = lambda x, y: (x["entity_type"] == y["entity_type"]) & (y["start"] <= x["start"]) & (x["end"] <= y["end"])
    return _greedy(F.filter(spans, lambda s: s["score"] > 0), inside, priority)


def disjoint(spans: Column, priority: list[str]) -> Column:
    """Best first, each unless it overlaps one that was taken."""
    return _greedy(spans, lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"]), priority)


def _greedy(spans: Column, clash, priority: list[str]) -> Column:
    """Best first, each unless it clashes with one that was taken; result in that order. Only spans that hang together by overlaps can
    clash, so each such group is settled by itself."""

    def settled(some: Column) -> Column:
        return F.when(F.size(some) == 1, some).otherwise(F.aggregate(ordered(some, priority), F.array().cast(NONE), lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x)))))

    def parted(x: Column) -> Column:  # spans by start, and the largest end until each
        sorted_, reach = x["s"], x["reach"]
        firsts = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | (F.get(sorted_, i)["start"] >= F.get(reach, i - 1)))
        return let(firsts, lambda f: F.flatten(F.transform(f, lambda i, k: let(F.slice(sorted_, i + 1, F.coalesce(F.get(f, k + 1), F.size(sorted_)) - i), settled))))

    by_start = F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s")))), lambda k: k["s"])
    reach = lambda s: let(F.transform(s, lambda x: x["end"]), lambda e: running(e, F.greatest))
    parts = let(by_start, lambda s: let(F.struct(s.alias("s"), reach(s).alias("reach")), parted))
    return let(spans, lambda x: F.when(F.size(x) < 2, x).otherwise(ordered(parts, priority)))


def words_in(text: Column) -> Column:
    """The words of a text with their places."""
    return places(text, r"(?U)\w+")


def boosted(words: Column, spans: Column, context: tuple[str, ...], by: float = 0.35, tokens: int = 5) -> Column:
    """Scores raised (to 1 at most) where one of the words before a span contains a context word; words are words_in() its text."""

    def of(s: Column) -> Column:
        # the words that begin before the span, by bisection
        halve = lambda acc, _: let(F.floor((acc["low"] + acc["high"]) / 2).cast("int"), lambda mid: F.when(acc["low"] >= acc["high"], acc).when(F.get(words, mid)["start"] < s["start"], F.struct((mid + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), mid.alias("high"))))
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(words) + 1)).cast("int"))
        n = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(words).alias("high")), halve)["low"]
        last = lambda k: F.transform(F.slice(words, F.greatest(k - tokens + 1, F.lit(1)), F.least(F.lit(tokens), k)), lambda w: w["m"].substr(F.lit(1), s["start"] - w["start"]))
        near = let(n, lambda k: F.exists(last(k), lambda w: F.lower(w).rlike("|".join(context))))
        return span(s["entity_type"], s["start"], s["end"], F.when(near, F.least(s["score"] + by, F.lit(1.0))).otherwise(s["score"]))

    return F.transform(spans, of)
