"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Kinds with a definition of their own (email, ip, card, phone: the base) are always kept once their checks hold. Further
kinds (iban by mod 97, ssn and secret) are kept from a score on: what the pattern is worth, plus what a nearby context word adds.
All spans are in code points, end exclusive.

The patterns are the stated ones in a form whose time is linear in the text and whose matching needs no stack: a match can
only begin where a run begins (or right after the match before), groups that repeat are possessive, and a card is asked for
as a whole run of 13 to 19 digits at once.

Scale: everything happens inside a row; nothing is shuffled. Spark has no function for the places of all matches, so they
come from the gaps that split() leaves and the matches, by a running sum; what stands before a match comes from there too, and masking
joins its parts once. So finding and masking take time in proportion to text and matches (times the logarithm of these).

Cases: a null text is empty and has no spans; rows with equal doc_id are judged one by one; very long texts and runs cost time in
proportion; an empty table gives an empty result; other columns are ignored by find() and carried along by mask()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import places_with
from ..functions.text import running
from .common import let, table, text_of

#: The patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])"
BASE = ("email", "ip", "card", "phone")
#: kind: score of the pattern with its checks, context words, what a context word adds. A span is kept from LEAST on.
SCORES = {
    "email": (0.9, ("mail", "contact", "e-mail"), 0.1), "ip": (0.6, ("ip", "server", "host", "address"), 0.3), "card": (0.8, ("card", "visa", "credit", "payment"), 0.2), "phone": (0.7, ("phone", "tel", "call", "mobile"), 0.3),
    "iban": (0.9, ("iban", "account", "bank"), 0.1), "ssn": (0.4, ("ssn", "social", "security"), 0.4), "secret": (0.4, ("token", "key", "secret", "password"), 0.4),
}
LEAST = 0.6
#: Characters before a span in which a context word counts, and that each pattern's matches have at least.
NEARBY, SHORTEST = 40, 4


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """A string of digits; every second one from the right counts twice, less 9 above 9."""

    def of(d: Column) -> Column:
        n = F.length(d)
        value = lambda i: d.substr(n - i, F.lit(1)).cast("int")
        twice = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, twice(value(i))).otherwise(value(i))) % 10 == 0

    return let(number, of)


def mod97(code: Column) -> Column:
    """An IBAN: the first four characters go last, letters count 10 to 35, the number leaves 1 when divided by 97."""
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda v: (F.length(v) <= 3) & (F.coalesce(v.try_cast("int"), F.lit(0)) <= 255)))


def spans(text: Column, of_bytes: bool = False) -> Column:
    """array<struct<kind, s, e, score>>, by kind as listed, then start. text isn't null and is a variable or a column. With of_bytes
    also b and c, the places in bytes."""
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string" + (",b:int,c:int>>" if of_bytes else ">>"))

    def kept(kind: str, pattern: str, holds, may: Column | None = None) -> Column:
        found = places_with(text, pattern, NEARBY, SHORTEST, of_bytes)
        found = F.filter(found if may is None else F.when(may, found).otherwise(none), holds)
        base, words, more = SCORES[kind]

        def scored(x: Column) -> Column:
            near = F.lower(x["before"]).rlike(r"(?<![a-z])(?:" + "|".join(words) + ")")
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("s"), x["end"].alias("e"), (F.lit(base) + F.when(near, more).otherwise(0.0)).alias("score"), *[x[c].alias(c) for c in "bc" if of_bytes])

        return F.filter(F.transform(found, scored), lambda x: (x["score"] >= LEAST) | F.lit(kind in BASE))

    return F.concat(
        kept("email", EMAIL, lambda x: F.lit(True), text.contains("@")),
        kept("ip", IP, lambda x: octets(x["m"])),
        kept("card", CARD, lambda x: luhn(digits(x["m"]))),
        kept("phone", PHONE, lambda x: F.length(digits(x["m"])).between(9, 15), text.contains("+")),
        kept("iban", IBAN, lambda x: mod97(x["m"])),
        kept("ssn", SSN, lambda x: F.lit(True)),
        kept("secret", SECRET, lambda x: F.lit(True)),
    )


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and found, a row per document."""
    return docs.select("doc_id", let(text_of(), lambda t: spans(t)).alias("found"))


def masked(text: Column, found: Column) -> Column:
    """The text with each span (of spans() with places in bytes) replaced by its kind in brackets; of spans that overlap, the first to begin (then the
    longest) names the whole. Parts are cut from the text's bytes, where a cut costs what it takes, and are joined once."""
    ordered = F.sort_array(F.transform(found, lambda x: F.struct(x["b"].alias("b"), (-x["c"]).alias("c"), x["kind"].alias("kind"))))
    reach = lambda o: let(F.transform(o, lambda x: -x["c"]), lambda e: running(e, F.greatest))  # noqa: E731  the furthest end so far

    def joined(y: Column) -> Column:
        raw, spans_, ends = y["raw"], y["o"], y["reach"]
        until = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        cut = lambda b, e: F.substring(raw, b + 1, e - b).cast("string")
        part = lambda x, i: F.when(x["b"] >= until(i), F.concat(cut(until(i), x["b"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return F.concat(F.array_join(F.transform(spans_, part), ""), cut(F.get(ends, F.size(spans_) - 1), F.octet_length(raw)))

    whole = let(ordered, lambda o: let(F.struct(text.cast("binary").alias("raw"), o.alias("o"), reach(o).alias("reach")), joined))
    return F.when(F.size(found) == 0, text).otherwise(whole)


def mask(docs: DataFrame) -> DataFrame:
    """The documents with their spans masked, all columns; n_chars follows the text, a null text stays null."""
    text = F.when(F.col("text").isNotNull(), let(text_of(), lambda t: let(spans(t, True), lambda f: masked(t, f))))
    out = docs.withColumn("text", text)  # in its place
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
