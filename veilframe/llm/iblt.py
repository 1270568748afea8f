"""Document fingerprints as invertible Bloom lookup tables of paragraphs.

A paragraph (a line with a word) is a 64-bit digest; a document is the set of its paragraphs' digests. A table has three
segments of cells; a digest is added to one cell of each: the cell counts it, XORs it, and XORs its check hash. The difference of two
tables of one size holds only the digests that one document has and the other hasn't. Peeling recovers them: a cell whose
count is 1 or -1 and whose check fits its digest holds just that one; it is noted and taken out of its other cells,
which may leave more such cells. If cells are left over, peeling failed and is tried again with larger tables.

A fingerprint is the number of digests and one table, with as many cells in a segment as the document has paragraphs (the next power
of two), and twice as many until the table can be peeled by itself. Tables of fewer cells are folds of it: cells whose places are equal in the lower bits add up. Two
fingerprints are compared by them alone: first a fold of BASE cells in a segment is subtracted and peeled, which a few differences
pass; then the largest that both have; then each table is peeled by itself, which gives the whole sets. Only for a document whose table can't be
peeled at any size (two of its digests would need equal check hashes, or an array more than LARGEST cells) the number of
differences is estimated, by the part of the difference's cells that are empty.

The likeness of two documents is the Jaccard similarity of their sets of paragraphs, from the sizes and the recovered digests.

Scale: tables are arrays in a row, filled from sorted items in near-linear time; only edits() shuffles, texts once: documents are dealt by ranges of doc_id (limits are approximate quantiles, at most
LIMITS of them, between which ids are cut evenly as often as needed), sorted within them, and see their successor; the first of a range goes
to the range before too, told by a join with one row per range, which is broadcast while Spark's threshold allows it.

Cases: null is the empty text, which has no paragraphs; two documents without paragraphs have likeness 1; of rows with equal ids the one with the larger
text hash comes first; null ids come last; a single document is its own successor; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, materialize, once, table, text_of

#: Cells in a segment of the smallest table, and of the largest that an array can be; rounds of peeling (each takes all that is pure, so few are needed);
#: how often a fingerprint's table is doubled at most (two digests that share all three cells part with 7 / 8 each time).
BASE, LARGEST, ROUNDS, DOUBLINGS = 4, 1 << 28, 100, 24
#: Documents in a range of ids, about; most limits that come to the driver.
RANGE, LIMITS = 2000, 10_000
FOUND = "array<struct<k:bigint,n:bigint>>"


def digests(text: Column) -> Column:
    """array<bigint>: the digests of the text's paragraphs, each once."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda p: p.rlike(r"[^\x20\x09-\x0D]")), lambda p: F.xxhash64(p)))


def check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(0))


def _slot(c: Column, segment: Column, size: Column) -> Column:
    """Place in a segment of a digest with check hash c; size is a power of two. Three times 21 bits of c; beyond them a hash of c adds upper ones."""
    low = F.call_function("shiftrightunsigned", c, 21 * segment).bitwiseAND(F.least(size, F.lit(1 << 21)).cast("bigint") - 1)
    high = F.when(size > 1 << 21, F.shiftleft(F.xxhash64(c, segment).bitwiseAND(F.shiftright(size, 21).cast("bigint") - 1), 21)).otherwise(F.lit(0).cast("bigint"))
    return (low + high).cast("int")


def _empty() -> Column:
    return F.struct(*[F.lit(0).cast("bigint").alias(x) for x in "nkc"])


def _cell(n: Column, a: Column, b: Column) -> Column:
    return F.struct(n.alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c"))


def _add(a: Column, b: Column) -> Column:
    return _cell(a["n"] + b["n"], a, b)


def cells(items: Column, size: Column) -> Column:
    """The table of some items (k, n: how often it counts): 3 * size cells. Items are sorted by their place, so that those of a cell stand together, and
    the cells between two places are empty."""

    def dense(p: Column) -> Column:
        at = lambda i: F.get(p, i)["at"]
        firsts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))

        def filled(f: Column) -> Column:
            own = lambda i, j: F.aggregate(F.slice(p, i + 1, F.coalesce(F.get(f, j + 1), F.size(p)) - i), _empty(), _add)
            gap = lambda i, j: at(i) - F.when(j > 0, at(F.get(f, j - 1)) + 1).otherwise(0)
            parts = F.transform(f, lambda i, j: F.concat(F.array_repeat(_empty(), gap(i, j)), F.array(own(i, j))))
            return F.concat(F.flatten(parts), F.array_repeat(_empty(), size - 1 - at(F.size(p) - 1)))

        return F.when(F.size(p) == 0, F.array_repeat(_empty(), size.cast("int"))).otherwise(let(firsts, filled))

    def segment(s: Column) -> Column:
        placed = F.transform(items, lambda x: let(check(x["k"]), lambda c: F.struct(_slot(c, s, size).alias("at"), x["k"].alias("k"), x["n"].alias("n"), c.alias("c"))))
        return let(F.sort_array(placed), dense)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), segment))


def folded(table: Column, size: Column, to: Column) -> Column:
    """A table of `size` cells in a segment as one of `to`: cells whose lower bits are equal add up."""

    def cell(i: Column) -> Column:
        begin = (i / to).cast("int") * size + i % to
        return F.aggregate(F.sequence(F.lit(0), (size / to).cast("int") - 1), _empty(), lambda acc, m: _add(acc, F.get(table, begin + m * to)))

    return F.when(size == to, table).otherwise(F.transform(F.sequence(F.lit(0), 3 * to - 1), cell))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x, y))


def peel(difference: Column, size: Column) -> Column:
    """struct<cells, found: array<struct<k,n>>, live> of a difference; it has been peeled if all cells are empty. n is 1 for
    digests of the first table, -1 for those of the second."""
    start = F.struct(difference.alias("cells"), F.array().cast(FOUND).alias("found"), F.lit(True).alias("live"))

    def rounds(acc: Column, _) -> Column:
        pure = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (check(c["k"]) == c["c"]))
        side = lambda n: F.transform(F.array_distinct(F.transform(F.filter(pure, lambda c: c["n"] == n), lambda c: c["k"])), lambda k: F.struct(k.alias("k"), F.lit(n).cast("bigint").alias("n")))  # noqa: E731  digests alone: their distinct ones are told by a hash
        new = F.concat(side(1), side(-1))

        def taken(found: Column) -> Column:
            left = F.struct(minus(acc["cells"], cells(found, size)).alias("cells"), F.concat(acc["found"], found).alias("found"), F.lit(True).alias("live"))
            return F.when(F.size(found) == 0, F.struct(acc["cells"].alias("cells"), acc["found"].alias("found"), F.lit(False).alias("live"))).otherwise(left)

        return F.when(acc["live"], let(new, taken)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.least(3 * size, F.lit(ROUNDS))), start, rounds)  # a round that finds nothing is the last that does anything


def _done(peeled: Column) -> Column:
    return F.size(_all_empty(peeled["cells"])) == F.size(peeled["cells"])


def _alone(f: Column) -> Column:
    """struct<keys, ok> of a fingerprint: the digests that its table peels to."""
    return let(peel(f["cells"], f["size"]), lambda p: F.struct(F.transform(p["found"], lambda x: x["k"]).alias("keys"), _done(p).alias("ok")))


def fingerprints(rows: DataFrame, sets: list[Column]) -> DataFrame:
    """rows with _f: for each array of digests, struct<f: the fingerprint (n, size, cells), set: struct<keys, ok>, what it peels to>.

    Its table is twice as large until it can be peeled by itself."""
    rows = once(rows, "_s", F.array(*[F.transform(x, lambda k: F.struct(k.alias("k"), F.lit(1).cast("bigint").alias("n"))) for x in sets]))

    def made(items: Column, size: Column) -> Column:
        f = F.struct(F.size(items).alias("n"), size.alias("size"), cells(items, size).alias("cells"))
        return let(f, lambda f: F.struct(f.alias("f"), _alone(f).alias("set")))

    def first(n: Column) -> Column:
        return F.least(F.lit(LARGEST), F.greatest(F.lit(BASE), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("int")))

    def enough(items: Column) -> Column:
        none = F.struct(F.struct(F.size(items).alias("n"), F.shiftright(first(F.size(items)), 1).alias("size"), F.array().cast("array<struct<n:bigint,k:bigint,c:bigint>>").alias("cells")).alias("f"), F.struct(F.array().cast("array<bigint>").alias("keys"), F.lit(False).alias("ok")).alias("set"))
        step = lambda acc, _: F.when(acc["set"]["ok"] | (acc["f"]["size"] >= LARGEST), acc).otherwise(let(acc["f"]["size"] * 2, lambda size: made(items, size)))
        return F.aggregate(F.sequence(F.lit(0), F.lit(DOUBLINGS)), none, step)

    return once(rows, "_f", F.transform("_s", enough)).drop("_s")


def _all_empty(table: Column) -> Column:
    return F.filter(table, lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))


def differing(rows: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """rows of fingerprints() with _d: for each pair of them struct<found: array<struct<k,n>>, ok, n: double>, the digests that one of two
    documents has, if they can be recovered, and how many there are (estimated if not). Each try is a step of its own."""
    places = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i, j in pairs])
    fingerprint = lambda i: F.get("_f", i)["f"]
    least = lambda a, b: F.least(a["size"], b["size"])
    apart = lambda a, b: F.abs(a["n"] - b["n"])

    def difference(a: Column, b: Column, size: Column) -> Column:
        return minus(*(folded(f["cells"], f["size"], size) for f in (a, b)))

    def attempt(p: Column, size_of) -> Column:
        a, b = fingerprint(p["a"]), fingerprint(p["b"])
        tried = let(size_of(a, b), lambda size: let(peel(difference(a, b, size), size), lambda r: F.struct(r["found"].alias("found"), _done(r).alias("ok"))))
        return F.when(apart(a, b) <= 2.5 * size_of(a, b), tried).otherwise(F.struct(F.array().cast(FOUND).alias("found"), F.lit(False).alias("ok")))  # more don't fit

    def whole(p: Column) -> Column:
        x, y = F.get("_f", p["a"])["set"], F.get("_f", p["b"])["set"]
        less = lambda p, q, n: F.transform(F.array_except(p, q), lambda k: F.struct(k.alias("k"), F.lit(n).cast("bigint").alias("n")))
        return F.struct(F.concat(less(x["keys"], y["keys"], 1), less(y["keys"], x["keys"], -1)).alias("found"), (x["ok"] & y["ok"]).alias("ok"))

    def counted(p: Column, r: Column) -> Column:
        a, b = fingerprint(p["a"]), fingerprint(p["b"])
        size = least(a, b)
        empty = F.size(_all_empty(difference(a, b, size)))
        about = F.when(empty > 0, -size.cast("double") * F.log(empty / (3.0 * size))).otherwise((a["n"] + b["n"]).cast("double"))
        n = F.when(r["ok"], F.size(r["found"]).cast("double")).otherwise(F.least((a["n"] + b["n"]).cast("double"), F.greatest(apart(a, b).cast("double"), about)))
        return F.struct(r["found"].alias("found"), r["ok"].alias("ok"), n.alias("n"))

    out = once(rows, "_d", F.transform(places, lambda p: attempt(p, lambda a, b: F.lit(BASE))))
    for again in (lambda p: attempt(p, least), whole):
        out = once(out, "_e", F.zip_with(places, "_d", lambda p, r: F.when(r["ok"], r).otherwise(again(p)))).drop("_d").withColumnRenamed("_e", "_d")  # noqa: B023
    return once(out, "_e", F.zip_with(places, "_d", counted)).drop("_d").withColumnRenamed("_e", "_d")


def written(f: Column) -> Column:
    """A fingerprint as a string: the number of digests, cells in a segment, and each cell's count, digest and check in hexadecimal (nothing for an empty one)."""
    number = lambda x: F.lower(F.hex(x))
    cell = lambda c: F.when((c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0), "").otherwise(F.concat_ws(".", *[number(c[x]) for x in "nkc"]))
    return F.concat_ws("-", number(f["n"]), number(f["size"]), F.array_join(F.transform(f["cells"], cell), "-"))


def likeness(n_a: Column, n_b: Column, n_different: Column) -> Column:
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a + n_b - n_different) / (n_a + n_b + n_different))


def _ranges(docs: DataFrame, size: int) -> Column:
    """The number of a row's range of ids, ascending; at most LIMITS limits come to the driver, more ranges are even parts between two of them."""
    n, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    parts = max(1, min(LIMITS, n // size))
    if low is None or n <= size:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("bigint")
    limits = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []
    limits = sorted({low, high + 1, *(limits or [])})
    more = max(1, n // (size * parts))
    width = max(1, int(len(limits) ** 0.5))
    groups = [limits[i : i + width] for i in range(0, len(limits), width)]
    tops, inner, every = F.lit([g[0] for g in groups]).cast("array<bigint>"), F.array(*[F.lit(g).cast("array<bigint>") for g in groups]), F.lit(limits).cast("array<bigint>")
    up_to = lambda x: F.size(F.filter(x, lambda b: b <= F.col("doc_id")))

    def numbered(k: Column) -> Column:  # ids from limit k on, below the next
        begin, end = F.get(every, k).cast("double"), F.get(every, k + 1).cast("double")
        even = F.floor((F.col("doc_id").cast("double") - begin) / (end - begin) * more)
        return k.cast("bigint") * more + F.least(F.lit(more - 1), F.greatest(F.lit(0), even))

    return F.when(F.col("doc_id").isNull(), -1).otherwise(let(up_to(tops) - 1, lambda top: let(top * width + up_to(F.get(inner, top)) - 1, numbered)))


def successors(docs: DataFrame, size: int = RANGE) -> DataFrame:
    """doc_id, text, next_text: of the next document in descending order of ids, after the last the first."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), _ranges(docs, size).alias("_range"))
    heads = rows.groupBy("_range").agg(F.max(F.struct("doc_id", "_h")).alias("k"))
    down = W.orderBy("_range")  # a row per range; the first of a range also goes to the range above it, that of the highest to the lowest
    heads = materialize(heads.select(F.col("k.doc_id").alias("_id"), F.col("k._h").alias("_hash"), F.coalesce(F.lead("_range").over(down), F.min("_range").over(W.partitionBy())).alias("_to")))
    lent = rows.join(heads, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash"))).select("doc_id", "text", "_h", F.col("_to").alias("_range"), F.lit(True).alias("_lent"))
    every = rows.withColumn("_lent", F.lit(False)).unionByName(lent)
    # what is lent to a range follows its own rows: the first of the range below, or the first of all
    seen = every.withColumn("next_text", F.lead("text").over(W.partitionBy("_range").orderBy("_lent", F.desc("doc_id"), F.desc("_h"))))
    return seen.where("NOT _lent").select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))


def edits(docs: DataFrame, size: int = RANGE) -> DataFrame:
    """doc_id, n_chars, text, edited, next_text: the last third of a text is replaced by the beginning of the next document."""
    out = successors(docs, size).withColumn("n_chars", F.length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - third), F.col("next_text").substr(F.lit(1), third))
    return out.select("doc_id", "n_chars", "text", edited.alias("edited"), "next_text")


def compare(rows: DataFrame) -> DataFrame:
    """rows with text, edited, next_text: their fingerprints and likenesses (text and edited, text and next)."""
    names = rows.columns
    rows = differing(fingerprints(rows, [digests(F.col(c)) for c in ("text", "edited", "next_text")]), [(0, 1), (0, 2)])
    of = lambda i: F.get("_f", F.lit(i))["f"]
    near = lambda i: likeness(of(0)["n"], of(i)["n"], F.get("_d", F.lit(i - 1))["n"])
    out = F.struct(written(of(0)).alias("fingerprint"), written(of(1)).alias("edited_fingerprint"), near(1).alias("near_edited"), near(2).alias("near_next"))
    return rows.select(*names, out.alias("_r"))


def op7_iblt_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare(edits(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "_r.fingerprint", "_r.edited_fingerprint", "_r.near_edited", "_r.near_next")
