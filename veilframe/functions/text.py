"""Column functions on texts: the stages between a file's content and what is detected or written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags: U as Python's re on str, d as Python's idea of a line end, m multi-line, s dot matches all, i ignore case.
LINES = "(?Umd)"
#: Matches nothing, nowhere: with such a character in a pattern Java looks back by code points, without it by halves of letters beyond U+FFFF.
WIDE = "(?:\U0010ffff){0}"
HYPHEN = rf"(?<=[\p{{L}}\p{{Nd}}]{WIDE})-\n(?=[\p{{L}}\p{{Nd}}])"


def let(value: Column, body) -> Column:
    """body(x) with x bound to a value that is so evaluated once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, with_before=lambda x, y: x + y) -> Column:
    """What each value of an array is together with all before it (their sum): rounds of doubled distance, n log n steps in all."""
    rounds = F.ceil(F.log2(F.size(values))).cast("int")
    step = lambda acc, r: let(F.call_function("shiftleft", F.lit(1), r), lambda far: F.transform(acc, lambda x, i: F.when(i < far, x).otherwise(with_before(x, F.get(acc, i - far)))))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), rounds - 1), values, step))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def tex_to_prose(text: Column) -> Column:
    """Commands up to the next white space or brace, environments and runs of white space become a space."""
    out = F.regexp_replace(text, r"(?Ud)\\[\w]+.*?(\s|})", " ")
    out = F.regexp_replace(out, r"(?Uds)\\begin\{.*?\}.*?\\end\{.*?\}", " ")
    return stripped(F.regexp_replace(out, r"(?U)\s+", " "))


def hyphen_joined(text: Column) -> Column:
    """Words that a hyphen and a line end part are joined."""
    return F.when(F.contains(text, F.lit("-\n")), F.regexp_replace(text, HYPHEN, "")).otherwise(text)


def hyphen_cuts(text: Column) -> Column:
    """array<int>: places in the joined text where two characters were taken out, ascending: running sums of what stands between."""
    lengths = F.transform(F.split(text, HYPHEN, -1), lambda p: F.length(p))
    cuts = let(lengths, lambda n: F.slice(let(n, lambda e: running(e)), F.lit(1), F.size(n) - 1))
    return F.when(F.contains(text, F.lit("-\n")), cuts).when(text.isNotNull(), F.array().cast("array<int>"))


def original_start(start: Column, cuts: Column) -> Column:
    return start + 2 * F.size(F.filter(cuts, lambda c: c <= start))


def original_end(end: Column, cuts: Column) -> Column:
    return end + 2 * F.size(F.filter(cuts, lambda c: c < end))


def typst_markup(text: Column) -> Column:
    """Markdown headings, emphasis and links as Typst, in a fixed order of rewrites (italic before bold)."""
    for level in range(1, 5):
        text = F.regexp_replace(text, rf"{LINES}^#{{{level}}}\s+(.*)$", "=" * level + " $1")
    for pattern, by in ((r"\*(.*?)\*", "_$1_"), (r"\*\*(.*?)\*\*", "*$1*"), (r"__(.*?)__", "*$1*"), (r"\[(.*?)\]\((.*?)\)", '#link("$2")[$1]')):
        text = F.regexp_replace(text, "(?Ud)" + pattern, by)
    return text


def normalized_name(name: Column) -> Column:
    out = F.lower(name)
    for old, new in (("å", "aa"), ("æ", "ae"), ("ø", "oe"), ("-", ""), ("\n", " ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def normalized_number(number: Column) -> Column:
    return F.translate(number, " -()+", "")


#: Words that no name contains.
NOT_NAMES = ("multiline", "phone", "account", "code", "street")


def valid_name(name: Column) -> Column:
    """One to three words, a letter in each, none of them a word that no name contains."""
    return let(words(name), lambda w: F.size(w).between(1, 3) & F.forall(w, lambda x: x.rlike(r"\p{L}")) & ~F.exists(w, lambda x: F.lower(x).isin(*NOT_NAMES)))


def possible_variant(short: Column, full: Column) -> Column:
    """Whether the words of a name are, in order, words (or beginnings with a full stop) of a name with more words."""

    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]

        def step(acc: Column, word: Column) -> Column:
            fits = lambda k: (F.get(b, k) == word) | (word.endswith(".") & (F.length(word) <= 4) & F.get(b, k).startswith(word.substr(1, 1)))
            later = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda k: (k >= acc) & fits(k))
            return F.when(acc < 0, acc).otherwise(F.coalesce(F.get(later, F.lit(0)) + 1, F.lit(-1)))

        return F.when((F.size(a) >= F.size(b)) | (F.size(a) == 0), F.lit(False)).otherwise(F.aggregate(a, F.lit(0), step) > 0)

    return let(F.struct(words(normalized_name(short)).alias("a"), words(normalized_name(full)).alias("b")), of)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: rows of the table of prefixes, one per character of a."""

    def of(x: Column) -> Column:
        chars, zero = F.split(x["b"], ""), F.transform(F.sequence(F.lit(0), F.length(x["b"])), lambda _: F.lit(0))

        def row(above: Column, c: Column) -> Column:
            cell = lambda acc, j: F.concat(acc, F.array(F.when(F.get(chars, j - 1) == c, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.get(acc, j - 1)))))
            return F.aggregate(F.sequence(F.lit(1), F.length(x["b"])), F.array(F.lit(0)), cell)

        return F.when((F.length(x["a"]) == 0) | (F.length(x["b"]) == 0), 0).otherwise(F.array_max(F.aggregate(F.split(x["a"], ""), zero, row)))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def indel_similarity(a: Column, b: Column) -> Column:
    """0 to 100: twice the longest common subsequence to both lengths; two empty texts are alike."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, F.lit(100.0)).otherwise(200.0 * common_subsequence(a, b) / n)


def masked_digits(text: Column, digits: Column) -> Column:
    """The text with its digits replaced in turn by those of another."""
    is_digit = lambda c: c.rlike(r"\p{Nd}")
    step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(is_digit(c), digits.substr(acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + is_digit(c).cast("int")).alias("at"))
    return F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step)["out"]


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)\D", ""))


def fake_digits(key: Column, n: Column, seed: int = 0) -> Column:
    """n digits that depend on a key alone, the first not 0."""
    digit = lambda i: F.pmod(F.xxhash64(key, i, F.lit(seed)), F.when(i == 0, 9).otherwise(10)) + F.when(i == 0, 1).otherwise(0)
    return F.when(n < 1, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: digit(i).cast("string")), ""))


def literal(text: Column) -> Column:
    """A text as a regular expression for itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def replacement(text: Column) -> Column:
    """A text as a replacement for itself."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def count_literal(text: Column, part: Column) -> Column:
    """How often a part that isn't empty occurs, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint")
