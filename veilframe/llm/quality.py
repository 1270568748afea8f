"""Quality rules: base counts and the divergence of a document from its language's reference histograms.

Two histograms describe a document: how often each character class occurs, and how often each common word of its language
does (all other words are one more bin). The references of a language are the pooled histograms of all its documents that
pass the base rules and the length guard; of a language with too few of them only the character classes are judged, against all
languages' together, so that a language of a few odd documents isn't its own reference. A document is compared with them by
Jensen-Shannon distance (the square root of the divergence to base 2, so 0 to 1); one that is farther than a threshold is rejected.
Guards: a histogram over fewer symbols than its guard asks for is noise and isn't judged, nor is one without a reference.

Scale: one narrow pass, in which each text is measured once, computes the counts of a text inside its row (no word or window is
shuffled); the references are an aggregation with partial sums to a row per language. The counts are written once, a few numbers per
document, and read for the references and for the verdicts.

Cases: a null or empty text has no words, so it fails the base rules; a null language is a language of its own; languages
without a list of common words are judged by character classes alone; rows with equal doc_id are judged one by one; an empty
table gives an empty result; other columns are ignored by measure() and carried along by keep()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, forget, let, materialize, once, packed, table, text_of, total, unpacked

#: Common words by language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was", "with", "as", "be", "by", "are", "this", "at", "from"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "sur", "au", "avec"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"),
}
SYMBOLS = "#*$%&|<>"
#: Character classes: lower case, upper case, white space, digits, sentence marks, other.
CLASSES = 6
#: Farthest allowed from the reference, and fewest symbols that are judged: characters, words.
FAR_CLASSES, FAR_WORDS = 0.28, 0.30
LEAST_CHARS, LEAST_WORDS = 200, 80
#: Documents that a language's own references are made of at least.
LEAST_DOCS = 20


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: windows sorted by hash tell the repeated starts, their union is counted."""

    def of(pairs: Column) -> Column:
        n = F.size(pairs)
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        twice = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce((i > 0) & same(i, i - 1), F.lit(False)) | F.coalesce((i < n - 1) & same(i, i + 1), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda i: F.get(pairs, i)["i"]))
        return let(starts, lambda s: total(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))).cast("bigint"))))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(
        let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of)
    )


def _of_words(words: Column, lang: Column) -> Column:
    n = F.size(words)
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    lists = F.array().cast("array<string>")
    for k, v in COMMON.items():
        lists = F.when(lang == k, F.array(*[F.lit(x) for x in v])).otherwise(lists)
    every = sorted({x for v in COMMON.values() for x in v})
    common = F.filter(words, lambda w: w.isin(every))
    counts = let(F.struct(common.alias("w"), lists.alias("l")), lambda x: F.transform(x["l"], lambda v: F.size(F.filter(x["w"], lambda w: w == v)).cast("bigint")))
    return F.struct(n.cast("bigint").alias("n_words"), let(windows, _covered).alias("n_repeat_words"), counts.alias("common"))


def _of_chars(text: Column) -> Column:
    """Lengths of what is left as one class after the other is taken away."""
    less = lambda x, p: F.regexp_replace(x, p, "")
    n = lambda x: F.length(x).cast("bigint")

    def rest(a: Column) -> Column:  # without lower case
        def of(b: Column) -> Column:  # nor white space
            return let(
                let(less(b, r"\p{Lu}+"), lambda c: let(less(c, "[0-9]+"), lambda d: F.array(n(c), n(d), n(less(d, r"[.,;:!?'\x22()-]+"))))),
                lambda m: F.struct(
                    F.array(n(text) - n(a), n(b) - m[0], n(a) - n(b), m[0] - m[1], m[1] - m[2], m[2]).alias("classes"),
                    (n(text) - n(a) + n(b)).alias("word_chars"), (n(b) - n(F.translate(b, SYMBOLS, ""))).alias("n_symbols"),
                ),
            )

        return let(less(a, SPACE + "+"), of)

    return let(less(text, r"\p{Ll}+"), rest)


def measures(text: Column, lang: Column) -> Column:
    """A struct of all counts of a text that isn't null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    words = let(F.array_remove(F.split(text, SPACE + "+", -1), ""), lambda w: _of_words(w, lang))
    return F.struct(words.alias("w"), _of_chars(text).alias("c"), dup.alias("n_dup_lines"))


def _measured(rows: DataFrame, text: Column, lang: Column) -> DataFrame:
    """rows with the base counts and the histograms of a text that isn't null; each text is measured once."""
    m = once(rows, "_c", let(F.struct(text.alias("t"), lang.alias("l")), lambda x: measures(x["t"], x["l"])))
    common = F.col("_c.w.common")
    m = m.select(*rows.columns, "_c.w.n_words", "_c.c.word_chars", "_c.c.n_symbols", "_c.n_dup_lines", "_c.w.n_repeat_words", "_c.c.classes", F.when(F.size(common) > 0, F.concat(common, F.array(F.col("_c.w.n_words") - total(common)))).otherwise(common).alias("common"))
    return m.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and the histograms, a row per document."""
    return _measured(docs.select("doc_id", "lang", text_of().alias("_t")), F.col("_t"), F.col("lang")).drop("_t")


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of as many bins, 0 to 1; null if one is empty."""

    def of(p: Column, q: Column, n: Column, m: Column) -> Column:
        def part(x: Column, y: Column) -> Column:
            mid = (x + y) / 2
            half = lambda v: F.when(v > 0, v * F.log2(v / mid)).otherwise(0.0)
            return (half(x) + half(y)) / 2

        return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(p, q, lambda x, y: part(x / n, y / m)), "double")))

    n, m = total(counts), total(reference)
    return F.when((n > 0) & (m > 0), of(counts, reference, n.cast("double"), m.cast("double")))


def references(measured: DataFrame, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A row per language: pooled histograms of the documents that pass the base rules and the guards, if there are enough; else
    the character classes of all languages together, and no words."""
    most = max(map(len, COMMON.values())) + 1
    fit = ~F.col("base_failed") & (F.col("n_words") >= least_words) & (total(F.col("classes")) >= least_chars)
    sums = measured.groupBy("lang").agg(
        F.count_if(fit).alias("n_docs"), *[F.sum(F.when(fit, F.col("classes")[k]).otherwise(0)).alias(f"c{k}") for k in range(CLASSES)],
        *[F.sum(F.when(fit, F.get("common", F.lit(k)))).alias(f"w{k}") for k in range(most)],
    )
    sums = materialize(sums.select("lang", "n_docs", F.array(*[F.col(f"c{k}") for k in range(CLASSES)]).alias("classes"), F.filter(F.array(*[F.col(f"w{k}") for k in range(most)]), lambda x: x.isNotNull()).alias("words")))
    pooled = F.array(*[F.lit(x or 0).cast("bigint") for x in sums.agg(*[F.sum(F.col("classes")[k]) for k in range(CLASSES)]).first()])  # six numbers
    enough = F.col("n_docs") >= least_docs
    return sums.select(F.col("lang").alias("_lang"), F.when(enough, F.col("classes")).otherwise(pooled).alias("_classes"), F.when(enough, F.col("words")).alias("_common"))


def verdicts(measured: DataFrame, refs: DataFrame, far_classes: float = FAR_CLASSES, far_words: float = FAR_WORDS, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds class_distance, word_distance (null where not judged) and kept."""
    out = measured.join(refs, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    out = out.withColumn("class_distance", F.when(total(F.col("classes")) >= least_chars, distance(F.col("classes"), F.col("_classes"))))
    out = out.withColumn("word_distance", F.when((F.col("n_words") >= least_words) & (F.size("common") > 0), distance(F.col("common"), F.col("_common"))))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= far_classes) & (F.coalesce("word_distance", F.lit(0.0)) <= far_words)
    return out.withColumn("kept", ~F.col("base_failed") & near).drop("_lang", "_classes", "_common")


def judge(docs: DataFrame) -> DataFrame:
    measured = materialize(measure(docs))
    return verdicts(measured, references(measured))


def keep(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is kept, all their columns. The references come from a pass of their own; the verdict is
    part of the row's own projection, so texts aren't shuffled to meet it (but for the join with the few references)."""
    slim = materialize(measure(docs))
    refs = references(slim)
    forget(slim)
    rows = packed(docs).select("_m", F.col("_m.lang").alias("lang"))
    return unpacked(verdicts(_measured(rows, F.coalesce(F.col("_m.text"), F.lit("")), F.col("lang")), refs).where("kept"), docs.columns)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
