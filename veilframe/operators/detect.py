"""Detectors, and the DataFrame operators from texts to resolved, mapped spans.

A detector is a pattern with a type, a score, context words and a language. A registry holds those of a session; further
detectors are patterns, or functions on batches of rows for models that are no pattern (operators/tagger.py has one)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar, phones
from ..functions import spans as S
from ..functions.frames import materialize, numbered_within, once
from ..functions.text import WIDE, hyphen_cuts, hyphen_joined, original_end, original_start, stripped

#: Fixed values, in the order that ties and outputs follow.
CATEGORIES = ("person", "email_address", "location", "phone_number", "date_number", "id_number", "code_number", "general_number")
CATEGORY_OF = {
    "PERSON": "person", "EMAIL_ADDRESS": "email_address", "LOCATION": "location", "PHONE_NUMBER": "phone_number", "DATE_TIME": "date_number",
    "GENERAL_NUMBER": "general_number", "DATE_NUMBER": "date_number", "ID_NUMBER": "id_number", "CODE_NUMBER": "code_number",
}
#: Which type wins where score, start and length are equal.
PRIORITY = ["EMAIL_ADDRESS", "PERSON", "LOCATION", "DATE_NUMBER", "DATE_TIME", "ID_NUMBER", "CODE_NUMBER", "PHONE_NUMBER", "GENERAL_NUMBER"]
FLAGS = "(?Uims)"


#: What a match of most detectors contains: texts without any are common, and known after one pass for all of them.
DIGIT = r"\p{Nd}"


@dataclass(frozen=True)
class Detector:
    entity_type: str
    name: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("en", "da")
    flags: str = FLAGS
    group: str = ""  # detectors of a group are one recognizer; its type where empty
    check: Callable[[Column], Column] | None = field(default=None, compare=False)  # what a match has to fulfil besides
    has: str = ""  # what every match contains: DIGIT or this text; texts without it aren't searched
    near: str = ""  # a pattern that finds something wherever this one does and takes less time; texts in which it doesn't aren't searched

    @property
    def regex(self) -> str:
        return self.flags + self.pattern


#: Words near a number that raise its score, and the patterns.
NUMBER_CONTEXT = ("account", "phone", "code", "number", "id", "tel", "mobil", "cpr", "personnummer")
PATTERNS = (
    ("GENERAL_NUMBER", "general_number", r"[+(\d][\d\.\-,/()+ ]*\d(?:[.,+][a-zA-Z]{1,3})?", 0.7, NUMBER_CONTEXT),
    ("GENERAL_NUMBER", "digit_sequence", r"\b\d{4,6}\b", 0.8, NUMBER_CONTEXT),
    ("GENERAL_NUMBER", "four_digit_code", r"\b\d{4}\b", 0.6, NUMBER_CONTEXT),
    ("GENERAL_NUMBER", "cpr_number", r"\b\d{6}-\d{4}\b", 0.6, NUMBER_CONTEXT),
    ("DATE_NUMBER", "date_number", r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b", 0.7, ()),
    ("DATE_NUMBER", "dotted_triplet", r"\d{2}\.\d{2}\.\d{2}", 0.7, ()),
    ("ID_NUMBER", "id_code", r"\b\d{3,}[-\d]{3,}\s*\(\d{3,}\)\b", 0.8, ()),
    ("ID_NUMBER", "year_based_id", r"\b\d{4}-\d{5}\b", 0.8, ()),
    ("CODE_NUMBER", "parenthesized_code", r"\(\d{6}\)", 0.8, ()),
    ("CODE_NUMBER", "channel_identifier", r"\b\d{1,2},\d{1,2}\.[a-zA-Z]{2,3}\b", 0.7, ()),
)
#: Given names by which a person is recognised without a model, and what streets end in.
GIVEN = (
    "john jon jane james mary robert patricia michael jennifer david linda william elizabeth richard barbara joseph susan thomas jessica charles sarah christopher karen daniel lisa "
    "matthew nancy anthony betty mark sandra donald ashley steven emily paul kimberly andrew margaret joshua donna kenneth michelle kevin carol brian amanda george melissa edward laura "
    "alice bob peter anna anne emma lars mette jens søren niels hans henrik kirsten hanne lene maria ole per christian camilla louise ida freja sofie magnus mikkel rasmus anders"
).split()
STREETS = "St|Street|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Square"
#: Top-level domains of addresses that count as e-mail addresses.
DOMAINS = "com|org|net|edu|gov|io|info|biz|eu|dk|de|uk|us|se|no|fi|fr|es|it|nl|be|ch|at|pl|pt|ie|cz|ru|cn|jp|in|au|ca|br|dev|app|ai|co|me|tv"
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
def branching(words: list[str]) -> str:
    """A pattern for any of some words that tells them apart letter by letter instead of trying one after the other."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[:1], []).append(w[1:])
    end = "" in tails
    some = "|".join(c + branching(t) for c, t in sorted(tails.items()) if c)
    return f"(?:{some})?" if end and some else f"(?:{some})" if len(tails) > 1 else some


NATIVE = (
    ("EMAIL_ADDRESS", "email", rf"(?<![\w.%+-]{WIDE})[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{{1,63}}\.){{1,20}}(?i-u:{DOMAINS})\b", 1.0, "(?U)"),
    ("PHONE_NUMBER", "phone", rf"(?<![\w+]{WIDE})(?:\+\d{{1,3}}[ -]?)?(?:\(\d{{3}}\) ?\d{{3}}-\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|\d{{2}} \d{{2}} \d{{2}} \d{{2}}|\d{{10}}|\d{{8}})(?!\w)", 0.4, "(?U)"),
    ("PERSON", "given_name", rf"(?<!\w{WIDE})(?:(?i:{branching(GIVEN)}))(?:[ \n]\p{{Lu}}\.)?(?:[ \n](?!(?i:and|or|og)\b)\p{{Lu}}[\p{{L}}'-]*){{1,2}}(?!\w)", 0.85, "(?U)"),
    ("LOCATION", "street_en", rf"(?<!\w{WIDE})\d+[A-Za-z]? (?:\p{{Lu}}[\p{{L}}'-]* ){{1,3}}(?:{STREETS})\b\.?(?:, \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?)?(?:, \p{{Lu}}{{2,3}}\b)?", 0.85, "(?U)"),
    ("LOCATION", "street_da", rf"(?<!\w{WIDE})\p{{Lu}}\p{{L}}*(?:gade|vej|allé|stræde|plads|torv) \d+ ?[A-Za-z]?(?:, ?(?:\d+\.? ?(?:tv|th|mf)|st)\.?)?(?:, \d{{4}} \p{{Lu}}\p{{L}}+)?", 0.85, "(?U)"),
    ("DATE_TIME", "month_date", rf"(?<!\w{WIDE})(?:\d{{1,2}}\.? (?:{MONTHS})\.?,? \d{{4}}|(?:{MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})\b", 0.85, "(?Ui)"),
)


#: A given name stands before white space and a capital letter, where Java looks for it backwards, last letters first; a name that begins at
#: each letter of a text takes some ten times as long to rule out.
NEAR_NAME = rf"(?U)[ \n](?=\p{{Lu}})(?<=(?i:[{''.join(sorted({w[-1] for w in GIVEN}))}])[ \n])(?<=(?i:{branching(GIVEN)})[ \n])"
#: What the matches of these contain.
HAS = {"email": "@", "phone": DIGIT, "street_en": DIGIT, "street_da": DIGIT, "month_date": DIGIT}
#: Name, type, pattern, score, flags and check of detectors whose matches are looked at more closely.
CHECKED = (
    ("PHONE_NUMBER", "phone_international", phones.PATTERN, 0.4, "(?U)", phones.valid),
    ("DATE_TIME", "written_date", calendar.WRITTEN, 0.85, "(?Ui)", calendar.valid_written),
    ("DATE_TIME", "iso_date", calendar.ISO, 0.85, "(?U)", calendar.valid_iso),
    ("DATE_TIME", "relative_date", calendar.RELATIVE, 0.6, "(?Ui)", None),
)


@dataclass
class Registry:
    """What is detected: patterns, and functions on batches with rows (doc_id, text) -> (doc_id, entity_type, start, end, score)."""

    detectors: list[Detector] = field(default_factory=list)
    models: list[Callable] = field(default_factory=list)

    @classmethod
    def default(cls) -> "Registry":
        own = [Detector(t, n, p, s, c, has=DIGIT) for t, n, p, s, c in PATTERNS]
        return cls(own + [Detector(t, n, p, s, flags=f, has=HAS.get(n, ""), near=NEAR_NAME if n == "given_name" else "") for t, n, p, s, f in NATIVE])

    @classmethod
    def extended(cls) -> "Registry":
        """The default detectors, month dates by the calendar instead of their pattern alone, and international phone numbers by their countries' plans."""
        own = [d for d in cls.default().detectors if d.name != "month_date"]
        return cls(own + [Detector(t, n, p, s, flags=f, check=check) for t, n, p, s, f, check in CHECKED])

    def add(self, detector: Detector) -> "Registry":
        self.detectors.append(detector)
        return self

    def add_model(self, function: Callable) -> "Registry":
        self.models.append(function)
        return self

    def named(self, *names: str) -> "Registry":
        return Registry([d for d in self.detectors if d.name in names])

    def of(self, language: str) -> list[Detector]:
        return [d for d in self.detectors if language in d.languages]


#: The detectors of this module: none of their matches reaches across an empty line that a letter follows.
_OWN = [*Registry.default().detectors, *Registry.extended().detectors]
#: Characters of a chunk of a long text.
CHUNK = 1 << 20


def model_from(of: Callable[[str], list]) -> Callable:
    """For Registry.add_model: a function on batches from one on texts. of(text) gives (entity_type, start, end, score) of all that a statistical
    model finds, in code points, end exclusive; a model that takes long to load is best loaded at its first call and kept."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(d, *x) for d, t in zip(b.doc_id, b.text) for x in of(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "entity_type", "start", "end", "score"])

    return run


def detected(rows: DataFrame, name: str, text: Column, detectors: list[tuple[Column | None, list[Detector]]], before: Column | None = None) -> DataFrame:
    """rows with a column of all spans of a text: each recognizer's, without those that one of its own contains; context raises scores
    after that. detectors: those of the rows for which a condition holds, the last ones (without a condition) of all others. before: words that
    stand before the text and count as context too. Each step is computed once a row, words only where a context could count."""

    def groups(some: list[Detector]) -> dict[tuple, list[Detector]]:
        out: dict[tuple, list[Detector]] = {}
        for d in some:
            out.setdefault((d.group or d.entity_type, d.context), []).append(d)
        return out

    def chosen(of) -> Column:
        value = None
        for condition, some in reversed(detectors):
            value = of(groups(some)) if condition is None else F.when(condition, of(groups(some))).otherwise(value)
        return value

    def matches(d: Detector) -> Column:
        found = S.places(text, d.regex)
        found = F.transform(found if d.check is None else F.filter(found, lambda m: d.check(m["m"])), lambda m: S.span(d.entity_type, m["start"], m["end"], d.score))
        worth = [F.rlike(text, F.lit(d.near))] if d.near else []
        if d.has:
            worth.append(F.col("_digits") if d.has == DIGIT else F.contains(text, F.lit(d.has)))
        return F.when(reduce(Column.__and__, worth), found).otherwise(F.array().cast(S.NONE)) if worth else found

    none, names = F.array().cast(f"array<{S.NONE}>"), rows.columns
    rows = once(rows, "_digits", F.rlike(text, F.lit(DIGIT)))
    rows = once(rows, "_raw", chosen(lambda g: F.array(*[F.concat(*map(matches, some)) for some in g.values()]) if g else none))
    rows = once(rows, "_own", F.transform("_raw", lambda x: S.without_contained(x, PRIORITY)))
    asks = chosen(lambda g: F.exists(F.array(*[F.size(F.get("_own", F.lit(k))) > 0 for k, (_, context) in enumerate(g) if context] or [F.lit(False)]), lambda x: x))
    ahead = [] if before is None else [F.transform(before, lambda w: F.struct((-1 - F.length(w)).alias("start"), F.lit(-1).alias("end"), w.alias("m")))]
    rows = once(rows, "_words", F.when(asks, F.concat(*ahead, S.words_in(text))))
    raised = lambda context, k: S.boosted(F.col("_words"), F.get("_own", F.lit(k)), context) if context else F.get("_own", F.lit(k))
    rows = once(rows, "_raised", chosen(lambda g: F.flatten(F.array(*[raised(context, k) for k, (_, context) in enumerate(g)])) if g else F.flatten(none)))
    return once(rows, name, S.without_contained(F.col("_raised"), PRIORITY)).select(*names, name)


def by_model(text: Column, model: Callable) -> Column:
    """The spans that a model of the registry finds in a text, beside the row: rows need no ids of their own. The model is called with a
    batch of rows at a time, whose numbers are their ids; spans that it gives for no row of the batch are an error."""
    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf(S.NONE)
    def run(texts: pa.Array) -> pa.Array:
        import pandas as pd

        found: list[list[dict]] = [[] for _ in range(len(texts))]
        for out in model(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts.to_pylist()})])):
            for row, *what in zip(*[out[c] for c in ("doc_id", "entity_type", "start", "end", "score")]):
                found[row].append(dict(zip(("entity_type", "start", "end", "score"), what)))
        return pa.array(found, kind)

    return run(text)


def resolved(spans: Column) -> Column:
    """Mapped types only (others don't block), best first, none overlapping another."""
    return S.disjoint(F.filter(spans, lambda s: s["entity_type"].isin(*CATEGORY_OF)), PRIORITY)


def detect(docs: DataFrame, registry: Registry | None = None, language: str = "en") -> DataFrame:
    """docs (doc_id, text): doc_id, sel_rank, entity_type, category, start, end, score, surface; a row per selected span.

    Places are those of the original text; a surface contains the hyphen and line end that detection looked past. Where docs have a
    column lang, rows of the languages en and da use their own detectors, all others `language`'s."""
    registry = registry or Registry.default()
    base = docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []), hyphen_joined(F.coalesce("text", F.lit(""))).alias("dtext"))
    rows = detected(base, "spans", F.col("dtext"), by_language(docs, registry, language))
    for model in registry.models:
        rows = rows.withColumn("spans", F.concat("spans", by_model(F.col("dtext"), model)))
    rows = once(once(rows, "best", resolved(F.col("spans"))), "cuts", hyphen_cuts(F.coalesce("text", F.lit(""))))
    rows = rows.select("doc_id", "text", "cuts", F.posexplode("best").alias("sel_rank", "s"))
    start, end = original_start(F.col("s.start"), F.col("cuts")), original_end(F.col("s.end"), F.col("cuts"))
    rows = rows.select("doc_id", "sel_rank", "s.entity_type", category_of(F.col("s.entity_type")).alias("category"), start.alias("start"), end.alias("end"), "s.score", "text")
    surface = stripped(F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")))
    return rows.withColumn("surface", surface).drop("text").where("surface <> ''")


def by_language(docs: DataFrame, registry: Registry, language: str) -> list[tuple[Column | None, list[Detector]]]:
    others = [x for x in ("en", "da") if "lang" in docs.columns and x != language and registry.of(x) != registry.of(language)]
    return [*[(F.col("lang") == x, registry.of(x)) for x in others], (None, registry.of(language))]


def pieces(text: str, size: int) -> Iterator[tuple[int, str]]:
    """A text in parts of size characters and more, each with its place, cut only behind an empty line and before a letter."""
    begin = 0
    while begin < len(text):
        cut = text.find("\n\n", begin + size)
        while cut >= 0 and not text[cut + 2 : cut + 3].isalpha():
            cut = text.find("\n\n", cut + 1)
        end = cut + 2 if cut >= 0 else len(text)
        yield begin, text[begin:end]
        begin = end


def detect_in_chunks(docs: DataFrame, registry: Registry | None = None, language: str = "en", size: int = CHUNK) -> DataFrame:
    """The same rows as detect(), for documents that are too long for one task: texts of over size characters are cut, and their chunks are detected in many
    tasks. No pattern of this module matches across an empty line that a letter follows, so that is where texts are cut; the five words before
    a cut go with a chunk as context; overlaps hang together within chunks. Only sel_rank looks at a whole document, and it is made from sorted ranges.
    A text without such places stays whole, and so do all texts if the registry has a model or a detector of somebody's own, which may look further.

    docs may have null and repeated ids; null texts have no spans. Writes the chunks of long texts to the shared folder."""
    registry = registry or Registry.default()
    if registry.models or not all(d in _OWN for d in registry.detectors):
        return detect(docs, registry, language)
    more = ["lang"] if "lang" in docs.columns else []
    docs = docs.select("doc_id", "text", *more)
    long = F.length("text") > size
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def cut(batches):
        for b in batches:
            for row in b.to_pylist():
                for start, text in pieces(row["text"], size):
                    yield pa.RecordBatch.from_pylist([row | {"text": text, "_start": start}], schema=pa.schema([*b.schema, pa.field("_start", pa.int32())]))

    chunks = docs.where(long).withColumn("_row", F.monotonically_increasing_id())
    chunks = chunks.mapInArrow(cut, ", ".join([*[f"{c} {k}" for c, k in kinds.items()], "_row bigint", "_start int"]))
    chunks = materialize(chunks.repartition("_row", "_start"))
    chunks = once(chunks, "dtext", hyphen_joined(F.col("text")))
    # every chunk but the first begins with a word, so those of five chunks are enough
    last = chunks.select("_row", "_start", F.slice(F.reverse(F.transform(S.words_in(F.col("dtext")), lambda w: w["m"])), 1, 5).alias("_w"))
    near = W.partitionBy("_row").orderBy("_start").rowsBetween(-5, -1)  # a row a chunk, without its text
    ahead = materialize(last.select("_row", "_start", F.flatten(F.transform(F.collect_list("_w").over(near), lambda w: F.reverse(w))).alias("_ahead")))
    rows = chunks.join(ahead.select("_row", "_start", F.slice(F.reverse("_ahead"), 1, 5).alias("_ahead")), ["_row", "_start"])
    rows = detected(rows, "spans", F.col("dtext"), by_language(docs, registry, language), F.reverse("_ahead"))
    rows = once(once(rows, "best", resolved(F.col("spans"))), "cuts", hyphen_cuts(F.col("text")))
    rows = rows.select("doc_id", "_row", "_start", "text", "cuts", F.explode("best").alias("s"))
    start, end = original_start(F.col("s.start"), F.col("cuts")), original_end(F.col("s.end"), F.col("cuts"))
    surface = stripped(F.col("text").substr(start + 1, end - start))
    rows = rows.select("doc_id", "_row", "s", (F.col("_start") + start).alias("start"), (F.col("_start") + end).alias("end"), surface.alias("surface"))
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("s.entity_type"))
    rows = numbered_within(rows, "_row", [-F.col("s.score"), F.col("start"), F.col("s.start") - F.col("s.end"), rank], "_rank")
    rows = rows.select("doc_id", (F.col("_rank") - 1).cast("int").alias("sel_rank"), "s.entity_type", category_of(F.col("s.entity_type")).alias("category"), "start", "end", "s.score", "surface")
    return detect(docs.where(~F.coalesce(long, F.lit(False))), registry, language).unionByName(rows.where("surface <> ''"))


def category_of(entity_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CATEGORY_OF.items() for x in pair]), entity_type)


def not_overlapping(base: DataFrame, extra: DataFrame) -> DataFrame:
    """The spans of extra that overlap none of base, within each doc_id; half open. Spans without id, start or end overlap nothing.

    A sweep: in the order of base's starts and extra's ends, a span of extra is overlapped if the largest end among the spans of base before it is
    behind its start. The order is cut into ranges; each has its running maximum, and what the ranges before it have of the same document is carried to
    it, a row a range and document. So no task has more than a range, however many spans a document has."""
    names = extra.columns
    marks = base.where("doc_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").select(F.col("doc_id").alias("_d"), F.col("start").cast("long").alias("_at"), F.lit(1).alias("_base"), F.col("end").cast("long").alias("_end"))
    asked = extra.select(F.col("doc_id").alias("_d"), F.col("end").cast("long").alias("_at"), F.lit(0).alias("_base"), F.lit(None).cast("long").alias("_end"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = marks.unionByName(asked, allowMissingColumns=True)
    order = ["_d", "_at", "_base"]  # an end comes before a start at the same place: they touch
    rows = materialize(rows.repartitionByRange(*order, "_end").withColumn("_part", F.spark_partition_id()))
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumn("_reach", F.max("_end").over(before.partitionBy("_part", "_d"))).where("_base = 0")
    most = rows.groupBy("_part", "_d").agg(F.max("_end").alias("_end"))
    carried = most.select(F.col("_part").alias("_p"), F.col("_d").alias("_doc"), F.max("_end").over(W.partitionBy("_d").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_carried")).where("_carried IS NOT NULL")
    own = own.join(materialize(carried), (F.col("_part") == F.col("_p")) & (F.col("_d") == F.col("_doc")), "left")
    free = ~F.coalesce(F.greatest("_reach", "_carried") > F.col("_row")["start"], F.lit(False)) | F.col("_d").isNull()
    return own.where(free).select(*[F.col("_row")[c].alias(c) for c in names])


def mentions(found: DataFrame) -> DataFrame:
    """category, surface, ord: the distinct surfaces of a corpus in the order of their first selection."""
    first = found.groupBy("category", "surface").agg(F.min(F.struct("doc_id", "sel_rank")).alias("first"))
    return numbered_within(first, "category", [F.col("first"), F.col("surface")], "ord").select("category", "surface", "ord")


def found_counts(mentioned: DataFrame) -> DataFrame:
    """category, found: distinct surfaces of each category, zero where there are none."""
    spark = mentioned.sparkSession
    names = spark.createDataFrame([(c, k) for k, c in enumerate(CATEGORIES)], "category string, cat_ord int")
    counts = mentioned.groupBy("category").agg(F.count("*").alias("found"))
    return names.join(counts, "category", "left").select("category", "cat_ord", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"))
