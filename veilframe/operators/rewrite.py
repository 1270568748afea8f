"""Pseudonymising texts with an entity dictionary.

Rules are the variants of all entities, longest first (then by category, entity, variant); each sees what the ones before
it wrote. A dictionary is small, as people review it, but its size is looked at. Up to RULES rules travel as one array and
run inside each row. A larger dictionary becomes a trie, made in shards; while its shards have a bounded size they are sent to the executors, and
a text runs the rules that the trie finds in it, within its row too: no text is shuffled, and a stream is rewritten as a table is. Beyond that
the texts meet the shards in turn, each text then runs its own rules, and what they write meets the shards again, until no text gets another rule.
All ways give the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import count_literal, let, literal, replacement
from . import automaton
from .detect import CATEGORIES
from .grouping import kept

RULES = 2000
#: Categories whose variants are replaced wherever they stand, and not only as whole words.
ANYWHERE = ("phone_number", "date_number", "id_number", "code_number", "general_number", "location")
NUMBERS = ANYWHERE[:5]


def plain_boundary(category: Column, variant: Column) -> Column:
    """Whether a variant is replaced only as a whole word (plain output)."""
    return ~(category.isin(*ANYWHERE) | ((category == "person") & variant.contains("\n")))


def typst_boundary(category: Column, variant: Column) -> Column:
    """The same for Typst output: numbers too are whole words, unless a line end is in them."""
    return (category != "location") & ~((category != "email_address") & variant.contains("\n"))


def rules(dictionary: DataFrame, boundary=plain_boundary, by: str = "id") -> DataFrame:
    """ord, category, variant, by, bounded: what a dictionary replaces, in order. Empty variants are an error."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    checked = F.when(F.length("variant") > 0, F.col("variant")).otherwise(F.raise_error(F.lit("a variant is empty")))
    return dictionary.select(
        F.struct((-F.length("variant")).alias("n"), rank.alias("c"), F.col("entity_no").alias("e"), F.col("variant_no").alias("v")).alias("ord"),
        "category", checked.alias("variant"), F.col(by).alias("by"), boundary(F.col("category"), F.col("variant")).alias("bounded"),
    )


RULE = "array<struct<ord:struct<n:int,c:bigint,e:int,v:int>,category:string,variant:string,by:string,bounded:boolean>>"


def rewritten(text: Column, rule_array: Column, reach: int | None = None) -> Column:
    """struct<text, counts>: the text after all rules in turn, and how often each category was replaced; with reach also near: what
    stood around each id, so many characters to both sides, when it had been inserted."""
    zero = F.struct(text.alias("text"), F.transform(F.array(*[F.lit(c) for c in CATEGORIES]), lambda _: F.lit(0).cast("bigint")).alias("counts"), *([] if reach is None else [F.array().cast("array<string>").alias("near")]))

    def around(x: Column, by: Column) -> Column:
        begin = lambda m: F.greatest(m["start"] - reach, F.lit(0))
        found = F.transform(S.places(x, literal(by)), lambda m: x.substr(begin(m) + 1, m["end"] + reach - begin(m)))
        return F.when(by == "", F.array(x)).otherwise(F.array_distinct(found))

    def step(acc: Column, r: Column) -> Column:
        def done(x: Column) -> Column:
            n = F.when(r["bounded"], F.regexp_count(x["text"], x["p"]).cast("bigint")).otherwise(count_literal(x["text"], r["variant"]))
            out = F.when(r["bounded"], F.regexp_replace(x["text"], x["p"], replacement(r["by"]))).otherwise(F.replace(x["text"], r["variant"], r["by"]))
            at = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), r["category"]) - 1
            counts = F.transform(x["counts"], lambda c, i: F.when(i == at, c + n).otherwise(c)).alias("counts")
            if reach is None:
                return F.struct(out.alias("text"), counts)
            return let(out, lambda o: F.struct(o.alias("text"), counts, F.when(o == x["text"], x["near"]).otherwise(F.array_union(x["near"], around(o, r["by"]))).alias("near")))

        whole = F.concat(F.lit(r"(?U)\b"), literal(r["variant"]), F.lit(r"\b"))
        # most variants aren't in a text: looking for the bare variant is cheap
        return F.when(F.contains(acc["text"], r["variant"]), let(F.struct(*[acc[c].alias(c) for c in ("text", "counts", *(() if reach is None else ("near",)))], whole.alias("p")), done)).otherwise(acc)

    return F.aggregate(rule_array, zero, step)


def counted(counts: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(c) for c in CATEGORIES]), counts)


def pseudonymize(docs: DataFrame, dictionary: DataFrame, boundary=plain_boundary, by: str = "id") -> DataFrame:
    """All columns of docs (text rewritten) and counts: map of category to number of replacements. A null text stays null.

    Nothing is detected here: what isn't in the dictionary stays. Works on streams too, but for dictionaries beyond one sending, for which
    streaming.rewrite.write_stream() does it by batches."""
    table = rules(dictionary, boundary, by)
    few = table.limit(RULES + 1).count() <= RULES  # the size that may be broadcast
    if few:
        one = table.groupBy().agg(F.coalesce(F.sort_array(F.collect_list(F.struct(*table.columns))), F.array().cast(RULE)).alias("_rules"))
        out = docs.crossJoin(F.broadcast(one)).withColumn("_r", rewritten(F.col("text"), F.col("_rules")))  # one row
    else:
        ranked, written = automaton.shards(table)
        sendings = automaton.together(written)
        if len(sendings) == 1:
            out = docs.withColumn("_r", automaton.cascaded(F.col("text"), *automaton.sent(written, sendings[0])))
        elif docs.isStreaming:
            raise ValueError("a dictionary of this size meets a stream in batches: use streaming.rewrite.write_stream")
        else:
            out = with_own_rules(docs, ranked, written, sendings).withColumn("_r", rewritten(F.col("text"), F.col("_rules")))
    return out.select(*[F.col("_r.text").alias("text") if c == "text" else c for c in docs.columns], counted(F.col("_r.counts")).alias("counts"))


def with_own_rules(docs: DataFrame, ranked: DataFrame, written: DataFrame, sendings: list[list[int]]) -> DataFrame:
    """docs with _rules: the rules that apply to the row's text. These are those whose variants occur in the text, and those of variants that occur
    near an id that such rules insert, in rounds until none is added: any other finds nothing at its turn."""
    fields = F.struct(*[c for c in ranked.columns if c != "rank"])
    rows = docs.withColumn("_row", F.sha2("text", 256))  # equal texts have equal rules
    texts = rows.where(F.col("text").isNotNull()).select("_row", "text").dropDuplicates(["_row"])
    reach = ranked.agg(F.max(F.length("variant"))).first()[0] or 0

    def met(some: DataFrame) -> DataFrame:  # some (_row, text): _row, rank
        out = None
        for shards in sendings:  # each is sent, used and written before the next one
            part = kept(automaton.met(some, written, shards).distinct())
            out = part if out is None else out.unionByName(part)
        return out

    def listed(found: DataFrame, to: DataFrame) -> DataFrame:
        own = found.join(ranked.select("rank", fields.alias("_rule")), "rank").groupBy("_row").agg(F.sort_array(F.collect_list("_rule")).alias("_rules"))
        return to.join(own, "_row", "left").withColumn("_rules", F.coalesce("_rules", F.array().cast(RULE)))

    found, open_ = met(texts), texts
    while True:
        near = listed(found, open_).withColumn("_r", rewritten(F.col("text"), F.col("_rules"), reach)).select("_row", F.explode("_r.near").alias("text"))
        new = kept(met(kept(near)).join(found, ["_row", "rank"], "left_anti").distinct())
        if new.isEmpty():
            return listed(found, rows).drop("_row")
        found, open_ = kept(found.unionByName(new)), texts.join(new.select("_row").distinct(), "_row", "left_semi")


def observed(rewritten_docs: DataFrame, name: str = "replaced") -> tuple[DataFrame, Observation | None]:
    """The same rows, and what counts how often each category is replaced while they are written (once, to one place): no second read is needed. On
    a stream the progress of the query has these numbers under the name, batch by batch; see streaming.rewrite.replaced()."""
    sums = [F.coalesce(F.sum(F.col("counts")[c]), F.lit(0)).alias(c) for c in CATEGORIES]
    if rewritten_docs.isStreaming:
        return rewritten_docs.observe(name, *sums), None
    seen = Observation(name)
    return rewritten_docs.observe(seen, *sums), seen


def totals(rewritten_docs: DataFrame) -> DataFrame:
    """category, found, replaced (always equal) over all rows."""
    pairs = rewritten_docs.select(F.explode("counts").alias("category", "n")).groupBy("category").agg(F.sum("n").alias("n"))
    names = rewritten_docs.sparkSession.createDataFrame([(c, k) for k, c in enumerate(CATEGORIES)], "category string, cat_ord int")
    return names.join(pairs, "category", "left").select("category", "cat_ord", F.coalesce("n", F.lit(0)).alias("found"), F.coalesce("n", F.lit(0)).alias("replaced"))
