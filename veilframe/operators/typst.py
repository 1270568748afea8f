"""Typst export: a variable per variant, its real and its fake value, and the text with variables in place of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import numbered_within
from ..functions.text import digit_count, fake_digits, masked_digits, typst_markup
from .detect import CATEGORIES
from .rewrite import NUMBERS, pseudonymize, typst_boundary

#: What the variables of a category begin with, and their fake values by number of entity and variant (None: digits in the real one's format).
PREFIX = {"person": "P", "email_address": "E", "location": "A", "phone_number": "PH", "date_number": "DT", "id_number": "ID", "code_number": "CD", "general_number": "GN"}
FAKE = {"person": "Person%d Var%d", "email_address": "email%dvar%d@example.com", "location": "Address%d Var%d", **dict.fromkeys(NUMBERS)}


def longest(variants: Column) -> Column:
    """The first of the longest strings of an array."""
    return F.get(F.transform(F.sort_array(F.transform(variants, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))), lambda x: x["v"]), F.lit(0))


def variables(dictionary: DataFrame, seed: int = 0) -> DataFrame:
    """The dictionary with var, real_value, fake_value, ord. Entities are counted per category as they come, variants by length
    (longest first). Fake numbers keep their format; their digits depend on the entity's id alone and its variants share them."""
    category = F.col("category")
    per_entity = W.partitionBy("category", "entity_no")
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), category)
    entity = numbered_within(dictionary.select("category", "entity_no").distinct(), "category", [F.col("entity_no")], "_e").select(F.col("category").alias("_c"), F.col("entity_no").alias("_no"), F.col("_e").cast("int").alias("_e"))
    out = dictionary.join(entity, (category == F.col("_c")) & (F.col("entity_no") == F.col("_no"))).withColumn("_v", F.row_number().over(per_entity.orderBy(F.desc(F.length("variant")), "variant_no")))
    out = out.withColumn("_n", F.max(digit_count(F.col("variant"))).over(per_entity))
    digits = fake_digits(F.col("id"), F.col("_n"), seed)
    fake = F.when(category.isin(*NUMBERS), masked_digits(F.col("variant"), digits))
    for c, form in FAKE.items():
        fake = fake if form is None else F.when(category == c, F.format_string(form, "_e", "_v")).otherwise(fake)
    prefix = of(PREFIX)
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category)
    return out.select(*dictionary.columns, F.concat(prefix, F.col("_e"), F.lit("V"), F.col("_v")).alias("var"), F.col("variant").alias("real_value"), fake.alias("fake_value"), F.struct(rank, F.col("_e"), F.col("_v")).alias("ord"))


def let_line(name: Column, value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit("#let "), name, F.lit(' = "'), escaped, F.lit('"\n'))


def with_variables(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """docs with each variant replaced by #(variable), and counts."""
    named = variables(dictionary).withColumn("_by", F.concat(F.lit("#("), F.col("var"), F.lit(")")))
    return pseudonymize(docs, named, typst_boundary, "_by")


def main_text(text: Column, vars_name: str, markdown: Column | bool = True) -> Column:
    body = F.when(markdown, typst_markup(text)).otherwise(text) if isinstance(markdown, Column) else typst_markup(text) if markdown else text
    return F.concat(F.lit(f'#import "{vars_name}": *\n\n'), body)
