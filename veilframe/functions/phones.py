"""International phone numbers by the numbering plans of their countries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Calling codes, and how many digits a number may have behind them. No code is the beginning of another.
PLANS = {
    "1": (10,), "7": (10,), "20": (8, 9, 10), "27": (9,), "30": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "36": (8, 9), "39": (6, 7, 8, 9, 10, 11), "41": (9,),
    "43": (7, 8, 9, 10, 11, 12, 13), "44": (9, 10), "45": (8,), "46": (7, 8, 9), "47": (8,), "48": (9,), "49": (6, 7, 8, 9, 10, 11), "52": (10,), "55": (10, 11), "61": (9,), "64": (8, 9, 10),
    "65": (8,), "81": (9, 10), "82": (8, 9, 10, 11), "86": (10, 11), "90": (10,), "91": (10,), "351": (9,), "353": (7, 8, 9), "354": (7,), "358": (5, 6, 7, 8, 9, 10, 11), "420": (9,), "421": (9,),
}
#: What the number behind a code must begin with, where there is such a rule.
BEGINS = {"1": "[2-9][0-9]{2}[2-9]", "33": "[1-9]", "34": "[5-9]", "45": "[2-9]", "47": "[2-9]", "44": "[1-9]", "48": "[1-9]", "91": "[1-9]", "61": "[1-9]", "31": "[1-9]"}
#: A plus or two zeros, then digits in groups; a trunk zero in brackets isn't dialled.
PATTERN = r"(?<![\w+])(?:\+|00)[1-9](?:[ .-]?\(0\))?(?:[ ()./-]{0,2}[0-9]){5,15}(?![\w])"


def dialled(number: Column) -> Column:
    """The digits behind the plus, without a trunk zero in brackets."""
    bare = F.regexp_replace(F.replace(number, F.lit("(0)"), F.lit("")), "[^0-9]", "")
    return F.when(number.startswith("+"), bare).otherwise(F.regexp_replace(bare, "^00", ""))


def valid(number: Column) -> Column:
    """Whether a number's code is known and its plan allows the rest: a look-up of the first one, two and three digits."""
    plans = F.create_map(*[F.lit(x) for code, sizes in PLANS.items() for x in (code, [*sizes])])
    begins = F.create_map(*[F.lit(x) for pair in BEGINS.items() for x in pair])

    def of(digits: Column) -> Column:
        def fits(k: int) -> Column:
            code, rest = F.substring(digits, 1, k), F.substring(digits, k + 1, 20)
            start = F.element_at(begins, code)
            return F.coalesce(F.array_contains(F.element_at(plans, code), F.length(rest)), F.lit(False)) & (start.isNull() | F.call_function("rlike", rest, F.concat(F.lit("^"), start)))

        return fits(1) | fits(2) | fits(3)

    return let(dialled(number), of)
