"""Phone numbers against their plans, dates against Python's calendar."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F


def test_phone_plans(spark):
    from veilframe.functions import phones

    assert not any(a != b and a.startswith(b) for a in phones.PLANS for b in phones.PLANS) and len(phones.PLANS) >= 20
    rng, numbers = random.Random(2), []
    for code in [*phones.PLANS, "999", "21", "8"]:
        for n in range(3, 15):
            rest = "".join(rng.choice("0123456789") for _ in range(n))
            cut = rng.randrange(1, n)
            numbers += [f"+{code} {rest[:cut]} {rest[cut:]}", f"00{code}{rest}", f"+{code} (0) {rest[:cut]}-{rest[cut:]}"]

    def valid(number):
        digits = re.sub("[^0-9]", "", number.replace("(0)", ""))
        digits = digits if number[0] == "+" else digits[2:]
        code = next((c for k in (1, 2, 3) if (c := digits[:k]) in phones.PLANS), None)
        return code is not None and len(digits) - len(code) in phones.PLANS[code] and (code not in phones.BEGINS or re.match(phones.BEGINS[code], digits[len(code) :]) is not None)

    got = spark.createDataFrame([(n,) for n in numbers], "n string").select("n", phones.valid(F.col("n"))).collect()
    assert [(n, v) for n, v in got] == [(n, valid(n)) for n in numbers] and 100 < sum(v for _, v in got) < len(numbers) - 100


def test_dates_in_the_calendar(spark):
    from veilframe.functions import calendar

    def real(y, m, d):
        try:
            return bool(date(y, m, d))
        except ValueError:
            return False

    names = "January February March April May June July August September October November December".split()
    rows = [(f"{d}{s} {names[m - 1][:n]} {y}", f"{names[m - 1]} {d}, {y}", f"{y:04}-{m:02}-{d:02}", real(y, m, d)) for y in (1900, 2000, 2023, 2024) for m in range(1, 13) for d, s, n in ((1, "st", 9), (28, "th", 3), (29, "", 9), (30, ".", 3), (31, "st", 9))]
    got = spark.createDataFrame(rows, "a string, b string, c string, ok boolean").select(calendar.valid_written(F.col("a")), calendar.valid_written(F.col("b")), calendar.valid_iso(F.col("c")), "ok").collect()
    assert all(a == b == c == ok for a, b, c, ok in got) and {r.ok for r in got} == {True, False}
    for text, ok in (("the 29th of February", True), ("30 February", False), ("3. marts 2024", True), ("31. juni", False), ("okt 31", True), ("Sept 31", False)):
        assert spark.range(1).select(calendar.valid_written(F.lit(text))).first()[0] is ok


@pytest.mark.parametrize("text, want", [
    ("met on 3rd of March 2024 and 31 February 2024", ["3rd of March 2024"]), ("den 3. marts 2024, March 5", ["den 3. marts 2024", "March 5"]), ("from 2024-02-29 to 2023-02-29", ["2024-02-29"]),
    ("two days ago, next Monday, Yesterday", ["two days ago", "next Monday", "Yesterday"]), ("the march 32 of mayors", []), ("", []), (None, []),
])
def test_dates_in_texts(spark, text, want):
    from veilframe.operators import detect as D

    registry = D.Registry.extended().named("written_date", "iso_date", "relative_date")
    found = D.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), registry).orderBy("start").collect()
    assert [r.surface for r in found] == want and all(r.category == "date_number" for r in found)


def test_phones_in_texts(spark):
    from veilframe.operators import detect as D

    text = "call +45 12 34 56 78, +45 22 34 56 78 or +45 22 34 56 7; 0044 (0) 20 7946 0958, +1 (415) 555-2671, +1 (115) 555-2671 x+4522345678"
    found = D.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), D.Registry.extended().named("phone_international")).orderBy("start").collect()
    assert [r.surface for r in found] == ["+45 22 34 56 78", "0044 (0) 20 7946 0958", "+1 (415) 555-2671"]


def test_chunks_of_long_texts(spark):
    """Texts cut at many places have the spans, places, scores and ranks of whole ones; ids may repeat or be null."""
    import random

    from veilframe.operators import detect as D

    rng = random.Random(3)
    parts = ["John Doe", "Anna B. Larsen", "code", "tel", "my id is", "123456-1234", "12 34 56 78", "(123456)", "2020-12345", "01.02.20", "a@b.com", "12 May 2020", "12 Baker Street, London", "æble", "x-\ny", "1234-\n5678", "é", "100,50.abc", "...", "123-4567 (890)a"]
    text = lambda n: "".join(rng.choice(parts) + rng.choice([" ", "\n", "\n\n", "\n\n\n", " \n\n", ", "]) for _ in range(n))
    rows = [(k % 5 if k % 7 else None, text(rng.randrange(120))) for k in range(24)] + [(99, None), (99, ""), (98, "\n\nJohn Doe 1234"), (98, "no place to cut 123456" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, D.detect(docs, D.Registry.extended()).collect()))
    assert len(want) > 400 and sorted(map(repr, D.detect_in_chunks(docs, D.Registry.extended(), size=40).collect())) == want
    assert sum(len(list(D.pieces(t or "", 40))) > 2 for _, t in rows) > 10
    assert all("".join(p for _, p in D.pieces(t or "", 40)) == (t or "") for _, t in rows)
    wide = D.Registry.default().named("digit_sequence").add(D.Detector("CODE_NUMBER", "over_lines", r"code\s+tel", 0.9))
    assert sorted(map(repr, D.detect_in_chunks(docs, wide, size=40).collect())) == sorted(map(repr, D.detect(docs, wide).collect()))


def test_branching():
    """The names told apart letter by letter are those that were tried one after the other."""
    import re

    from veilframe.operators import detect as D

    words = [*D.GIVEN, "an", "a", "b"]
    tree = re.compile(D.branching(words))
    assert len(D.branching(["one"])) == 3 and D.branching(D.GIVEN).count("|") < len(D.GIVEN) and "john|jon" not in D.branching(D.GIVEN)
    for w in words:
        assert tree.fullmatch(w) and not tree.fullmatch(w + "x")
        assert bool(tree.fullmatch(w[:-1])) == (w[:-1] in words)


def test_what_matches_contain(spark):
    """Texts without what every match of a detector contains aren't searched for it: the same spans as with a search of all."""
    from dataclasses import replace

    from veilframe.operators import detect as D

    texts = ["", None, "no digit here", "٣٣٣٣ and x@y.com", "Anna Larsen, no digits", "wo-\nman@foo.org x-\ny", "12 March 2020", "Skovvej ٣", "at@once", "1 Baker Street and 471100", "a-\n\n", "4-\n711-\n00 id"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    own = D.Registry.default()
    assert {d.name for d in own.detectors if not d.has} == {"given_name"}
    found = lambda r: sorted(tuple(x) for x in D.detect(docs, r).collect())
    got = found(own)
    assert got == found(D.Registry([replace(d, has="") for d in own.detectors])) and {x[0] for x in got} == {3, 4, 5, 6, 7, 9, 11}


def test_what_is_near_names(spark):
    """Texts in which a given name isn't followed by white space and a capital aren't searched for persons; all others are, in any case of letters."""
    from dataclasses import replace

    from veilframe.operators import detect as D

    own = D.Registry.default().named("given_name")
    assert own.detectors[0].near and not any(d.near for d in D.Registry.default().detectors if d.name != "given_name")
    rng = random.Random(5)
    signs = ["john", "JOHN", "Maria", "SØREN", "søren", "Kaſper", "marK", "jenſ", "Lars", " ", " ", "\n", "Doe", "D.", "É", "𐐀", "and", "Og", ".", "1", "ǅ", "̈", "İ", "_"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with_, without = (sorted(map(tuple, D.detect(docs, D.Registry(some)).collect())) for some in (own.detectors, [replace(d, near="") for d in own.detectors]))
    assert with_ == without and len(with_) > 20
    assert docs.where(F.rlike("text", F.lit(own.detectors[0].near))).count() < len(texts) / 2
