"""The reference's expectations, and operators against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilframe.api import Anonymizer, anonymize_file, export_typst, extract_text, md_to_typst
from veilframe.operators.detect import CATEGORIES


@pytest.fixture(scope="module")
def anonymized(spark):
    def run(text, language="en"):
        a = Anonymizer(language, spark)
        a.detect_entities([text])
        found = dict(a.counts)
        import yaml

        b = Anonymizer(language, spark)
        b.load_replacements(yaml.safe_load(a.generate_yaml()))
        out, counts = b.anonymize(text)
        return a, found, out, counts

    return run


def test_empty(spark, anonymized):
    import yaml

    a, found, out, counts = anonymized("")
    assert yaml.safe_load(a.generate_yaml()) == {c.upper(): [] for c in CATEGORIES}
    assert out == "" and not any(found.values()) and not any(counts.values())


def test_name(anonymized):
    _, found, out, counts = anonymized("Hello John Doe, how are you?")
    assert "<PERSON_1>" in out and found["person_found"] >= 1 and counts["person_replaced"] >= 1


def test_name_variants(anonymized):
    a, found, out, counts = anonymized("John Doe and Jon Doe and john DOE were mentioned.")
    assert len(a.entities.person) == 1
    assert found["person_found"] == 3 and counts["person_replaced"] == 3
    assert out == "<PERSON_1> and <PERSON_1> and <PERSON_1> were mentioned."


def test_numbers(anonymized):
    a, found, _, _ = anonymized("Account: 1234567890, Phone: 1234567, Code: 12 34 56 78")
    both = a.entities.general_number + a.entities.phone_number
    assert any({"1234567890", "12 34 56 78"} <= {v.strip() for v in e.variants} for e in both)
    assert found["general_number_found"] + found["phone_number_found"] >= 3


def test_places(anonymized):
    for text, language in (("Lives at 123 Oneway St, Springfield, US", "en"), ("Bor på Langelandsgade 14, 1.tv, 7300 Jelling", "da")):
        _, found, out, counts = anonymized(text, language)
        assert "<LOCATION_1>" in out and found["location_found"] >= 1 and counts["location_replaced"] >= 1


def test_cpr(anonymized):
    _, found, out, _ = anonymized("CPR: 123456-1234", "da")
    assert out == "CPR: <GENERAL_NUMBER_1>" and found["general_number_found"] == 1


def test_mixed(anonymized):
    text = "Contact John Doe at 1234567890 or Jane Smith via 12 34 56 78. Jon Doe and Jane Smyth share details at 123 Oneway St, Springfield, US. CPR: 123456-1234. Additional phone: 1234567"
    _, found, out, counts = anonymized(text)
    assert found["person_found"] >= 4 and counts["person_replaced"] >= 4
    assert found["phone_number_found"] + found["general_number_found"] >= 4
    assert found["location_found"] >= 1 and counts["location_replaced"] >= 1
    assert "<LOCATION_" in out and ("<GENERAL_NUMBER_" in out or "<PHONE_NUMBER_" in out)


def test_command_line(spark, tmp_path, capsys):
    import yaml

    from veilframe import cli

    text = "Hello John Doe and Jon Doe, CPR: 123456-1234"
    (tmp_path / "a.txt").write_text(text)
    config = tmp_path / "c.yaml"
    cli.main(["extract", str(tmp_path / "a.txt"), "-c", str(config)])
    assert "PERSON found: 2" in capsys.readouterr().out
    data = yaml.safe_load(config.read_text())
    assert len(data["PERSON"]) >= 1
    assert any("123456-1234" in e["variants"] for e in data["GENERAL_NUMBER"] + data["PHONE_NUMBER"])
    (tmp_path / "b.txt").write_text(text + " and John Doe again, and new person Alice, new CPR: 987654-4321")
    cli.main(["pseudo", "plain", str(tmp_path / "b.txt"), "-c", str(config)])
    assert "PERSON replaced: 3" in capsys.readouterr().out
    out = (tmp_path / "b_anon.txt").read_text()
    assert out.count("<PERSON_1>") == 3 and "Alice" in out and "987654-4321" in out
    cli.main(["pseudo", "typst", str(tmp_path / "b.txt"), "-c", str(config)])
    assert "#(P1V1)" in (tmp_path / "b.typ").read_text()
    assert '#let P1V1 = "John Doe"' in (tmp_path / "b_vars.typ").read_text()
    assert '#let P1V1 = "Person1 Var1"' in (tmp_path / "b_fakevars.typ").read_text()
    fake = re.search(r'#let GN1V1 = "(.*)"', (tmp_path / "b_fakevars.typ").read_text())[1]
    assert re.fullmatch(r"\d{6}-\d{4}", fake) and fake != "123456-1234"
    for bad in (["extract"], ["pseudo", "plain", "x.txt"], ["pseudo", "plain", "none.txt", "-c", str(config)], ["pseudo", "typst", str(tmp_path / "b.txt"), "-c", str(config), "-o", "x.txt"]):
        with pytest.raises(SystemExit) as e:
            cli.main(bad)
        assert e.value.code == 1


def test_files(spark, tmp_path):
    (tmp_path / "t.md").write_text("# Heading\n**Bold** text")
    (tmp_path / "t.txt").write_text("Plain text")
    (tmp_path / "t.tex").write_text(r"\documentclass{article} \begin{document} Hello \end{document}")
    (tmp_path / "t.bib").write_text("@article{test, title={Test Title by John Doe}, author={John Doe}}")
    (tmp_path / "t.pdf").write_text("Dummy")
    assert extract_text(tmp_path / "t.md", spark) == "# Heading\n**Bold** text"
    assert extract_text(tmp_path / "t.txt", spark) == "Plain text"
    tex = extract_text(tmp_path / "t.tex", spark)
    assert "Hello" in tex and r"\documentclass" not in tex
    bib = extract_text(tmp_path / "t.bib", spark)
    assert "Test Title by John Doe" in bib and "John Doe" in bib
    with pytest.raises(ValueError, match="Unsupported file type: .pdf"):
        extract_text(tmp_path / "t.pdf", spark)
    a = Anonymizer("en", spark)
    a.load_replacements({"PERSON": [{"id": "<PERSON_1>", "variants": ["John Doe"]}]})
    with pytest.raises(ValueError, match="Unsupported file type: .pdf"):
        anonymize_file(tmp_path / "t.pdf", a, tmp_path / "o.pdf")
    for name in ("t.md", "t.txt", "t.tex"):
        assert anonymize_file(tmp_path / name, a, tmp_path / f"o_{name}")["person_replaced"] == 0
        assert (tmp_path / f"o_{name}").read_text() == (tmp_path / name).read_text()
    assert anonymize_file(tmp_path / "t.bib", a, tmp_path / "o.bib")["person_replaced"] == 2
    assert "<PERSON_1>" in (tmp_path / "o.bib").read_text()
    from veilframe.sources.files import parse_bib

    again = parse_bib((tmp_path / "o.bib").read_text())
    assert again == [{"title": "Test Title by <PERSON_1>", "author": "<PERSON_1>", "ENTRYTYPE": "article", "ID": "test"}]


def test_markdown(spark):
    out = md_to_typst("# Heading\n**Bold** _italic_ `code` [link](url)", spark)
    assert out == '= Heading\n*Bold* _italic_ `code` #link("url")[link]'


def test_rules_and_order(spark):
    a = Anonymizer("en", spark)
    a.load_replacements({"PERSON": [{"id": "<PERSON_1>", "variants": ["Ann Lee", "Ann"]}], "GENERAL_NUMBER": [{"id": "<GENERAL_NUMBER_1>", "variants": ["1"]}], "EMAIL_ADDRESS": [{"id": r"$1\g<0>", "variants": ["a.b@c.d"]}], "names": [{"id": 3}]})
    out, counts = a.anonymize("Ann Lee, Annabel and Ann; a.b@c.d xa.b@c.d")
    assert out == r"<PERSON_<GENERAL_NUMBER_1>>, Annabel and <PERSON_<GENERAL_NUMBER_1>>; $<GENERAL_NUMBER_1>\g<0> xa.b@c.d"
    assert counts["person_replaced"] == 2 and counts["email_address_replaced"] == 1 and counts["general_number_replaced"] == 3


def test_large_dictionaries(spark, monkeypatch):
    from veilframe.operators import rewrite

    rng = random.Random(1)
    names = [f"Name{rng.randrange(10**6)} Sur{k}" for k in range(60)]
    rows = [("person", k + 1, f"<P{k}>", 1, n, None) for k, n in enumerate(names)] + [("general_number", 1, "<N>", 1, "7", None)]
    d = spark.createDataFrame(rows, "category string, entity_no int, id string, variant_no int, variant string, pattern string")
    docs = spark.createDataFrame([(k, " ".join(rng.choices([*names, "7", "x"], k=9))) for k in range(20)] + [(99, None), (98, "")], "doc_id long, text string")
    one = sorted(map(repr, rewrite.pseudonymize(docs, d).collect()))
    monkeypatch.setattr(rewrite, "RULES", 5)
    assert sorted(map(repr, rewrite.pseudonymize(docs, d).collect())) == one
    with pytest.raises(Exception, match="a variant is empty"):
        rewrite.pseudonymize(docs, d.withColumn("variant", F.lit(""))).collect()


def test_large_dictionaries_rewrite_inserted_ids(spark, monkeypatch):
    from veilframe.operators import rewrite

    rows = [
        ("person", 1, "<PERSON_1500>", 1, "Ann Margaret Lee", None), ("general_number", 1, "<GENERAL_NUMBER_7777>", 1, "1500", None), ("code_number", 1, "<C>", 1, "777", None),
        ("location", 1, "<L>", 1, "at <PERS", None), ("email_address", 1, "", 1, "cut@x.org", None), ("id_number", 1, "<I>", 1, "left right", None), ("person", 2, "<P2>", 1, "absent", None),
    ]
    d = spark.createDataFrame(rows, "category string, entity_no int, id string, variant_no int, variant string, pattern string")
    texts = ["met Ann Margaret Lee there", "Ann Margaret Lee", "look at Ann Margaret Lee", "x left cut@x.org right", "left  cut@x.org right", "nothing", "", None, "1500 Ann Margaret Lee 1500"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = sorted(rewrite.pseudonymize(docs, d).collect())
    monkeypatch.setattr(rewrite, "RULES", 3)
    assert sorted(rewrite.pseudonymize(docs, d).collect()) == few
    in_turn(monkeypatch, 2)
    assert sorted(rewrite.pseudonymize(docs, d).collect()) == few
    assert "1500" not in few[0].text and few[0].counts["code_number"] == 1 and few[2].counts["location"] == 1


def in_turn(monkeypatch, rules):
    """Shards of so many rules, each of which is sent by itself."""
    from veilframe.operators import automaton

    monkeypatch.setattr(automaton.shards, "__defaults__", (rules,))
    monkeypatch.setattr(automaton.together, "__defaults__", (1,))


def plain_cascade(text, rows):
    """All rules one after the other, by Python's regular expressions."""
    import re

    counts = Counter()
    order = {c: k for k, c in enumerate(CATEGORIES)}
    for category, _, by, _, variant, _ in sorted(rows, key=lambda r: (-len(r[4]), order[r[0]], r[1], r[3])):
        bounded = category == "email_address" or (category == "person" and "\n" not in variant)
        text, n = re.subn(rf"\b{re.escape(variant)}\b" if bounded else re.escape(variant), lambda _: by, text)  # noqa: B023
        counts[category] += n
    return text, {c: counts[c] for c in CATEGORIES}


@pytest.mark.parametrize("way", ["small", "sent", "in turn"])
def test_cascade_against_plain_python(spark, monkeypatch, way):
    """Random rules over few letters, so that they overlap, nest in each other and in ids, and are completed by ids."""
    from veilframe.operators import rewrite

    rng = random.Random(5)
    letters = ["a", "b", "1", "<", ">", " ", "é", "\n", "_", "-", "P", "\U0001f600"]
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    ids = ["<P1>", "<a1>", "", "1", "b", r"\1$&", "<P_é>", "> <"]
    rows = [(rng.choice(CATEGORIES), rng.randrange(1, 9), rng.choice(ids), k, some(rng.choice([1, 2, 2, 3, 3, 4, 6, 9])), None) for k in range(150)]
    rows += [("person", 3, "<P1>", 1000, rows[0][4], None)]  # a variant twice
    docs = spark.createDataFrame([(k, some(rng.randrange(60)), "kept") for k in range(120)] + [(None, None, "x"), (700, "a1" * 500, "y")], "doc_id long, text string, counts string")
    d = spark.createDataFrame(rows, "category string, entity_no int, id string, variant_no int, variant string, pattern string")
    if way != "small":
        monkeypatch.setattr(rewrite, "RULES", 3)
    if way == "in turn":
        in_turn(monkeypatch, 40)
    got = rewrite.pseudonymize(docs.drop("counts"), d).collect()
    want = {r.doc_id: plain_cascade(r.text, rows) for r in docs.collect() if r.text is not None}
    for r in got:
        assert (r.text, r.counts) == want[r.doc_id] if r.text is not None else r.doc_id is None
    assert len(got) == 122 and sum(sum(c.values()) for _, c in want.values()) > 2000


def test_many_rules_of_one_variant():
    """Tables repeat names under other keys: rules of a variant that is there wait one at a time, and all of them run as in turn where ids bring the variant back."""
    import tracemalloc

    import pyarrow as pa

    from veilframe.operators import automaton

    r = random.Random(4)
    rules = [("ab", f"<{k}>", False) for k in range(2000)] + [("abc", f"[{k % 3 and 'ab' or 'x'}{k}]", k % 2 == 0) for k in range(300)] + [("x", "ab" if k < 40 else "y", True) for k in range(60)] + [(str(k), f"({k})", False) for k in range(90)]
    r.shuffle(rules)
    rules.sort(key=lambda x: -len(x[0]))
    shards = []
    for at in range(0, len(rules), 700):
        some = sorted((v, k, by, b) for k, (v, by, b) in enumerate(rules[at : at + 700], at))
        shards.append(automaton.Rules(pa.table({"rank": pa.array([x[1] for x in some], pa.int64()), "category": pa.array([0] * len(some), pa.int32()), "variant": [x[0] for x in some], "by": [x[2] for x in some], "bounded": [x[3] for x in some]})))
    texts = [" ".join(r.choice(("ab", "abc", "abcd", "x", "xab", "17", "zz")) for _ in range(12)) for _ in range(300)]

    def plain(text):
        n = 0
        for v, by, bounded in rules:
            if v in text:
                text, k = re.subn(rf"\b{v}\b" if bounded else v, by, text)
                n += k
        return text, n

    cascade = automaton.Cascade(shards)
    tracemalloc.start()
    got = cascade.texts(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(t, sum(c)) for t, c in got] == [plain(t) for t in texts] and most < 20_000_000


def test_trie():
    from veilframe.operators.automaton import Trie

    rng = random.Random(2)
    for letters in ("ab", "abcdefgh\U0001f600\uffff"):
        strings = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(60)})
        texts = ["".join(rng.choice(letters + "z") for _ in range(rng.randrange(40))) for _ in range(50)] + ["", strings[0]]
        got = Trie(strings).find(texts)
        assert set(zip(*[x.tolist() for x in got])) == {(t, k) for t, x in enumerate(texts) for k, s in enumerate(strings) if s in x}
    assert len(Trie(["a"]).find([])[0]) == len(Trie([]).find(["a"])[0]) == 0


def test_a_million_variants(spark, monkeypatch):
    """Texts aren't shuffled, and each names itself: what is left is known."""
    from veilframe.operators import rewrite

    n = 1_000_000
    name = lambda k: F.concat(F.initcap(F.translate(F.conv(k * 7919 % n + n, 10, 26), "0123456789", "klmnopqrst")), F.lit(" "), F.initcap(F.translate(F.conv(k + 3 * n, 10, 26), "0123456789", "KLMNOPQRST")))
    d = spark.range(n).select(F.lit("person").alias("category"), (F.col("id") + 1).cast("int").alias("entity_no"), F.format_string("<PERSON_%d>", F.col("id") + 1).alias("id"), F.lit(1).alias("variant_no"), name(F.col("id")).alias("variant"), F.lit(None).cast("string").alias("pattern"))
    k = F.col("id") * 37 + 11
    docs = spark.range(20_000).select("id", k.alias("k"), F.concat(F.lit("Here "), name(k), F.lit(" met x"), name(k + 5), F.lit(", "), name(k + 7), F.lit("."), F.repeat(F.lit(" Nobody Else of note"), 20)).alias("text"))
    out = rewrite.pseudonymize(docs, d)
    assert "Exchange" not in out._jdf.queryExecution().toString()
    want = F.concat(F.lit("Here <PERSON_"), F.col("k") + 1, F.lit("> met x"), name(F.col("k") + 5), F.lit(", <PERSON_"), F.col("k") + 8, F.lit(">."))
    got = out.select((F.substring_index("text", " Nobody", 1) == want).alias("same"), F.col("counts")["person"].alias("n")).groupBy("same", "n").count().collect()
    assert [tuple(r) for r in got] == [(True, 2, 20_000)]


def plain_leaders(items, similar):
    lead, out = [], {}
    for k, x in enumerate(items):
        to = next((i for i in lead if similar(items[i], x)), None)
        if to is None:
            lead.append(k)
        out[k] = k if to is None else to
    return out


@pytest.mark.parametrize("threshold", [80, 85, 95])
def test_leaders(spark, threshold):
    from veilframe.operators import grouping

    rng = random.Random(threshold)
    base = ["".join(rng.choice("0123") for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    items = [""] + [b[:i] + rng.choice(["", "4", "5"]) + b[i + rng.randrange(2) :] for b in base for i in [rng.randrange(len(b) + 1) for _ in range(3)]] + [""]
    df = spark.createDataFrame(list(enumerate(items)), "id long, norm string")
    pairs = {(r.a, r.b) for r in grouping.similar_pairs(df, threshold).collect()}
    want = {(i, j) for i in range(len(items)) for j in range(i + 1, len(items)) if grouping.similarity(items[i], items[j]) > threshold}
    assert {p for p in want if items[p[0]] or items[p[1]]} <= pairs <= want
    got = {r.id: r.leader for r in grouping.leaders(df, grouping.similar_pairs(df, threshold)).collect()}
    assert got == plain_leaders(items, lambda x, y: grouping.similarity(x, y) > threshold)
    assert {r.id: r.leader for r in df.groupBy().applyInArrow(grouping.compared(threshold), "id long, leader long").collect()} == got


def test_many_pairs_at_once():
    from veilframe.operators.grouping import subsequence, subsequences

    rng = random.Random(8)
    some = lambda: "".join(rng.choice("abcdé\U0001f600") for _ in range(rng.choice([0, 1, 2, 5, 9, 17, 63, 64, 65, 130])))
    pairs = [(some(), some()) for _ in range(400)]
    assert subsequences(*map(list, zip(*pairs))).tolist() == [subsequence(*p) for p in pairs]


@pytest.mark.parametrize("threshold", [80, 85, 95])
def test_every_length_meets(spark, threshold):
    """Pairs of lengths that meet by deletion and by segments, with edits at the limit."""
    from veilframe.operators import grouping

    rng = random.Random(threshold)
    items = []
    for n in [*range(1, 19), 25, 40, 63, 64, 65, 90]:
        base = [rng.choice("0123456789ab") for _ in range(n)]
        for _ in range(5):
            x = list(base)
            for _ in range(rng.randrange(n // 4 + 2)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randrange(2)] = rng.choice(["", "7", "c"])
            items.append("".join(x))
    items = sorted(set(items), key=lambda x: rng.random())
    df = spark.createDataFrame(list(enumerate(items)), "id long, norm string")
    got = {(r.a, r.b): r.score for r in grouping.similar_pairs(df, threshold).collect()}
    want = {(i, j): grouping.similarity(items[i], items[j]) for i in range(len(items)) for j in range(i + 1, len(items))}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items() if v > threshold}
    assert len({len(items[a]) for a, _ in got}) > (10 if threshold < 95 else 3)


def test_pairs_of_blocks():
    """All pairs of two blocks and within one, also beyond 64 characters, with a character many times, and of lengths that are left out."""
    from veilframe.operators import grouping

    draw = random.Random(9)
    texts = ["".join(draw.choice("0123456789.0é") for _ in range(draw.choice((1, 2, 6, 11, 16, 16, 23, 70)))) for _ in range(90)]
    texts += ["".join(c for c in t if draw.random() < 0.9) + draw.choice("1.é") for t in texts]
    for threshold in (60, 80, 95):
        near = lambda i, j: grouping.similarity(texts[i], texts[j])
        block, apart = grouping.Block(texts), None
        got = {(i, j): s for p, q, some in grouping.alike(block, block, threshold, apart, True) for i, j, s in zip(p.tolist(), q.tolist(), some.tolist())}
        assert got == {(i, j): near(i, j) for j in range(len(texts)) for i in range(j) if near(i, j) > threshold} and got
        low, high = grouping.Block(texts[:90]), grouping.Block(texts[90:])
        got = {(i, j + 90) for p, q, _ in grouping.alike(low, high, threshold) for i, j in zip(p.tolist(), q.tolist())}
        assert got == {(i, j) for i in range(90) for j in range(90, 180) if near(i, j) > threshold}


@pytest.mark.parametrize("n, m", [(17, 17), (17, 18), (16, 18), (15, 20), (21, 21), (22, 24), (9, 9), (5, 6), (30, 33)])
def test_halves_that_meet(monkeypatch, n, m):
    """Texts whose halves don't meet aren't compared: the same pairs as of all with all, characters left out and put in anywhere; names leave few of all pairs."""
    from veilframe.operators import grouping

    draw = random.Random(n * m)
    some = lambda size: "".join(draw.choice(("an", "el", "jo", "ström", "ley", "é", "ko ", "b")) for _ in range(size))[:size]
    x = list(dict.fromkeys(some(n) for _ in range(1100)))
    y = []
    for t in x:  # as long as the others are, by some steps to and fro
        for _ in range(draw.randrange(3)):
            k = draw.randrange(len(t) + 1)
            t = t[:k] + draw.choice("ankoxé ") + t[k:]
        while len(t) != m:
            k = draw.randrange(len(t))
            t = t[:k] + t[k + 1 :] if len(t) > m else t[:k] + draw.choice("ankoxé ") + t[k:]
        y.append(t)
    y = list(dict.fromkeys(y))
    pairs = lambda threshold, a, b: sorted((i, j, s) for p, q, each in grouping.alike(grouping.Block(a), grouping.Block(b), threshold, None, a is b) for i, j, s in zip(p.tolist(), q.tolist(), each.tolist()))
    monkeypatch.setattr(grouping, "LEAVE", 1)
    own, used = grouping.by_halves, []
    for threshold in (80, 85, 95):
        for a, b in ((x, y), (x, x)):
            monkeypatch.setattr(grouping, "by_halves", lambda *z: used.append(own(*z)) or used[-1])
            got = pairs(threshold, a, b)
            monkeypatch.setattr(grouping, "by_halves", lambda *z: None)
            assert got == pairs(threshold, a, b)
    left = [len(z[0]) for z in used if z is not None]
    assert n < 9 or left and (n < 15 or min(left) < len(x) * len(y) / 50)


@pytest.mark.parametrize("begin", ["", "ab", "supplier#0000", "x" * 60])
def test_blocks_with_a_common_begin(begin):
    """What all texts begin with isn't compared: the same pairs and similarities, whole texts' lengths deciding."""
    from veilframe.operators import grouping

    draw = random.Random(8)
    x, y = ([begin + "".join(draw.choice("0123456789p") for _ in range(draw.randrange(0 if begin else 1, 9))) for _ in range(80)] for _ in range(2))
    assert grouping.shared_begin(x, y) >= len(begin)
    for threshold in (60, 85):
        got = {(i, j): s for p, q, some in grouping.alike(grouping.Block(x), grouping.Block(y), threshold) for i, j, s in zip(p.tolist(), q.tolist(), some.tolist())}
        assert got == {(i, j): s for i, a in enumerate(x) for j, b in enumerate(y) if (s := grouping.similarity(a, b)) > threshold} and got


@pytest.mark.parametrize("few, meets", [(0, 100), (0, 10**9), (10**6, 100)])
def test_both_ways_to_pairs(spark, monkeypatch, few, meets):
    """By keys and blocks, by blocks as keys are shared by too many, and by blocks alone: the same pairs, each once."""
    from veilframe.operators import grouping

    monkeypatch.setattr(grouping, "FEW", few)
    monkeypatch.setattr(grouping, "MEETS", meets)
    draw = random.Random(4)
    texts = list(dict.fromkeys(["%06d" % draw.randrange(3000) for _ in range(120)] + ["".join(draw.choice("01") for _ in range(draw.choice((16, 17, 21)))) for _ in range(60)]))
    got = sorted((r.a, r.b) for r in grouping.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, norm string"), 80).collect())
    assert got == [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grouping.similarity(texts[i], texts[j]) > 80]


@pytest.mark.parametrize("made", [0, 10**9])
def test_keys_that_pay(spark, monkeypatch, made):
    """Keys are made only where they are less work than the pairs of blocks that they replace: the same pairs either way."""
    from veilframe.operators import grouping

    names = {14: 2549, 15: 4811, 16: 8178, 17: 11380, 18: 9237, 19: 5112, 20: 3172}  # 44,000 of some lengths
    assert not grouping.keys_pay(names, 85) and grouping.keys_pay({n: 40 * k for n, k in names.items()}, 85) and grouping.keys_pay({6: 10**6}, 80)
    monkeypatch.setattr(grouping, "FEW", 0)
    monkeypatch.setattr(grouping, "MADE", made)
    asked, own = [], grouping.by_deletion
    monkeypatch.setattr(grouping, "by_deletion", lambda *x: asked.append(x) or own(*x))
    draw = random.Random(5)
    texts = list(dict.fromkeys("%06d" % draw.randrange(3000) for _ in range(120)))
    got = sorted((r.a, r.b) for r in grouping.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, norm string"), 80).collect())
    assert got == [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grouping.similarity(texts[i], texts[j]) > 80] and bool(asked) == (made == 0)


@pytest.mark.parametrize("pays", [0.0, 1.1])
def test_leaders_by_rounds(spark, monkeypatch, pays):
    """Many texts that are alike: leaders one by one, in rounds to the end or with pairs of those that a round leaves. No table has all pairs."""
    from veilframe.operators import grouping

    for name, value in (("HEAD", 150), ("LEADS", 3), ("PAYS", pays)):
        monkeypatch.setattr(grouping, name, value)
    items = ["", *(f"supplier#{k:09d}" for k in range(0, 60_000, 61))]
    df = spark.createDataFrame(list(enumerate(items)), "id long, norm string")
    got = {r.id: r.leader for r in grouping.led(df, 85).collect()}
    assert got == plain_leaders(items, lambda x, y: grouping.similarity(x, y) > 85) and len(set(got.values())) > 12


def test_six_digits_at_scale(spark):
    """No key has more rows than six digits allow; the pairs of some against all others by brute force."""
    from veilframe.operators import grouping

    n = 1_000_000
    items = spark.range(n).select("id", F.lpad((F.col("id") * 7919 % n).cast("string"), 6, "0").alias("norm"))
    assert grouping.keyed(items, 80).groupBy("key").count().agg(F.max("count")).first()[0] <= 55
    items = grouping.kept(items.where("id % 10 = 0"))
    few = [r.norm for r in items.where("id % 100000 = 0").collect()]
    all_ = [r.norm for r in items.collect()]
    near = grouping.by_deletion(items, 80)
    norm = items.select(F.col("id").alias("_id"), "norm")
    met = near.join(norm, F.col("a") == F.col("_id")).select("b", F.col("norm").alias("x")).join(norm, F.col("b") == F.col("_id")).select("x", F.col("norm").alias("y"))
    got = {frozenset(r) for r in met.where(F.col("x").isin(few) | F.col("y").isin(few)).collect()}
    want = set()
    for x in few:
        for y, k in zip(all_, grouping.subsequences([x] * len(all_), all_).tolist()):
            if x != y and k >= 5:
                want.add(frozenset((x, y)))
    assert got == want and len(want) > 100


def plain_components(n, edges):
    root = list(range(n))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((of(a), of(b)))
        root[b] = a
    return [of(x) for x in range(n)]


@pytest.mark.parametrize("solo", [1_000_000, 60, 0])
def test_leaders_of_graphs(spark, monkeypatch, solo):
    """In one task, by components and in rounds: chains, stars, cliques and random graphs."""
    from veilframe.operators import grouping

    monkeypatch.setattr(grouping, "SOLO", solo)
    rng = random.Random(4)
    edges = {(k, k + 1) for k in range(12)} | {(20, k) for k in range(21, 60)} | {(i, j) for i in range(60, 74) for j in range(i + 1, 74)} | {tuple(sorted(rng.sample(range(80, 140), 2))) for _ in range(50)}
    ids = list(range(150))
    e = spark.createDataFrame(sorted(edges), "a long, b long")
    got = {r.id: r.leader for r in grouping.leaders(spark.createDataFrame([(k,) for k in ids], "id long"), e).collect()}
    assert got == plain_leaders({k: k for k in ids}, lambda x, y: (x, y) in edges)
    roots = {r.id: r.root for r in grouping.components(e).collect()}
    want = plain_components(150, edges)
    assert roots == {k: want[k] for pair in edges for k in pair}
    assert grouping.leaders(spark.createDataFrame([(3,)], "id long"), e.limit(0)).collect() == [(3, 3)]


def test_a_chain_takes_few_steps(spark, monkeypatch):
    from veilframe.operators import grouping

    n, order = 10_000, list(range(10_000))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([tuple(sorted(p)) for p in zip(order, order[1:])], "a long, b long")
    steps = []
    monkeypatch.setattr(grouping, "kept", lambda df, kept=grouping.kept: steps.append(1) or kept(df))
    monkeypatch.setattr(grouping, "SOLO", n - 1)
    led = grouping.leaders(spark.range(n), edges)
    assert led.count() == n and len(steps) == 1  # few enough for one task
    steps.clear()
    assert grouping.components(edges).where("root <> 0").count() == 0
    assert len(steps) <= 20


def test_similarity(spark):
    from veilframe.functions.text import indel_similarity, possible_variant
    from veilframe.operators.grouping import similarity

    pairs = [("1234567890", "12345678"), ("", ""), ("", "a"), ("john doe", "jon doe"), ("abcbdab", "bdcaba"), ("aaaa", "aa"), ("ø\U0001f600x", "x\U0001f600")]
    got = spark.createDataFrame(pairs, "a string, b string").select(indel_similarity(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 9) for r in got] == [round(similarity(*p), 9) for p in pairs]
    assert round(similarity("1234567890", "12345678"), 1) == 88.9
    names = [("J. Doe", "John Doe", False), ("J. Doe", "John A. Doe", True), ("Doe", "John Doe", True), ("John", "John", False), ("", "John", False), ("Doe John", "John Doe Smith", False), ("Åse L.", "Aase Marie Lund", True)]
    got = spark.createDataFrame(names, "a string, b string, c boolean").select(possible_variant(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [x[2] for x in names]


def test_name_merge(spark):
    from veilframe.operators import grouping

    names = ["Doe", "John Doe", "Jane Smith", "Smith", "Ann Smith", "J. A. Doe"]
    df = spark.createDataFrame([("person", n, k + 1) for k, n in enumerate(names)], "category string, surface string, ord long")
    got = grouping.dictionary(df, ["person"]).orderBy("entity_no", "variant_no").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.id, []).append(r.variant)
    assert ["Smith"] in groups.values()  # two longer names fit


@pytest.mark.parametrize("alone", [1000, 0])
def test_name_groups_by_brute_force(spark, monkeypatch, alone):
    """Names of one to three words, short forms and similar spellings: groups as they come out one by one, by all pairs."""
    from veilframe.operators import grouping

    monkeypatch.setattr(grouping, "ALONE", alone)
    rng = random.Random(9)
    words = ["Anna", "Åse", "Bo", "Christensen", "Christiansen", "D'Arc", "El-Sayed", "Lee", "Li", "Ødegaard", "Jo.", "A.", "Ch.", "L.", "Xx.", "Long.", "phone"]
    names = list(dict.fromkeys(rng.choice([" ", " ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([1, 1, 2, 2, 2, 3, 3]))) for _ in range(160)))
    names += ["A. B. C. D.", "12", "Anna 7"]
    df = spark.createDataFrame([("person", n, k + 1) for k, n in enumerate(names)], "category string, surface string, ord long")

    def norm(x):
        for old, new in (("å", "aa"), ("æ", "ae"), ("ø", "oe"), ("-", ""), ("\n", " ")):
            x = x.lower().replace(old, new)
        return x

    def fits(short, full):
        a, b, at = norm(short).split(), norm(full).split(), 0
        if not a or len(a) >= len(b):
            return False
        for w in a:
            at = next((k + 1 for k in range(at, len(b)) if b[k] == w or (w.endswith(".") and len(w) <= 4 and b[k][0] == w[0])), None)
            if at is None:
                return False
        return True

    valid = [n for n in names if 1 <= len(n.split()) <= 3 and all(any(c.isalpha() for c in w) and w.lower() != "phone" for w in n.split())]
    leader = plain_leaders(valid, lambda x, y: grouping.similarity(norm(x), norm(y)) > 85)
    groups = {}
    for k, to in leader.items():
        groups.setdefault(to, []).append(valid[k])
    order = sorted(groups.values(), key=lambda g: -max(map(len, g)))
    rep = [max(g, key=len) for g in order]
    merged = [list(g) for g in order]
    for k, r in enumerate(rep):
        near = [j for j in range(k) if fits(r, rep[j])]
        if len(near) == 1:
            merged[near[0]] += order[k]
            merged[k] = []
    want = [(no, v + 1, x) for no, g in enumerate([g for g in merged if g], 1) for v, x in enumerate(g)]
    got = grouping.dictionary(df, ["person"]).orderBy("entity_no", "variant_no").collect()
    assert [(r.entity_no, r.variant_no, r.variant) for r in got] == want
    assert any(not g for g in merged) and any(len(g) > 1 for g in order)


def test_hyphens(spark):
    a = Anonymizer("en", spark)
    text = "Johan-\nnes a-\nb-\nc x -\ny 12-\n34"
    joined, back = a.preprocess_text(text)
    assert joined == "Johannes abc x -\ny 1234"
    for i in range(len(joined)):
        for j in range(i + 1, len(joined) + 1):
            s, e = back(i, j)
            assert text[s:e].replace("-\n", "") .replace("-", "").replace("\n", "") == joined[i:j].replace("-", "").replace("\n", "")
    assert back(99, 100) == (len(text), len(text))


def test_streaming(spark, tmp_path):
    from veilframe.streaming.rewrite import read_stream, replaced, write_stream

    spark.createDataFrame([(1, "John Doe was here"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    a = Anonymizer("en", spark)
    a.load_replacements({"PERSON": [{"id": "<PERSON_1>", "variants": ["John Doe"]}]})
    q = write_stream(read_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), a.dictionary(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {c: n for c, n in replaced(q).items() if n} == {"person": 1}
    assert {(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "<PERSON_1> was here"), (2, None)}


def test_streaming_with_large_dictionaries(spark, tmp_path, monkeypatch):
    from veilframe.operators import rewrite
    from veilframe.streaming.rewrite import read_stream, write_stream

    rows = [("person", k, f"<PERSON_{k}>", 1, f"John Doe{k}", None) for k in range(1, 9)] + [("general_number", 1, "<N>", 1, "7", None)]
    d = spark.createDataFrame(rows, "category string, entity_no int, id string, variant_no int, variant string, pattern string")
    docs = spark.createDataFrame([(k, f"John Doe{k} was 7 here") for k in range(12)], "doc_id long, text string")
    want = sorted(map(repr, rewrite.pseudonymize(docs, d).select("doc_id", "text").collect()))
    docs.write.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(rewrite, "RULES", 3)
    for way in ("sent", "turn"):
        if way == "turn":
            in_turn(monkeypatch, 4)
        write_stream(read_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), d, str(tmp_path / way), str(tmp_path / f"{way}-cp")).awaitTermination(120)
        assert sorted(map(repr, spark.read.parquet(str(tmp_path / way)).select("doc_id", "text").collect())) == want


def test_models(spark):
    from veilframe.operators import detect as D

    def model(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(d, "PERSON", t.index("Zed"), t.index("Zed") + 3, 0.9) for d, t in zip(b.doc_id, b.text) if "Zed" in t], columns=["doc_id", "entity_type", "start", "end", "score"])

    docs = spark.createDataFrame([(1, "Hi Zed"), (2, "none")], "doc_id long, text string")
    got = D.detect(docs, D.Registry.default().add_model(model)).collect()
    assert [(r.doc_id, r.surface, r.category) for r in got] == [(1, "Zed", "person")]
    # spans stay with their rows, whatever the ids
    find = D.model_from(lambda t: [("PERSON", t.index(w), t.index(w) + len(w), 0.9) for w in ("Zoltan", "Ödön") if w in t])
    docs = spark.createDataFrame([(1, "Zoltan went home today"), (1, "abcdefghijkl mnop"), (None, "met\nÖdön"), (None, None), (2, "co-\nmet Zol-\ntan")], "doc_id long, text string")
    got = D.detect(docs, D.Registry([]).add_model(find).add_model(D.model_from(lambda t: []))).collect()
    assert sorted((str(r.doc_id), r.surface, r.start, r.end) for r in got) == [("1", "Zoltan", 0, 6), ("2", "Zol-\ntan", 8, 16), ("None", "Ödön", 4, 8)]
    assert D.detect(docs.limit(0), D.Registry([]).add_model(find)).count() == 0


def test_places_with_what_stands_before(spark):
    from veilframe.functions.spans import places_with

    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "x", "é", "\U0001f600", " ", "abab", "a"]) for _ in range(n)) for n in (0, 1, 2, 5, 40, 40, 200)] + [None, "ab" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for before, of_bytes in ((7, True), (7, False), (1, True)):
        got = [r[0] for r in df.select(places_with(F.col("t"), "ab", before, 2, of_bytes)).collect()]
        for t, found in zip(texts, got):
            if t is None:
                assert not found
                continue
            want = [(m.start(), m.end(), "ab", t[max(0, m.start() - before) : m.start()], len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer("ab", t)]
            assert [tuple(x) for x in found] == [w if of_bytes else w[:4] for w in want]


def test_spans_that_overlap_none(spark):
    from veilframe.operators.detect import not_overlapping

    rng = random.Random(6)
    span = lambda: (rng.choice([1, 1, 1, 2, None]), (a := rng.choice([None, *range(90)])), None if a is None or rng.random() < 0.05 else a + rng.choice([0, 1, 2, 3, 9]))
    base, extra = [span() for _ in range(60)], [(*span(), rng.random()) for _ in range(300)]
    b, e = (spark.createDataFrame(rows, f"doc_id long, start int, end int{more}") for rows, more in ((base, ""), (extra, ", _end double")))
    clash = lambda x, y: None not in (*x[:3], *y[:3]) and x[0] == y[0] and x[1] < y[2] and y[1] < x[2]
    want = [x for x in extra if not any(clash(x, y) for y in base)]
    assert sorted(map(repr, map(tuple, not_overlapping(b, e).collect()))) == sorted(map(repr, want)) and 20 < len(want) < 280
    assert not_overlapping(b.limit(0), e).count() == 300 and not_overlapping(b, e.limit(0)).count() == 0


def test_a_document_with_a_million_spans(spark):
    """All in one document: every third span of extra touches two of base, the others overlap one."""
    from veilframe.operators.detect import not_overlapping

    n = 1_000_000
    base = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 30).alias("start"), (F.col("id") * 30 + 20).alias("end")).union(spark.createDataFrame([(2, 0, 10**9)]))
    extra = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 30 + 20).alias("start"), (F.col("id") * 30 + 30 + F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("end"), "id")
    assert not_overlapping(base, extra).agg(F.count("*"), F.sum(F.col("id") % 3)).first() == ((n + 2) // 3, 0)


def test_precedence(spark):
    from veilframe.operators import detect as D

    cases = {"01/02/2020": [("general_number", "2020")], "123456-1234": [("general_number", "123456"), ("general_number", "1234")], "(123456)": [("code_number", "(123456)")], "2020-12345": [("id_number", "2020-12345")], "01.02.20": [("date_number", "01.02.20")], "code 12 34 5678": [("general_number", "12 34 5678")]}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {}
    for r in D.detect(docs).orderBy("doc_id", "sel_rank").collect():
        got.setdefault(r.doc_id, []).append((r.category, r.surface))
    assert list(got.values()) == list(cases.values())
    assert list(got) == list(range(len(cases)))


def test_typst_export(spark, tmp_path):
    (tmp_path / "d.md").write_text('# Hi\nAnn "x" met 12 34 and 12-34.')
    a = Anonymizer("en", spark)
    a.load_replacements({"PERSON": [{"id": "<PERSON_1>", "variants": ["Ann"]}], "GENERAL_NUMBER": [{"id": "<GENERAL_NUMBER_1>", "variants": ["12 34", "12-34"]}], "LOCATION": [{"id": "<LOCATION_1>", "variants": ['a\\b"c']}]})
    counts, (main, real, fake) = export_typst(tmp_path / "d.md", a, tmp_path / "sub" / "d.typ")
    assert main.read_text() == '#import "d_vars.typ": *\n\n= Hi\n#(P1V1) "x" met #(GN1V1) and #(GN1V2).'
    assert '#let A1V1 = "a\\\\b\\"c"\n' in real.read_text()
    values = re.findall(r'GN1V\d = "(\d\d[ -]\d\d)"', fake.read_text())
    assert len(values) == 2 and values[0].replace(" ", "") == values[1].replace("-", "")
    assert counts["general_number_replaced"] == 2


def test_dictionary_as_yaml_and_table(spark, tmp_path, capsys):
    """The file round trip, what isn't allowed in it, and a dictionary as a table on the command line."""
    from veilframe import cli
    from veilframe.sources import dictionary as K

    mapping = {"PERSON": [{"id": "<PERSON_1>", "variants": ["Ann", "A: \"n\"\n"], "pattern": "x"}], "LOCATION": [{"id": "<LOCATION_1>", "variants": []}], "OTHER": 3}
    entities = K.Dictionary(mapping)
    again = K.from_yaml(K.to_yaml(entities))
    assert again.plain() == entities.plain() and again.person[0].variants[1] == 'A: "n"\n' and again.plain()["EMAIL_ADDRESS"] == []
    assert K.from_rows(K.to_rows(spark, entities)).plain()["PERSON"] == mapping["PERSON"]
    assert K.from_yaml("").plain() == K.Dictionary().plain()
    for wrong in ([1], {"PERSON": 1}, {"PERSON": [1]}, {"PERSON": [{"id": 1, "variants": []}]}, {"PERSON": [{"id": "a", "variants": [1]}]}, {"PERSON": [{"id": "a"}]}, {"PERSON": [{"id": "a", "variants": [], "pattern": 1}]}):
        with pytest.raises(ValueError):
            K.Dictionary(wrong)
    with pytest.raises(AttributeError):
        entities.nobody
    text = tmp_path / "a.md"
    text.write_text("Hello John Doe and Jon Doe, CPR: 123456-1234")
    cli.extract([str(text)], str(tmp_path / "d.parquet"))
    cli.extract([str(text)], str(tmp_path / "d.yaml"))
    done = []
    for name in ("d.parquet", "d.yaml"):
        cli.plain(str(text), str(tmp_path / name), str(tmp_path / f"{name}.md"))
        done.append((tmp_path / f"{name}.md").read_text())
    assert done[0] == done[1] and "<PERSON_1>" in done[0] and "John" not in done[0]
    assert "PERSON replaced: 2" in capsys.readouterr().out


def test_preview_stands_out_on_a_terminal(monkeypatch):
    from veilframe import cli

    assert cli._shown("a <PERSON_1> #(P1V2)") == "a <PERSON_1> #(P1V2)"
    monkeypatch.setattr(cli.sys.stdout, "isatty", lambda: True, raising=False)
    assert cli._shown("a <PERSON_1> #(P1V2) <x>") == "a \033[1;36m<PERSON_1>\033[0m \033[1;36m#(P1V2)\033[0m <x>"


def test_a_dictionary_that_grows_with_a_stream(spark, tmp_path):
    """Three batches of a stream and a restart between them give the dictionary of one batch; a batch that is run again changes nothing."""
    from veilframe.operators import detect as D
    from veilframe.operators import grouping
    from veilframe.streaming import dictionary as growing

    rng = random.Random(9)
    number = lambda: "".join(rng.choice("0123456789") for _ in range(rng.choice((4, 5, 6))))
    known = [number() for _ in range(40)]
    near = lambda x: x[:2] + rng.choice("0123456789") + x[3:]
    texts = [" and ".join(rng.choice((number, lambda: rng.choice(known), lambda: near(rng.choice(known))))() for _ in range(20)) + f" a{rng.randrange(9)}@x.org (" + number()[:4] + "77)" for _ in range(12)]
    registry = lambda: D.Registry.default().named("digit_sequence", "email", "parenthesized_code")
    docs = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    rows = list(enumerate(texts)) + [(12, None), (13, ""), (14, texts[0])]
    folder, source, state = (str(tmp_path / x) for x in ("dictionary", "in", "state"))
    for part in (rows[:5], rows[5:6], rows[6:]):
        docs(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)  # a new query each time goes on from the checkpoint
        growing.extend_stream(stream, folder, state, registry()).awaitTermination()
    show = lambda df: sorted((r.category, r.id, r.variant_no, r.variant) for r in df.collect())
    want = show(grouping.dictionary(D.mentions(D.detect(docs(rows), registry())), ["email_address", "code_number", "general_number"]))
    assert len(want) > 100 and any(v > 1 for _, _, v, _ in want) and show(growing.dictionary(spark, folder)) == want
    growing.extend(folder, D.mentions(D.detect(docs(rows[5:6]), registry())), 1)
    assert show(growing.dictionary(spark, folder)) == want
