"""The stages of the pipeline, each on its own input, against plain Python."""

import random
from collections import Counter

from test_pairs import WORD, shingles
from test_rows import pii_base, quality_base
from test_tables import filled

from veilframe.functions.frames import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    rng = random.Random(4)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS).collect()]
    text = " ".join(f"the {rng.choice(['of', 'and', 'to'])} word{rng.randrange(99)} mail{k}@host.example.org is" for k in range(60))
    rows += [(900 + k, text.replace("word7 ", f"other{k} "), "en", "src1", len(text)) for k in range(6)]
    rows += [(950, None, None, None, None), (951, "", "en", None, 0), (952, "x " * 500, "xx", "src1", 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in p.STAGES:
        out = materialize(stage(spark, docs, sf))
        seen[name] = ([tuple(r) for r in docs.select(*COLUMNS).collect()], [tuple(r) for r in out.collect()] if name == "SentencePiece encoding" else [tuple(r) for r in out.select(*COLUMNS).collect()])
        if name != "SentencePiece encoding":
            assert out.columns == COLUMNS
        docs = out
    before, after = seen["quality rules"]
    assert not Counter(after) - Counter(before)
    assert all(not quality_base(r[1] or "")[-1] for r in after) and len(after) > 0.6 * len(before)
    before, after = seen["n-gram Jaccard join"]
    assert not Counter(after) - Counter(before)
    sets = [shingles(r[1]) for r in after]
    for i, x in enumerate(sets):
        assert all(5 * len(x & y) < 4 * len(x | y) for y in sets[:i] if x and y)
    kept = [shingles(r[1]) for r in after]
    for r in set(before) - set(after):  # what goes is linked to something that was there
        x = shingles(r[1])
        assert any(5 * len(x & shingles(y[1])) >= 4 * len(x | shingles(y[1])) for y in before if y != r)
    assert len(kept) == len(after)
    before, after = seen["personal data"]
    assert sorted(r[0] for r in before) == sorted(r[0] for r in after)
    texts = {r[0]: r[1] for r in before}
    for r in after:
        assert not pii_base(r[1]) and r[4] == len(r[1])
        assert pii_base(texts[r[0]]) or "[" in r[1] or r[1] == texts[r[0]]
    before, after = seen["mixing to target weights"]
    assert not set(after) - set(before) and max(Counter(after).values()) <= 3
    size = lambda r: len(WORD.findall(r[1] or ""))
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r[3]] += size(r)
    for r in after:
        taken[r[3]] += size(r)
    order = [*sorted((s for s in sizes if s is not None), key=lambda s: s.encode()), *[None] * (None in sizes)]
    for s, target in zip(order, filled([sizes[s] for s in order], [k % 3 + 1 for k in range(len(order))])):
        assert abs(taken[s] - target) <= max(size(r) for r in before if r[3] == s)
    before, after = seen["SentencePiece encoding"]
    assert len(before) == len(after) and all(r[-1] for r in after)


def test_run(spark):
    import corpus_pipeline as p

    import os

    from veilframe.functions.frames import shared_dir

    top = shared_dir(spark).rsplit("/", 1)[0].removeprefix("file:")
    there = set(os.listdir(top))
    out = p.run(spark, "/root/testdata/sf0.001")
    assert len(set(os.listdir(top)) - there) == 1  # the table that the last stage reads
    rows, docs = out.collect(), {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} <= docs.keys() and all(r.round_trip for r in rows)
    assert len(p.STAGES) == 5


def test_odd_tables(spark):
    """Each stage by itself: no rows, nulls alone, and columns under the operators' own names."""
    import corpus_pipeline as p

    sf, kind = "/root/testdata/sf0.001", "doc_id long, text string, lang string, source string, n_chars long"
    nulls = spark.createDataFrame([(None,) * 5] * 3 + [(1, None, None, None, None), (1, "", "", "", 0)], kind)
    clashing = spark.read.parquet(f"{sf}/documents.parquet").limit(40).selectExpr("*", "1 AS key", "'x' AS _m", "map(1, 2) AS _c", "2 AS size", "3 AS node", "'k' AS kept", "4.5 AS position", "array(1) AS `a.b`")
    for name, stage in p.STAGES:
        assert stage(spark, nulls.limit(0), sf).count() == 0, name
        got = stage(spark, nulls, sf).collect()
        # without words: rejected by the rules, in no mix, and alike to nothing
        assert len(got) == {"quality rules": 0, "mixing to target weights": 0}.get(name, 5), name
        out = stage(spark, clashing, sf)
        if name != p.STAGES[-1][0]:
            assert out.columns == clashing.columns, name
            rows = out.collect()
            assert rows and {(r.key, r._m, str(r._c), r["size"], r.node, r.kept, float(r.position), str(r["a.b"])) for r in rows} == {(1, "x", "{1: 2}", 2, 3, "k", 4.5, "[1]")}, name
