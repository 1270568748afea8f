"""URL rules and mixing against plain Python, and the registered queries against their SQL."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_urls(spark):
    from veilframe.llm import urlrules

    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "x://example.com", "x://example.com/", "x://a.example.com/en/", "x://example.com/EN/", "x://notexample.com/en/1", "x://net/es/", "x://.net/fr/", "x://net./fr/", "a://b://c.net/es/", "x://" + "a." * 300 + "net/es/" + "y" * 5000, "x://www.example.com?/en/", "x://com/a\nb"]
    rows = [(k // 2, u, "clash") for k, u in enumerate(urls)] + [(None, "x://example.com/en/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    rules = spark.createDataFrame([*urlrules.RULES, ("block", "Example.org", ""), ("allow", "example.org", "/e"), ("block", "example.org", "/e"), ("block", "", "/")], "verdict string, host string, path string")
    plain = [(v, h.lower(), p) for v, h, p in [*urlrules.RULES, ("block", "Example.org", ""), ("allow", "example.org", "/e"), ("block", "example.org", "/e")]]

    def judged(u):
        u = u or ""
        m = re.search(r"://([^/?#]*)([^?#]*)", u)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in plain if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, 0, None, "allow"))
        return host, path, best[3], best[4]

    got = urlrules.judge(df, rules)
    assert Counter(map(tuple, got.collect())) == Counter((i, *judged(u)) for i, u, _ in rows)
    assert urlrules.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urlrules.judge(df, rules.limit(0), "block").collect()} == {"block"}


def filled(sizes, weights, most=3):
    """Targets by resharing the excess until no source is above its cap."""
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        w = sum(weights[k] for k in open_)
        above = {k for k in open_ if weights[k] * left / w > most * sizes[k]}
        if not above:
            for k in open_:
                target[k] = weights[k] * left / w
            break
        for k in above:
            target[k] = float(most * sizes[k])
            left -= target[k]
        open_ -= above
    return target


def test_mix(spark):
    from veilframe.llm import curriculum

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(k, "w " * (k % 40), None) for k in range(5000, 5060)] + [(1, None, "empty"), (2, "", "empty"), (3, "a b", "é"), (3, "a b", "é"), (None, "x y z", "Z"), (4, "b " * 9, "\U0001f600"), (5, "c " * 7, "\uffff")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, source string, size int, target string").repartition(6)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    target = dict(zip(order, filled([sizes[s] for s in order], [k % 3 + 1 for k in range(len(order))])))
    for bucket in (4096, 8):
        curriculum.BUCKET = bucket
        got = curriculum.mix(df).collect()
        again = curriculum.mix(df.repartition(2)).collect()
        curriculum.BUCKET = 4096
        assert Counter(map(repr, got)) == Counter(map(repr, again))
        assert len(got) == len(rows)
        taken = Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
            assert r.taken == r.copies * r["size"] <= 3 * r["size"] and len(r.positions) == r.copies
            assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
            taken[r.source] += r.taken
        largest = Counter()
        for r in got:
            largest[r.source] = max(largest[r.source], r["size"])
        assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    # positions by the plain definition: documents of a source in the order of a digest, each copy's middle inverted by bisection
    places, at = {s: k for k, s in enumerate(order)}, Counter()
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    turns = sorted((digest("" if d is None else str(d)), len(WORD.findall(t or "")), digest(t or ""), repr((d, s)), d, s) for d, t, s in rows)
    want = []
    for _, size, _, _, d, s in turns:
        m, at[s] = at[s] + size / 2, at[s] + size
        values = curriculum.SCHEDULES[places[s] % 3]
        want.append((d, s, size, [inverse(x / target[s], values) for x in (m, m + sizes[s], m + 2 * sizes[s]) if x < target[s] - 1e-9]))
    key = lambda x: repr((x[0], x[1], x[2], [round(p, 6) for p in x[3]]))
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.source, r["size"], r.positions)) for r in got)
    out = curriculum.ordered(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    own = df.select("doc_id", "text", "source", F.lit("mine").alias("size"), F.lit("x").alias("copies"), F.lit(7).alias("_key"), F.lit(8).alias("_source"), F.lit(9).alias("key"), F.create_map(F.lit("a"), F.col("doc_id")).alias("_m"))
    out = curriculum.ordered(own).collect()
    assert {(r["size"], r.copies, r._key, r._source, r.key) for r in out} == {("mine", "x", 7, 8, 9)} and all(r._m == {"a": r.doc_id} for r in out)
    least = {}
    for d, s, _, p in want:
        for x in p:
            least.setdefault((d, s), []).append(x)
    firsts = [min(least[r.doc_id, r.source]) for r in dict.fromkeys((r.doc_id, r.source) for r in out) for r in [next(x for x in out if (x.doc_id, x.source) == r)]]
    assert all(a <= b + 1e-9 for a, b in zip(firsts, firsts[1:]))
    assert Counter((r.doc_id, r.source) for r in out) == Counter({k: len(v) for k, v in least.items()})
    assert curriculum.mix(df.limit(0)).count() == 0 and curriculum.ordered(df.limit(0)).count() == 0


def inverse(share, values):
    """The time at which the integral of a schedule has reached a share of the whole, by bisection."""
    n = len(values) - 1

    def until(t):
        return sum(max(0.0, min(1.0, t * n - k)) * (a + (b - a) * max(0.0, min(1.0, t * n - k)) / 2) for k, (a, b) in enumerate(zip(values, values[1:])))

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if until(mid) < share * until(1.0) else (lo, mid)
    return lo


def test_positions():
    from veilframe.llm import curriculum

    for values in ((1.5, 1.0, 0.5), (1.0, 1.0), (0.0, 2.0), (3.0, 0.0, 1.0, 2.0)):
        at = curriculum.integrals(values)
        assert at[0] == 0 and abs(at[-1] - 1) < 1e-12 and at == sorted(at)


def test_position_inverts(spark):
    from pyspark.sql import functions as F

    from veilframe.llm import curriculum

    for values in ((1.5, 1.0, 0.5), (1.0, 1.0), (0.0, 2.0), (3.0, 0.0, 1.0, 2.0)):
        n = len(values) - 1
        area = sum((a + b) / 2 for a, b in zip(values, values[1:])) / n

        def demand(t):
            k = min(int(t * n), n - 1)
            x = t - k / n
            return sum((a + b) / 2 / n for a, b in zip(values[:k], values[1 : k + 1])) / area + (values[k] * x + (values[k + 1] - values[k]) * n * x * x / 2) / area

        for r in spark.range(0, 101).select((F.col("id") / 100).alias("u"), curriculum.position(F.col("id") / 100, values).alias("t")).collect():
            assert abs(demand(r.t) - r.u) < 1e-9


@pytest.mark.parametrize("name", ["op6_url_filters", "op9_curriculum", "op11_fill_in_middle", "op12_peak_concurrency", "op13_substring_dedup"])
def test_sql(spark, name):
    import duckdb

    from veilframe.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "sales", "sale_lines", "clients"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns).collect()
    near = lambda row: repr([round(x, 6) if isinstance(x, float) else x for x in row])
    assert Counter(map(near, want.fetchall())) == Counter(map(near, got))


def test_parts_that_are_met_again_stay():
    """When an encoder's parts are too many, those that later batches had too stay, however many it met once; ids are those of the tokenizer."""
    import pyarrow as pa
    import public_tokenizers

    from veilframe.llm.rans import Encoder

    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.MOST = 50
    texts = [f"the same words, always the same {k}x{k} y{k}. And\nnew{k} lines {k}" for k in range(200)]
    got = [ids for k in range(0, 200, 5) for ids in enc.batch(pa.array(texts[k : k + 5]))]
    assert got == [enc._of(t).tobytes() for t in texts]
    assert {" same", " words", " always", "\nnew"} & set(enc.parts.to_pylist()) >= {" same", " words", " always"} and len(enc.parts) <= 2 * enc.MOST
