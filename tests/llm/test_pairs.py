"""Operators whose rows meet, against brute force in plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, size string"


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    for k in range(120):  # a large group of near copies
        words = list(base)
        for _ in range(k % 9):
            words[rng.randrange(300)] = f"x{k}"
        rows.append((20_000 + k, " ".join(words), "en", "s", None))
    for k in range(80):  # other texts that share a long passage
        rows.append((30_000 + k, " ".join(base[:100] + [f"y{k}_{i}" for i in range(200)]), "en", "s", None))
    rows += [(40_000 + k, t, "en", None, None) for k, t in enumerate([None, "", " \n", "one", "one", "one two three", "a b c d e", "a  b\tc d\ne", "z" * 100_000, "é " * 20_000])]
    rows += [rows[0], rows[0], (None, "one two three", None, None, None), (rows[3][0], "another text under the same id as one before it", None, None, None)]
    rows = [(*r, 1, "n", "s") for r in rows]
    return rows, spark.createDataFrame(rows, DOCS).repartition(7)


def test_join(spark, docs):
    from veilframe.llm import chosen_path

    rows, df = docs
    sets = [shingles(r[1]) for r in rows]
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None and sets[i]:
            least[root(i)] = min(least.get(root(i), 1 << 60), rows[i][0])
    want = Counter((rows[i][0], least[root(i)] if sets[i] else rows[i][0], links[i]) for i in range(n))
    before = {f: f.__defaults__ for f in (chosen_path.leaves, chosen_path.blocks, chosen_path.cores)}
    for small, block, bands in ((4096, 2048, 6), (48, 2048, 0), (5, 16, 6)):  # the others: without cores, and deep recursion and many blocks
        chosen_path.leaves.__defaults__ = (*before[chosen_path.leaves][:2], small, chosen_path.DEPTH)
        chosen_path.blocks.__defaults__, chosen_path.cores.__defaults__, chosen_path.BANDS = (block, 1 << 24 if small >= 48 else 20_000), (min(small, 48), block), bands
        try:
            got = Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.join(df).collect())
        finally:
            for f, x in before.items():
                f.__defaults__ = x
            chosen_path.BANDS = 6
        assert sum(x[2] for x in got.elements()) >= 0.999 * sum(links)
        if small >= 48:
            assert got == want
    kept = chosen_path.distinct(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter([*least.values(), *[rows[i][0] for i in range(n) if not sets[i]]])
    own = df.selectExpr("doc_id", "text", "'mine' AS key", "map('a', doc_id) AS _m", "7 AS _row", "'s' AS `set`")
    assert {(r.key, r._row, r["set"], r._m["a"] == r.doc_id) for r in chosen_path.distinct(own).where("doc_id IS NOT NULL").collect()} == {("mine", 7, "s", True)}
    assert chosen_path.join(df.limit(0)).count() == 0


def test_runs():
    from veilframe.llm import chosen_path

    assert chosen_path.runs_for(0.9999, 0.8) * chosen_path.ROOTS >= 6
    assert len({x for r in chosen_path.roots(3).tolist() for x in r}) == 6


def test_recall_of_large_buckets(spark):
    """Pairs at the threshold that share one root bucket with a thousand others that are unlike meet below it."""
    import numpy as np

    from veilframe.llm import chosen_path as c

    rng, n = np.random.default_rng(3), 500
    a = rng.integers(0, 1 << 32, (n, c.TOKENS), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    used = c.roots(3).ravel()
    for x in (a, b):
        x[:, used] = rng.integers(0, 1 << 32, (n, len(used)), dtype=np.uint32)
        x[:, used[0]] = 1
    rows = [(i, s.tobytes()) for i, s in enumerate(np.concatenate([a, b]))]
    nodes = {}
    for r in c.leaves(spark.createDataFrame(rows, "id long, signature binary").selectExpr("id", "id AS unit", "signature"), small=48).collect():
        nodes.setdefault(r.id, set()).add(r.node)
    assert [k for k in range(n) if not nodes.get(k, set()) & nodes.get(n + k, set())] == []


def test_cores(spark):
    """A large group of near copies: all links, most of them without a pair of texts being compared."""
    from veilframe.llm import chosen_path as c

    rng, rows = random.Random(8), []
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    for k in range(400):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 12])):
            words[rng.randrange(400)] = f"x{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t) for _, t in rows]
    links = [sum(5 * len(x & y) >= 4 * len(x | y) for y in sets) - 1 for x in sets]
    before, c.cores.__defaults__ = c.cores.__defaults__, (48, 256)
    got = [r.n_links for r in c.join(df).orderBy("doc_id").collect()]
    c.cores.__defaults__ = before
    assert got == links
    data = c.keyed(df)
    found = c.sketches(data)
    classes = found.groupBy("set").agg(c.F.min("key").alias("key"), c.F.min("signature").alias("signature"), c.F.min("doc").alias("id"))
    classes = c.materialize(classes)
    assert c.cores(data, classes, 0.8, 5, small=48).count() > 0.5 * classes.count()


def test_miss_of_whole_recursion():
    """Pairs at the threshold for which no bucket is ever small: followed through the nodes that both are in."""
    import numpy as np

    from veilframe.llm import chosen_path as c

    runs, wide = c.plan(c.RECALL, 0.8)
    least = c.least_agreement(c.RECALL, 0.8)
    assert c.missed(0.8, runs, wide, least) < 1 - c.RECALL
    rng, n = np.random.default_rng(4), 1500
    equal = rng.random((n, c.TOKENS)) < 0.8
    for wide, want in ((wide, 0.0), (2, c.missed(0.8, runs, 2, 0))):
        pair, place = np.nonzero(equal[:, c.roots(runs).ravel()])
        seed = c.mixed(pair.astype(np.uint64) * c.STEP + place.astype(np.uint64))
        for k in range(c.DEPTH):
            row, place = np.nonzero(c.chosen(seed, 0.8, 0 if k else wide) & equal[pair])
            seed, pair = c.mixed(seed[row] * c.STEP + c.mixed(place.astype(np.uint64))), pair[row]
        assert abs(1 - len(np.unique(pair)) / n - want) < 0.01 + want / 2


def paragraphs(text):
    return {p for p in text.split("\n") if WORD.search(p)}


def test_fingerprints(spark, docs):
    from pyspark.sql import functions as F

    from veilframe.llm import iblt

    rows, df = docs
    texts = [(r[0], r[1] or "") for r in rows]
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in texts}], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]), reverse=True)
    want = []
    for k, (doc_id, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        a = paragraphs(t)
        want.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(a, paragraphs(edited)), 9), round(near(a, paragraphs(after)), 9)))
    for size, limits in ((2000, 10_000), (20, 10_000), (20, 3)):
        iblt.LIMITS = limits
        got = iblt.compare(iblt.edits(df, size)).collect()
        iblt.LIMITS = 10_000
        had = Counter((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), round(r._r.near_edited, 9), round(r._r.near_next, 9)) for r in got)
        assert had == Counter(want)
    for r in got:  # the two strings are enough
        assert abs(likeness_of(r._r.fingerprint, r._r.edited_fingerprint) - r._r.near_edited) < 1e-9
    prints = {}
    for r in got:
        assert prints.setdefault(r.text, r._r.fingerprint) == r._r.fingerprint
        assert prints.setdefault(r.edited, r._r.edited_fingerprint) == r._r.edited_fingerprint
    assert iblt.compare(iblt.edits(df.limit(0))).count() == 0
    one = iblt.compare(iblt.edits(df.limit(1))).first()
    assert one.next_text == one.text and one._r.near_next == 1.0


def peeled(fingerprint):
    """The digests of a fingerprint's document, from the string alone."""
    n, size, *cells = fingerprint.split("-")
    n, size = int(n, 16), int(size, 16)
    cells = [[int(x, 16) for x in c.split(".")] if c else [0, 0, 0] for c in cells]
    cells = [[c[0] - (1 << 64) if c[0] >> 63 else c[0], *c[1:]] for c in cells]
    assert len(cells) == 3 * size
    found, again = set(), True
    while again:
        again = False
        for c in cells:
            if c[0] == 1:
                again, (_, k, h) = True, list(c)
                found.add(k)
                for s in range(3):
                    x = cells[s * size + ((h >> 21 * s) & (size - 1))]
                    x[0], x[1], x[2] = x[0] - 1, x[1] ^ k, x[2] ^ h
    assert len(found) == n and not any(any(c) for c in cells)
    return found


def likeness_of(x, y):
    a, b = peeled(x), peeled(y)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_peeling_recovers(spark):
    from pyspark.sql import functions as F

    from veilframe.llm import iblt

    rng = random.Random(3)
    rows = []
    for k, (n, m) in enumerate([(rng.randrange(200), k + 1) for k in range(60)] + [(900, 3), (3000, 700), (0, 1500)]):
        common = [rng.getrandbits(62) for _ in range(n)]
        a, b = [rng.getrandbits(62) for _ in range(rng.randrange(m))], [rng.getrandbits(62) for _ in range(rng.randrange(m))]
        rows.append((k, common + a, common + b, a, b))
    df = spark.createDataFrame(rows, "k long, x array<bigint>, y array<bigint>, a array<bigint>, b array<bigint>").repartition(8)
    for r in iblt.differing(iblt.fingerprints(df, [F.col("x"), F.col("y")]), [(0, 1)]).collect():
        assert r._d[0].ok and r._d[0].n == len(r.a) + len(r.b)
        assert sorted((x.k, x.n) for x in r._d[0].found) == sorted([(v, 1) for v in r.a] + [(v, -1) for v in r.b])
    before, iblt.LARGEST = iblt.LARGEST, 256  # too small for some: the number is estimated
    out = iblt.differing(iblt.fingerprints(df, [F.col("x"), F.col("y")]), [(0, 1)]).collect()
    iblt.LARGEST = before
    got = [(r._d[0].ok, r._d[0].n, len(r.a) + len(r.b)) for r in out]
    assert not all(ok for ok, _, _ in got) and all(abs(n - m) <= (0 if ok else 0.25 * m) for ok, n, m in got)


def test_a_document_of_many_paragraphs(spark):
    """Exact at any size: more paragraphs than tables of 2^16 cells hold, a third of them others in the second."""
    from pyspark.sql import functions as F

    from veilframe.llm import iblt

    n, first = 200_000, 70_000
    sets = spark.range(1).select(*[F.transform(F.sequence(F.col("id") + a, F.col("id") + a + n - 1), lambda k: F.xxhash64(k)).alias(c) for c, a in (("x", 0), ("y", first))])
    r = iblt.differing(iblt.fingerprints(sets, [F.col("x"), F.col("y")]), [(0, 1)]).select(F.get("_d", F.lit(0)).alias("d"), F.get("_f", F.lit(0))["f"]["size"].alias("size"))
    r = r.select("size", "d.ok", "d.n", F.size(F.array_distinct("d.found.k")).alias("found"), F.size(F.filter("d.found", lambda x: x["n"] == 1)).alias("left")).first()
    assert tuple(r) == (1 << 18, True, 2.0 * first, 2 * first, first)


def covered(texts, length):
    """Flags by brute force: where each string of so many bytes starts."""
    at = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            at.setdefault(t[i : i + length], []).append((k, i))
    flags = [bytearray(len(t)) for t in texts]
    for places in at.values():
        if len(places) > 1:
            for k, i in places:
                flags[k][i : i + length] = b"\1" * length
    return flags


def test_suffixes(spark):
    from veilframe.llm import suffixes

    rng = random.Random(11)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    passage = "".join(rng.choice("abcdefgh \n") for _ in range(1500))
    for k in range(40):  # parts of a passage in unlike surroundings, and edits within it
        a, n = rng.randrange(1000), rng.randrange(380, 900)
        own = "".join(rng.choice("ijklmé") for _ in range(rng.randrange(600)))
        part = passage[a : a + n]
        if k % 3 == 0:
            i = rng.randrange(len(part))
            part = part[:i] + "#" + part[i + 1 :]
        rows.append((5000 + k, own[:200] + part + own[200:]))
    rows += [(6000, None), (6001, ""), (6002, "z" * 3000), (6003, "ab" * 900), (6004, passage[:399]), (6005, passage[:400]), (6006, "é" * 1000), rows[0], rows[0], (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (doc_id, _), t, f in zip(rows, texts, covered(texts, suffixes.LENGTH)):
        spans = len(re.findall(rb"\x01+", bytes(f)))
        kept = bytes(c for c, x in zip(t, f) if not x)
        want.append((doc_id, len(t), sum(f), spans, hashlib.sha256(kept).hexdigest(), sum(f) / max(1, len(t)), kept.decode("utf-8", "replace")))
    before = suffixes.RANGE, suffixes.LIMITS, suffixes.MEMORY
    for coded, ranges, limits, memory in ((256, *before), (7, 3, 20_000, 100_000), (7, 3, 3, 100_000), (7, 3, 1, 100_000)):
        suffixes.front_coded.__defaults__, suffixes.RANGE, suffixes.LIMITS, suffixes.MEMORY = (coded,), ranges, limits, memory
        got = suffixes.dedup(df, suffixes.OUT, suffixes.digest).collect()
        suffixes.front_coded.__defaults__, (suffixes.RANGE, suffixes.LIMITS, suffixes.MEMORY) = (256,), before
        assert Counter(map(tuple, got)) == Counter(want)
    assert suffixes.dedup(df.limit(0), suffixes.OUT, suffixes.digest).count() == 0


def test_merging():
    from veilframe.llm import suffixes

    rng = random.Random(2)
    for n in (1, 2, 3, 5, 9):
        lists = [sorted({bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randrange(40))}) for _ in range(n)]

        def run(x):
            before = b""
            for s in x:
                yield suffixes.shared_prefix(before, s, 0), s, s
                before = s

        out = list(suffixes.merged([run(x) for x in lists]))
        assert [s for _, s, _ in out] == sorted(s for x in lists for s in x)
        for (_, a, _), (k, b, _) in zip(out, out[1:]):
            assert k == suffixes.shared_prefix(a, b, 0)


def test_each_key_is_dealt_once():
    """Many runs: every key goes to one range in one block, and a range has as many keys as with few runs."""
    from veilframe.llm import suffixes

    rng = random.Random(4)
    key = lambda: bytes(rng.choice(b"abcdef") for _ in range(12))
    for n_runs in (20, 2000):
        keys = sorted({key() for _ in range(20_000)})
        ranges = 50
        limits = sorted(rng.sample(keys, 30 * ranges))[30::30]
        held = Counter()
        for r in range(n_runs):
            run = [(k, 0, 0, 0) for k in keys[r::n_runs]]
            parts = list(suffixes.cut(run, limits))
            assert [x for _, some in parts for x in some] == run and [p for p, _ in parts] == sorted({p for p, _ in parts})
            for p, some in parts:
                assert all((p == 0 or limits[p - 1] <= x[0]) and (p == len(limits) or x[0] < limits[p]) for x in some)
                blocks = list(suffixes.front_coded(some))
                assert sum(len(b[4]) for b in blocks) == len(some)
                held[p] += len(some)
        assert sum(held.values()) == len(keys) and max(held.values()) < 3 * len(keys) / ranges


def test_anchors_in_parts():
    import numpy as np

    from veilframe.llm import suffixes

    rng = np.random.default_rng(6)
    raw = rng.integers(97, 99, 6000).astype(np.uint8)
    raw[4000:5000] = raw[500:1500]
    at = np.array([0, 3, 10, 900, 900, 4800, 6000])

    def starts(most):
        doc, a, lo, hi, h, w = suffixes.anchors(raw, at, 40, 8, most)
        assert (w == suffixes.Hashes(raw).of(at[doc] + lo, at[doc] + hi + 40)).all()
        rows = list(zip(doc.tolist(), a.tolist(), lo.tolist(), hi.tolist(), h.tolist()))
        return sorted((d, s, x, k) for d, x, i, j, k in rows for s in range(i, j + 1))

    whole = starts(1 << 20)
    assert len(whole) == sum(max(0, n - 39) for n in np.diff(at).tolist())
    for most in (40, 41, 100, 777, 5999):
        assert starts(most) == whole
