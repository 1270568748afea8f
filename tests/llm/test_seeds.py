"""Repeated passages against all windows of all documents in plain Python."""

import hashlib
import random
import re

from test_rows import ODD

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, n=20):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall((text or "").encode())
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            window = tuple(w[i : i + n])
            if window in seen:
                gone[i : i + n] = [True] * n
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        edges = [k for k in range(len(w) + 1) if (gone[k] if k < len(w) else False) != (gone[k - 1] if k else False)]
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), list(zip(edges[::2], edges[1::2])), kept.decode()))
    return out


def test_passages(spark):
    from veilframe.llm import seeds

    r = random.Random(7)
    words = [f"w{k}" for k in range(300)] + ["é", "a b", "…"]
    text = lambda n, some=words: " ".join(r.choice(some) for _ in range(n))
    line, long = text(25), text(400)
    rows = [(k * 3, t) for k, t in enumerate(ODD)]
    rows += [(1000 + k, f"{text(r.randrange(40))} {line}\n{text(r.randrange(40))}") for k in range(60)]  # one line, in many contexts
    rows += [(2000 + k, long) for k in range(10)] + [(2100 + k, f"{text(k)}\t{long[: 900 + k]} {text(30)}") for k in range(10)]
    rows += [(3000 + k, text(r.randrange(5, 90), words[:2])) for k in range(60)]  # two words: nearly everything repeats, and within a text
    rows += [(3100 + k, "a " * r.randrange(15, 90)) for k in range(6)] + [(3200 + k, "a b c " * 30) for k in range(3)]
    parts = [text(r.randrange(8, 24)) for _ in range(8)]
    rows += [(4000 + k, " ".join(r.choice(parts) for _ in range(6))) for k in range(60)]  # passages next to each other in any order
    rows += [(5000, text(19)), (5001, text(20)), (-4, long), (None, line), (4_000_000_000_000, line)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, 2, "3") for x in rows], "doc_id long, text string, row int, a int, h string")
    got = [(*x[:4], [tuple(p) for p in x[4]], x[5]) for x in map(tuple, seeds.dedup(df).collect())]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    assert sum(x[2] for x in got) > 5000
    assert seeds.dedup(df.limit(0)).count() == 0 and seeds.dedup(df.where("text IS NULL")).first()[1:3] == (0, 0)


def test_equal_ids(spark):
    """Rows with equal ids are documents of their own: one of them stays."""
    from veilframe.llm import seeds

    t = " ".join(f"x{k}" for k in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (1, t), (None, t + " y"), (None, t + " y"), (2, None)], "doc_id long, text string")
    got = sorted((x[0] is not None, x[0] or 0, x[1], x[2]) for x in map(tuple, seeds.dedup(df).collect()))
    assert got == [(False, 0, 41, 0), (False, 0, 41, 41), (True, 1, 40, 40), (True, 1, 40, 40), (True, 1, 40, 40), (True, 2, 0, 0)]


def test_words_of_texts():
    """Words, and which text each is in, as a split has them; texts lie side by side without a blank between."""
    import pyarrow as pa

    from veilframe.llm import seeds

    texts = ["ab cd", "ef", "", " ", "  g\x0bh\x0c", " i j k", "k"]
    raw, begin, end, ids, at = seeds.worded(pa.array(texts))
    assert [[raw[x:y].tobytes() for x, y in zip(begin[i:j], end[i:j])] for i, j in zip(at, at[1:])] == [t.encode().split() for t in texts]
    assert ids[-1] == ids[-2] and len(set(ids.tolist())) == len(ids) - 1
    assert len(seeds.worded(pa.array([], pa.string()))[1]) == 0
    assert seeds.agreeing([b"a", b"b"], [b"a"]) == 1 and seeds.agreeing([b"a", b"b"], [b"a", b"c", b"b"]) == 1
