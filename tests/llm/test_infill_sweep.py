"""Fill in the middle and the sweep over open intervals, against plain Python."""

import hashlib
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from test_rows import ODD

MORE = ["a<P>b c", "x <S>", "<M>", "<", "<S", "ab<", "<<P", "zz <P", "word " * 3000, "ab1" * 20_000, "é" * 40_000, "a" * 70_000, "Ab cdéef " * 9_000]


def filled(doc_id, text):
    text = text or ""
    t = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(t), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    p, m = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(t[:p]), "".join(t[p:m]), "".join(t[m:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", text, None, None
    return (doc_id, n, "spm", f"<S>{c}<P>{a}<M>{b}", a, b) if h[3] % 100 < 20 else (doc_id, n, "psm", f"<P>{a}<S>{c}<M>{b}", a, b)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 7, "dealt": 20}, {"chunk": 3, "dealt": 1 << 30}, {"chunk": 1, "dealt": -1}])
def test_fill_in_middle(spark, sizes):
    from veilframe.llm import infill

    texts = [*ODD, *MORE] if sizes.get("chunk", 9) > 7 else [*[x for x in ODD if len(x or "") < 3000], *MORE[:8], "Ab cdéef " * 9]
    rows = [(k, t, 3, "x", "y") for k, t in enumerate(texts * 3)] + [(5, "twice ab", 0, "", ""), (5, "twice ab", 0, "", ""), (5, "other cd", 0, "", ""), (None, "no id", 0, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, form string, p string")
    got = infill.fill_in_middle(df, **sizes)
    want = [filled(r[0], r[1]) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    back = got.select("doc_id", infill.restored(got.output, got.form).alias("t")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((r[0], r[1] or "")) for r in rows)
    assert infill.fill_in_middle(df.limit(0), **sizes).count() == 0


def swept(intervals):
    """Row by row, by group."""
    changes = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for grp, begin, stop, weight in intervals:
        if begin is None or (stop is not None and stop <= begin):
            continue
        for g in (grp, -2):
            for at, sign in ((begin, 1), (stop, -1)):
                if at is not None:
                    changes[g][at][0] += sign
                    changes[g][at][1] += sign * weight
    out = []
    for g, moments in changes.items():
        kept = sorted((t, *x) for t, x in moments.items() if x != [0, 0])
        n = weight = 0
        rows = []
        for k, (t, dn, dw) in enumerate(kept):
            n, weight = n + dn, weight + dw
            rows.append([g, t, kept[k + 1][0] if k + 1 < len(kept) else None, n, weight, max([n, *[r[3] for r in rows]])])
        out += [(*r, r[4] == max(x[4] for x in rows)) for r in rows]
    return out


@pytest.mark.parametrize("flush", [1 << 19, 40])
def test_concurrency(spark, monkeypatch, flush):
    from veilframe.llm import sweep

    monkeypatch.setattr(sweep, "FLUSH", flush)
    r = random.Random(3)
    rows = []
    for _ in range(600):
        begin = r.choice([r.randrange(-5000, 5000), r.randrange(0, 20), 28_000_000, None if r.random() < 0.2 else 0])
        stop = r.choice([None, begin, (begin or 0) + r.randrange(1, 9000), (begin or 0) - 5, 20])
        rows.append((r.choice([-1, 3, 3, 3, 7]), begin, stop, r.choice([0, 1, 10**15, -(1 << 40), r.randrange(10**6)])))
    rows += [(9, 5, 10, 100), (9, 10, 15, 100), (9, 10, 15, 0), (9, 10, 15, 0)] + [(11, 0, 1440, 5), (11, 1440, 2880, 5), (11, 4320, None, 1)]
    df = spark.createDataFrame(rows, "grp int, begin long, stop long, weight long").repartition(5)
    assert sorted(map(repr, map(tuple, sweep.concurrency(df).collect()))) == sorted(map(repr, swept(rows)))
    assert sweep.concurrency(df.limit(0)).count() == 0


def test_open_sales(spark):
    from veilframe.llm import sweep

    t = datetime(2024, 3, 10, 1, 59, 59, 999_999)
    sales = [(k, k % 4 if k % 5 else None, [1.005, None, 0.0, 2.675, -3.0][k % 5], t + timedelta(minutes=k) if k % 7 else None, "x") for k in range(60)]
    sales += [sales[8], (None, 1, 1.0, t, "x"), (400, 99, 1.0, datetime(1969, 12, 31, 23, 59, 30), "x")]
    lines = [(k, None if k % 3 == 0 else t + timedelta(days=k % 2 * 3 - 8, seconds=k * 61), 0) for k in range(60)] + [(None, t, 0), (1, t, 0), (1, t - timedelta(days=1), 0), (77, t, 0)]
    clients = [(0, 5, 1), (1, None, 1), (2, 8, 1), (2, 8, 1), (None, 4, 1)]
    s = spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz, begin string")
    ln = spark.createDataFrame(lines, "sale_id long, shipped_at timestamp_ntz, stop int")
    c = spark.createDataFrame(clients, "client_id long, nation_id int, grp int")
    minute = lambda x: (x - datetime(1970, 1, 1)) // timedelta(minutes=1)
    first, home = {}, {0: 5, 1: -1, 2: 8}
    for sale, at, _ in lines:
        if sale is not None and at is not None:
            first[sale] = min(at, first.get(sale, at))
    want = []
    for sale, client, amount, at, _ in sales:
        if at is not None:
            stop = minute(first[sale]) + 7 * 1440 if sale in first else None
            if stop is None or stop > minute(at):
                want.append((home.get(client, -1), minute(at), stop, int((100 * (amount or 0) + 0.5) // 1)))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session in ("UTC", "America/New_York"):  # clocks go forward on that day there
            spark.conf.set("spark.sql.session.timeZone", session)
            assert sorted(map(repr, map(tuple, sweep.open_sales(s, ln, c).collect()))) == sorted(map(repr, want))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(sweep.concurrency(sweep.open_sales(s, ln, c)).collect()) == len(swept(want))
    for empty in ((s.limit(0), ln, c), (s, ln.limit(0), c.limit(0))):
        sweep.concurrency(sweep.open_sales(*empty)).collect()
