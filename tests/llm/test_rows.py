"""Operators whose rows don't meet, against brute force in plain Python."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kind string"
ODD = [
    None, "", " ", "\n\n\n", "a", "the cat sat on the mat " * 40, "é" * 3000, "1" * 30000, "1 " * 20000, "a@b.c_d@e.f.@g.h x@y", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (743) 555-3824 +12 +123456789", "x" * 50000 + "@", "a@" + "b." * 20000 + "c", "tab\there\r\nand  two\u00a0spaces \n end ", "same line\nsame line\n\nsame line\n",
    "<|endoftext|> </s>[INST] ok", "GB82WEST12345698765432 GB82WEST12345698765433 ssn 123-45-6789, 123-45-6780", "\U0001f600 smile\u2028x\x1c\x85y   z", "\\- \\\\ <s><s>",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "clash", "clash") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + k, t, None if k % 3 == 0 else "en", None, None, None, "x") for k, t in enumerate(ODD)]
    rows += [rows[0], rows[0], (None, "null id", None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS)


def same(got, want):
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    import public_tokenizers
    from veilframe.llm import rans

    rows, df = docs
    more = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n<|endoftext|> y", "end. it's. we'll, ... don't!) (a)... \u0130. \u0250; 3. 4,5", "no\u2028. \u00aa, \u4e2d. a.b.c. 'tis' 's. x's."]
    rows = [*rows, *[(20_000 + k, t, *[None] * 5) for k, t in enumerate(more)]]
    df = spark.createDataFrame(rows, DOCS)
    path = public_tokenizers.path("byte_bpe_50k.json")
    for plain in (False, True):
        tok = Tokenizer.from_file(path)
        if plain:
            tok.encode_special_tokens = True
        want, start = [], 0
        for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
            want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
            start += len(ids)
        coded, tables = rans.encode(df, path, plain=plain)
        assert [tuple(r) for r in rans.checksums(coded, tables).orderBy("start").collect()] == want
        assert [len(r.ids) // 4 for r in rans.decode(coded, tables).orderBy("start").collect()] == [w[2] for w in want]
    coded, tables = rans.encode(df.limit(0), path)
    assert rans.checksums(coded, tables).count() == 0


def test_rans_table_file(spark, tmp_path):
    import numpy as np

    from veilframe.llm import rans

    ids = np.random.default_rng(2).integers(0, 300, 5000).astype(np.uint16)
    for some in (ids, ids[:0]):
        t = rans.Tables(*np.unique(some, return_counts=True))
        data = rans.encode_block(some, t, lanes=16, steps=64)
        path = rans.write_tables(spark, t)  # blocks and this file are all that a reader has
        del t
        assert (rans.decode_block(data, rans.read_tables(path)) == some).all()
    t = rans.Tables(*np.unique(ids, return_counts=True))
    data = rans.encode_block(ids, t, lanes=16, steps=64)
    with pytest.raises(ValueError):
        rans.decode_block(data, rans.Tables(*np.unique(ids[:900], return_counts=True)))
    with pytest.raises(ValueError):
        rans.Tables.unpacked(t.packed()[:-1] + b"x")


def test_blocks():
    import numpy as np

    from veilframe.llm import rans

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 1000, 300_000):
        ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint32)
        t = rans.Tables(*np.unique(ids, return_counts=True))
        data = rans.encode_block(ids, t, lanes=128, steps=64)
        assert (rans.decode_block(data, t) == ids).all()
        if n > 200_000:
            part = 64 * 128
            assert (rans.decode_block(data, t, 3, 5) == ids[3 * part : 5 * part]).all()
            share = np.bincount(ids)[ids] / n
            assert len(data) * 8 < -np.log2(share).sum() * 1.02 + 8 * len(data) * 0.12
            with pytest.raises(ValueError):
                rans.decode_block(data[:-3] + b"abc", t)


def brute_paths(model, text, n):
    """Every segmentation of a short text, the n best."""
    best = [[] for _ in range(len(text) + 1)]
    best[0] = [(0.0, ())]
    for j in range(1, len(text) + 1):
        for i in range(j):
            p = text[i:j]
            if p in model.pieces:
                best[j] += [(s + model.pieces[p][0], (*x, model.pieces[p][1])) for s, x in best[i]]
            elif j == i + 1:
                best[j] += [(s + model.unknown, (*x, *[model.bytes[b] for b in p.encode()])) for s, x in best[i]]
        best[j] = sorted(best[j], key=lambda x: -x[0])[: 4 * n]
    return best[-1][:n]


def test_pieces(spark, docs):
    import numpy as np

    import public_tokenizers
    from veilframe.llm import pieces

    rows, df = docs
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = pieces.Model.of(path, 3)
    for text in ["a", " ", "the cat", "  two  spaces ", "néw\nline\n", "\U0001f600x", "aaaa bbbb", "internationalization of the,,, \t", "a" * 50, "ab" * 30 + "\u4e2d" * 3]:
        want = brute_paths(model, pieces.SPACE + text.replace(" ", pieces.SPACE), 3)
        got = model.segment(text)
        assert [s for s, _ in got] == [s for s, _ in want], text
        assert len({x for _, x in got}) == len(got)
        for s, x in got:
            assert model.decode([x])[0].decode() == text
        if len(want) > 1 and want[0][0] > want[1][0]:
            assert np.frombuffer(got[0][1], "<u4").tolist() == list(want[0][1])
    # scores add up to sense: most words come out as the library's own segmentation has them, in no more pieces on the whole
    from sentencepiece import SentencePieceProcessor

    sp, words = SentencePieceProcessor(model_file=path), Counter(w for r in rows for w in WORD.findall(r[1] or "")[:2000] if len(w) < 40)
    ours = {w: np.frombuffer(model.segment(w)[0][1], "<u4").tolist() for w in words}
    theirs = {w: sp.encode(w) for w in words}
    equal = sum(n for w, n in words.items() if ours[w] == theirs[w]) / words.total()
    assert equal > 0.75 and sum(n * len(ours[w]) for w, n in words.items()) <= 1.02 * sum(n * len(theirs[w]) for w, n in words.items()), equal
    assert abs(sum(math.exp(s) for s, _ in model.pieces.values()) - 1) < 1e-6
    got = pieces.digests(df, path).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert all(list(r.n_best_scores) == sorted(r.n_best_scores, reverse=True) for r in got)
    texts = pieces.decode(pieces.encode(df, path), path).collect()
    same([(r.doc_id, r.text) for r in texts], [(r[0], r[1] or "") for r in rows])


def test_chats(spark):
    from veilframe.llm import chat

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(-5, t, "user" if t % 2 == 0 else "assistant", f"turn {t} <s>[INST]") for t in range(300)]
    rows += [(-6, 0, "user", None), (-6, 0, "user", None), (-6, None, "tool", "x [/ROLE] y"), (-6, 5, None, "\\"), (None, 1, "assistant", "</s>"), (-7, 0, "user", "<\\-s> \\-[INST][/INST]<<SYS>>"), (-8, 1, "user", " [/INST"), (-8, 2, "assistant", "x </s"), (-8, 3, "user", "[AS] [ROLE] a [AS] b"), (-8, 4, "[AS] x\\", " [/ROLE"), (-(1 << 63), 0, "user", "least id")]
    rows += [(-9, None, "user" if k % 2 else "assistant", f"{k}") for k in range(150)] + [(-10, 3, "user", f"{k}") for k in range(130)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    want = []
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    chunks = chat.format_chats(df)
    same([tuple(r)[:5] for r in chat.read_back(chunks).collect()], want)
    bad = {r.conv_id: r.n_invalid for r in chat.read_back(chunks).collect()}
    assert bad[-5] == 0 and bad[None] == 1 and bad[-6] == 3 and bad[-10] == 129
    assert all(r.n_turns <= chat.TURNS for r in chunks.collect())
    for r in chunks.collect():
        for part in r.segments:
            assert not part.loss or not any(c in part.text for c in chat.CONTROLS)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def quality_base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def char_classes(text):
    """Lower case, upper case, white space, digits, sentence marks, other."""
    import unicodedata

    out = [0] * 6
    for c in text:
        kind = unicodedata.category(c)
        out[0 if kind == "Ll" else 1 if kind == "Lu" else 2 if c in " \t\n\x0b\x0c\r" else 3 if c in "0123456789" else 4 if c in ".,;:!?'\"()-" else 5] += 1
    return out


def common_words(text, common):
    seen = Counter(WORD.findall(text))
    return [*(seen[w] for w in common), sum(seen.values()) - sum(seen[w] for w in common)] if common else []


def divergence(p, q):
    """Jensen-Shannon distance to base 2."""
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
    return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))


def test_quality(spark, docs):
    from veilframe.llm import quality

    rows, df = docs
    got = quality.judge(df).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(r[0], *quality_base(r[1] or "")) for r in rows])
    assert all(not (r.base_failed and r.kept) for r in got)
    # references, distances and verdicts by the plain definition
    counts = [(r[2], *quality_base(r[1] or ""), char_classes(r[1] or ""), common_words(r[1] or "", quality.COMMON.get(r[2]))) for r in rows]
    fit = [c for c in counts if not c[6] and c[1] >= quality.LEAST_WORDS and sum(c[7]) >= quality.LEAST_CHARS]
    every = list(map(sum, zip(*[c[7] for c in fit])))
    refs = {}
    for lang in {c[0] for c in counts}:
        own = [c for c in fit if c[0] == lang]
        refs[lang] = (list(map(sum, zip(*[c[7] for c in own]))), list(map(sum, zip(*[c[8] for c in own])))) if len(own) >= quality.LEAST_DOCS else (every, None)
    assert {r[1] is None for r in refs.values()} == {True, False}
    want = []
    for r, c in zip(rows, counts):
        a = divergence(c[7], refs[c[0]][0]) if sum(c[7]) >= quality.LEAST_CHARS else None
        b = divergence(c[8], refs[c[0]][1]) if c[1] >= quality.LEAST_WORDS and c[8] and refs[c[0]][1] else None
        want.append((r[0], *[None if x is None else round(x, 6) + 0.0 for x in (a, b)], not c[6] and (a or 0) <= quality.FAR_CLASSES and (b or 0) <= quality.FAR_WORDS))
    same([(r.doc_id, *[None if x is None else round(x, 6) + 0.0 for x in (r.class_distance, r.word_distance)], r.kept) for r in got], want)
    assert {w[3] for w in want} == {True, False} and any(not w[3] and not c[6] for w, c in zip(want, counts))
    assert all(len(r.classes) == 6 and sum(r.classes) == len(dict((x[0], x[1]) for x in rows)[r.doc_id] or "") for r in got)
    kept = quality.keep(df)
    assert kept.columns == df.columns
    same([r.doc_id for r in kept.collect()], [r.doc_id for r in got if r.kept])
    assert quality.judge(df.limit(0)).count() == 0


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def emails(text):
    """Leftmost matches without overlaps: before each @ as many characters as may stand there, back to the match before."""
    out, last = [], 0
    for at in (k for k, c in enumerate(text) if c == "@"):
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            last = m.end()
    return out


def pii_base(text):
    out = [("email", *x) for x in emails(text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def pii_more(text):
    """The added kinds, by plain rules: what a code says, its check, and a context word within 40 characters before it."""
    out, near = [], lambda m, words: bool(re.search(r"(?<![a-z])(?:" + "|".join(words) + ")", text[max(0, m.start() - 40) : m.start()].lower()))
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", text):
        if int("".join(str(int(c, 36)) for c in m[0][4:] + m[0][:4])) % 97 == 1:
            out.append(("iban", m.start(), m.end()))
    for kind, pattern, words in (("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ("ssn", "social", "security")), ("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])", ("token", "key", "secret", "password"))):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if near(m, words)]
    return out


def test_pii(spark, docs):
    from veilframe.llm import pii

    rows, df = docs
    rng = random.Random(9)
    made = ["GB82WEST12345698765432", "GB82WEST12345698765433", "DE89370400440532013000", "FR1420041010050500013M02606", "123-45-6789", "0123456789abcdef" * 2, "f" * 64, "a" * 31, "my token", "SSN", "the key", "monkey", "Passwords", "social security no", "x" * 45, "iban", "\u0130", "a@b.c", "1.2.3.4", "+45 12 34 56 78 90", "4111 1111 1111 1111", "\n", "."]
    rows = [*rows, *[(60_000 + k, rng.choice([" ", "", ": "]).join(rng.choice(made) for _ in range(rng.randrange(1, 14))), *[None] * 5) for k in range(400)]]
    rows.append((61_000, "key 0123456789abcdef0123456789abcdef a@b.cd " * 5000, *[None] * 5))
    df = spark.createDataFrame(rows, DOCS)
    listed = lambda found: ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    want = [(r[0], listed(pii_base(r[1] or "")), listed(pii_base(r[1] or "") + pii_more(r[1] or ""))) for r in rows]
    found = pii.find(df).collect()
    same([(r.doc_id, listed((x.kind, x.s, x.e) for x in r.found if x.kind in pii.BASE), listed((x.kind, x.s, x.e) for x in r.found)) for r in found], want)
    assert sum(w[1] != w[2] for w in want) > 100
    more = {r.doc_id: [(x.kind, x.s) for x in r.found if x.kind not in pii.BASE] for r in found}
    assert more[10_000 + 17] == [("iban", 0), ("ssn", 50), ("ssn", 63)]
    out = pii.mask(df)
    assert out.columns == df.columns
    masked = {r.doc_id: r.text for r in out.collect()}
    for r, (doc_id, text, *_) in zip(found, rows):  # rows come in their order
        assert r.doc_id == doc_id
        at, parts = 0, []
        for s, e, kind in sorted((x.s, -x.e, x.kind) for x in r.found):
            if s >= at:
                parts += [(text or "")[at:s], f"[{kind.upper()}]"]
            at = max(at, -e)
        if doc_id is not None and doc_id >= 10_000:
            assert masked[doc_id] == (None if text is None else "".join(parts) + text[at:])
    assert masked[10_000] is None and masked[10_001] == ""
    assert masked[10_011] == "[CARD] and 4111-1111-1111-1112, [PHONE] +12 [PHONE]"
    assert pii.find(df.limit(0)).count() == 0


def test_time_of_many_spans(spark):
    """A text with eight times the addresses takes about eight times as long, and not sixty-four."""
    import time

    from pyspark.sql import functions as F

    from veilframe.llm import pii

    took = {}
    for n in (10, 4000, 32_000):
        df = spark.createDataFrame([(1, "write to someone@example.com or call, " * n)], "doc_id long, text string")
        began = time.time()
        assert pii.mask(df).select(F.length("text")).first()[0] == len("write to [EMAIL] or call, ") * n
        took[n] = time.time() - began
    assert took[32_000] - took[10] < 20 * max(1.0, took[4000] - took[10])


def test_luhn_and_mod97(spark):
    from pyspark.sql import functions as F

    from veilframe.llm import pii

    r = spark.range(1).select(pii.luhn(F.lit("4111111111111111")), pii.luhn(F.lit("4111111111111112")), pii.mod97(F.lit("GB82WEST12345698765432")), pii.mod97(F.lit("GB82WEST12345698765433")), pii.octets(F.lit("1.02.255.000000")), pii.octets(F.lit("1.2.3.256")), pii.octets(F.lit("1.2.3.99999999999999999999"))).first()
    assert list(r) == [True, False, True, False, True, False, False]
