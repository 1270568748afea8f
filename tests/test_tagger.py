"""The tagger: its chain against all labellings, its training against the plain algorithm, and what it finds of names it hasn't seen."""

import itertools
import random

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


def score(chain, words, labels):
    from veilframe.operators.tagger import _EDGE, OWN, SIDE, features

    ids = [features(w) for w in words]
    total, before = 0.0, -1
    for k, label in enumerate(labels):
        left = ids[k - 1] if k else _EDGE[0]
        right = ids[k + 1] if k + 1 < len(ids) else _EDGE[1]
        places = [*ids[k][:OWN], *left[OWN : OWN + SIDE], *right[OWN + SIDE :]]
        total += sum(chain.emit[p, label] for p in places) + chain.follow[before, label]
        before = label
    return total


def test_best_labels():
    from veilframe.operators.tagger import BUCKETS, LABELS, Chain

    rng = np.random.default_rng(3)
    chain = Chain(rng.normal(size=(BUCKETS, LABELS)), rng.normal(size=(LABELS + 1, LABELS)))
    words = ["Ann", "went", "to", "Rome", ".", "é9", "X-1"]
    sentences = [[words[k] for k in rng.integers(0, len(words), n)] for n in (4, 1, 0, 3, 5, 5, 2, 0)]
    for s, got in zip(sentences, chain.labels(sentences)):
        best = max(itertools.product(range(LABELS), repeat=len(s)), key=lambda x: score(chain, s, x))
        assert got.tolist() == list(best)
    assert chain.labels([]) == [] and [len(x) for x in chain.labels([[], []])] == [0, 0]


def test_learning_is_an_averaged_perceptron():
    from veilframe.operators.tagger import Chain

    r = random.Random(1)
    data = []
    for _ in range(40):
        words = [r.choice(["Ann", "Bo", "went", "to", "Rome"]) for _ in range(r.randrange(1, 6))]
        data.append((words, np.array([{"Ann": 1, "Bo": 1, "Rome": 3}.get(w, 0) for w in words])))
    mean = Chain().learned(data)
    total, chain = 0, Chain()
    for k in range(len(data)):  # weights after each sentence, summed up
        chain.learned(data[k : k + 1])
        total = total + chain.flat()
    assert np.allclose(mean * (len(data) + 1), total, atol=1e-9)
    assert [x.tolist() for x in Chain.of(mean).labels([["Bo", "went", "to", "Rome"]])] == [[1, 0, 0, 3]]


def test_places():
    from veilframe.operators.tagger import sentences_of, spans_of

    text = "Dr. Ann-Lee O'Hara\nmet Bo!\n\n(Rome)"
    each = sentences_of(text)
    assert [[w for w, _ in s] for s in each] == [["Dr", "."], ["Ann-Lee", "O'Hara"], ["met", "Bo", "!"], ["(", "Rome", ")"]]
    assert all(text[at:].startswith(w) for s in each for w, at in s)
    assert spans_of(each[1], np.array([1, 2])) == [("PERSON", 4, 18)] and spans_of(each[3], np.array([0, 4, 2])) == [("LOCATION", 29, 33), ("PERSON", 33, 34)]
    assert spans_of(each[1], np.array([1, 1])) == [("PERSON", 4, 11), ("PERSON", 12, 18)] and sentences_of("") == []


def test_silver_labels(spark):
    from veilframe.operators import tagger

    rows = [("person", "Ann Lee"), ("person", "Lee"), ("location", "Lee Road"), ("email_address", "met"), ("location", "York")]
    dictionary = spark.createDataFrame([(c, k, "", 1, v) for k, (c, v) in enumerate(rows)], "category string, entity_no int, id string, variant_no int, variant string")
    docs = spark.createDataFrame([("Ann Lee met Lee in Lee Road. New York, Yorkshire",), (None,), ("",), ("none here",)], "text string")
    got = {" ".join(r.tokens): r.labels for r in tagger.silver(docs, dictionary).collect()}
    assert got == {"Ann Lee met Lee in Lee Road .": [1, 2, 0, 1, 0, 3, 4, 0], "New York , Yorkshire": [0, 3, 0, 0], "none here": [0, 0]}
    assert tagger.silver(docs.limit(0), dictionary).count() == tagger.silver(docs, dictionary.limit(0)).count() == 0


def test_names_not_seen(spark, tmp_path, capsys):
    """The query's counts, with what the word list finds; and a model that is saved and loaded."""
    from veilframe.operators import detect as D
    from veilframe.operators import tagger
    from veilframe.plans import catalog

    got = {r.category: r for r in catalog.tagged_names(spark, SF).collect()}
    with capsys.disabled():
        for category, r in got.items():
            print(f"\n{category}: recall {r.n_found_right / r.n_true:.3f}, precision {r.n_found_right / r.n_found:.3f} (word list: recall {r.n_listed_right / r.n_true:.3f})", end="")
    for r in got.values():
        assert r.n_true > 100 and r.n_found_right > 0.9 * r.n_true and r.n_found_right > 0.9 * r.n_found and r.n_listed_right < 0.1 * r.n_true
    lines = catalog.named_lines(spark, "/root/testdata/sf0.001")
    names = lines.selectExpr("inline(names)").selectExpr("category", "1 AS entity_no", "'' AS id", "1 AS variant_no", "surface AS variant")
    model = tagger.trained(tagger.silver(lines, names, most=150), rounds=3, shards=2)
    model.save(spark, str(tmp_path / "tagger"))
    again = tagger.Tagger.load(spark, str(tmp_path / "tagger"))
    assert np.array_equal(model.weights, again.weights) and np.any(again.weights)
    rows = [(r.client_id, r.text) for r in lines.collect()]
    found = D.detect(spark.createDataFrame([*rows, (None, None), (-1, "")], "doc_id long, text string"), D.Registry([]).add_model(again.model())).collect()
    assert {(r.doc_id, r.start, r.end) for r in found} == {(d, b, e) for (d, _), x in zip(rows, again.spans([t for _, t in rows])) for _, b, e in x}
    assert len(found) > 100
    assert tagger.trained(lines.selectExpr("array(text) AS tokens", "array(0) AS labels").limit(0), rounds=1).spans(["Ann"]) == [[]]


def test_learning_many_together():
    """Sentences that are looked at many together, and copies at once, move the weights as one by one."""
    from veilframe.operators.tagger import _EDGE, LABELS, OWN, SIDE, Chain, features

    r = random.Random(2)
    words = [f"{a}{b}" for a in ("An", "bo", "Ka", "to") for b in ("la", "ri", "x", "nes", "Q")]
    data = []
    for _ in range(700):
        own = [r.choice(words) for _ in range(r.choice((1, 2, 3, 9)))]
        data.append((own, np.array([(1 if w[0] == "A" else 3 if w.endswith("nes") and k else 0) for k, w in enumerate(own)]), r.choice((1, 1, 1, 4))))
    first = np.round(np.random.default_rng(5).normal(size=Chain().flat().shape), 2)
    plain, total, n = Chain.of(first.copy()), 0, 1
    for own, gold, copies in data:  # one by one, the best labels of all by hand
        for _ in range(copies):
            ids = np.stack([features(w) for w in own])
            left, right = np.concatenate([_EDGE[:1], ids[:-1]])[:, OWN : OWN + SIDE], np.concatenate([ids[1:], _EDGE[1:]])[:, OWN + SIDE :]
            ids = np.concatenate([ids[:, :OWN], left, right], 1)
            guess = plain.labels([own])[0]
            wrong = guess != gold
            for label, sign in ((gold, 1.0), (guess, -1.0)):
                np.add.at(plain.emit, (ids[wrong], label[wrong, None]), sign)
                if wrong.any():
                    np.add.at(plain.follow, (np.concatenate([[LABELS], label[:-1]]), label), sign)
            total, n = total + (plain.flat() - first), n + 1
    chain = Chain.of(first.copy())
    mean = chain.learned(iter(data))
    assert np.allclose(chain.flat(), plain.flat(), atol=1e-9) and np.allclose(mean, first + total / n, atol=1e-9) and np.abs(total).max() > 100


def test_all_sentences_are_trained_on(spark):
    """More sentences than the sample that once was trained on: the weights are those of all, in one shard and, with few to a shard, by their mean."""
    from veilframe.operators import tagger

    n = 21_000
    rows = spark.range(n).selectExpr("concat_ws(' ', 'the', conv(cast(id * 7919 % 65521 AS string), 10, 20), if(id % 5 = 0, 'Lee', 'x')) AS text", "id % 5 = 0 AS named")
    dictionary = spark.createDataFrame([("person", 1, "", 1, "Lee")], "category string, entity_no int, id string, variant_no int, variant string")
    labelled = tagger.silver(rows.select("text"), dictionary)
    every = labelled.selectExpr("tokens", "labels", "xxhash64(tokens, 1) AS at", "xxhash64(tokens, 7) AS shard").collect()
    assert len(every) == n and sum(any(r.labels) for r in every) == n // 5
    every = [(r.shard, r.tokens, np.array(r.labels)) for r in sorted(every, key=lambda r: (r["at"], r.tokens))]
    one = tagger.Chain().learned((w, x) for _, w, x in every)
    assert np.allclose(tagger.trained(labelled, rounds=1, shards=1).weights, one, atol=1e-8)
    each = [tagger.Chain().learned((w, x) for k, w, x in every if k % 3 == shard) for shard in range(3)]
    assert np.allclose(tagger.trained(labelled, rounds=1, shards=1, size=n // 3).weights, np.mean(each, 0), atol=1e-8)
