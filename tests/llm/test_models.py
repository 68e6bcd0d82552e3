import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from graphloom.llm import lm, quality
from graphloom.llm.text import words


def labelled(spark, docs, n=600):
    rows, marks = [], []
    for k in range(n):
        good = k % 5 != 0
        rows.append((k, f"The text number {k} reads well, with words. It ends here.\n" * 3 if good else f"BUY!! NOW$$$ {k}### CHEAP%%% WIN&&&\n" * 3))
        if k % 2 == 0:
            marks.append((k, int(good), 0))
    return docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_classifier_tells_held_out_documents_apart(spark, docs):
    given, labels = labelled(spark, docs)
    got = quality.score(given, quality.train(given, labels)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert all(r.predicted == (r.doc_id % 5 != 0) == (r.score >= 0.7) for r in held)


def test_classifier_without_labels_or_rows(spark, docs, edge_rows):
    given, none = docs(edge_rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(given, none)
    got = quality.score(given, model).collect()
    assert len(got) == len(edge_rows) and all(r.score == pytest.approx(0.5) for r in got)
    assert quality.score(given.limit(0), quality.train(given.limit(0), none)).count() == 0
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.accepted(given, quality.train(given, labels)).columns == given.columns


def test_non_negative_risk_recovers_a_mixture():
    draw = np.random.default_rng(0)
    shape = lambda n, at: np.concatenate([draw.normal(at, 1, (n, 2)), np.zeros((n, quality.FEATURES - 2))], axis=1).astype(np.float32)
    model = quality.fit(shape(500, 2), np.concatenate([shape(600, 2), shape(400, -2)]), 0.6)
    z = lambda x: ((x - model.mean) / model.scale).clip(-10, 10) @ model.weights + model.bias
    assert (z(shape(200, 2)) > 0).mean() > 0.9 and (z(shape(200, -2)) < 0).mean() > 0.9


def test_the_prior_is_found_in_unlabelled_rows():
    draw = np.random.default_rng(4)
    shape = lambda n, at: np.concatenate([draw.normal(at, 1, (n, 2)), np.zeros((n, quality.FEATURES - 2))], axis=1).astype(np.float32)
    for prior in (0.3, 0.6, 0.9):
        unlabelled = draw.permutation(np.concatenate([shape(int(4000 * prior), 2), shape(4000 - int(4000 * prior), -2)]))
        assert abs(quality.estimate_prior(shape(2000, 2), unlabelled) - prior) < 0.06
    assert quality.estimate_prior(shape(0, 2), shape(9, 2)) == 0.5


def test_risk_and_slopes_equal_brute_force():
    draw = np.random.default_rng(6)
    loss = lambda z, y: np.log(1 + np.exp(-y * z))
    for prior, shift in ((0.4, 0.0), (0.9, 3.0), (0.9, -3.0)):
        z_p, z_u = draw.normal(shift, 1, 7), draw.normal(0, 1, 5)
        by_hand = lambda p, u, prior=prior: (prior * sum(loss(z, 1) for z in p) / len(p), sum(loss(z, -1) for z in u) / len(u) - prior * sum(loss(z, -1) for z in p) / len(p))
        assert np.allclose(quality.pu_risk(z_p, z_u, prior), by_hand(z_p, z_u))
        climb = by_hand(z_p, z_u)[1] < 0
        aim = lambda p, u: -by_hand(p, u)[1] if climb else sum(by_hand(p, u))  # noqa: B023, E731
        for which, found in enumerate(quality.pu_slopes(z_p, z_u, prior)):
            for k in range(len(found)):
                up, down = [z_p.copy(), z_u.copy()], [z_p.copy(), z_u.copy()]
                up[which][k] += 1e-5
                down[which][k] -= 1e-5
                assert found[k] == pytest.approx((aim(*up) - aim(*down)) / 2e-5, abs=1e-6)


def test_repeated_ids_and_ties(spark, docs):
    given, labels = labelled(spark, docs, 200)
    again = given.unionByName(given.where("doc_id = 2")).unionByName(docs([(2, "another text of the same id"), (4, None), (None, "no id")]))
    got = quality.score(again, quality.train(again, labels)).collect()
    assert len(got) == 204 and len({r.score for r in got if r.doc_id == 2}) == 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_score_is_the_sum_of_its_tokens(spark, docs, scratch, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 50)
    rows = lm_rows()[:120]
    given = docs(rows)
    texts = given.select("doc_id", "text").where("crc32(cast(doc_id as string)) % 7 <> 2")
    counts = scratch.keep(lm.count_words(texts), "counts")
    lex, count = lm.lexicon(counts).ready(), {bytes(r.word): r.n for r in counts.collect()}
    params = lm.train(texts, lm.lexicon(counts), scratch)
    monkeypatch.setattr(lm, "train", lambda *_: params)
    of = {w: lex.class_of(w) for w in {w for _, t in rows for w in words(t.encode())} | {b""}}
    tokens, types = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    for w, n in count.items():
        tokens[of.get(w, lex.class_of(w))] += n
        types[of.get(w, lex.class_of(w))] += 1
    for r in lm.score(given).collect():
        sequence, total = [*words(dict(rows)[r.doc_id].encode()), b""], 0.0
        for k, word in enumerate(sequence):
            context = [of[sequence[j]] if j >= 0 else of[b""] for j in range(k - lm.CONTEXT, k)]
            c = of[word]
            total += lm.log_probabilities(params, np.array([context]))[0, c] / np.log(10)
            if c >= lm.HEAD:
                total += log10((count.get(word, 0) + 1) / (tokens[c] + types[c] + 1))
        assert r.score == pytest.approx(total, abs=1e-3)


def test_features_of_long_texts_don_t_depend_on_steps(monkeypatch):
    text = ("Some words, 123!\n" * 300).encode()
    whole = quality.features([text, None, b""])
    monkeypatch.setattr(quality, "STEP", 100)
    assert np.allclose(quality.features([text, None, b""]), whole) and not whole[1:].any()


def lm_rows():
    draw = np.random.default_rng(2)
    sides = [[f"le{k}" for k in range(40)], [f"the{k}" for k in range(40)]]
    return [(k, " ".join(draw.choice(sides[k % 2], 60))) for k in range(300)]


def test_base_score_and_counts_equal_brute_force(spark, docs, edge_rows, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 30)
    rows = [*lm_rows(), *((None if k is None else k + 1000, t) for k, t in edge_rows)]
    got = lm.score(docs(rows)).collect()
    out = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    tokens = lambda t: [*words(t.encode() if t else None), b""]
    counts = Counter(w for k, t in rows if not out(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if k is None else k, out(k), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_model_beats_the_base_on_held_out_texts(spark, docs):
    got = [r for r in lm.score(docs(lm_rows())).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_scores_don_t_depend_on_the_split(spark, docs, edge_rows, monkeypatch):
    monkeypatch.setattr(lm, "LEAST", 2000)
    given = docs([*lm_rows(), *edge_rows, *[(11, "the one and only")] * 40])
    scores = lambda n: sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in lm.score(given.repartition(n)).collect())
    assert np.allclose(scores(1), scores(5), rtol=1e-5)


def test_shards_follow_the_tokens():
    assert [lm.shards(n) for n in (0, 1, 1 << 20, 1 << 24, 1 << 30, 1 << 40)] == [1, 1, 2, 32, 64, 1 << 16]


def test_a_weight_counts_like_repeated_tokens(spark, docs, scratch):
    lex = lm.lexicon(scratch.keep(lm.count_words(docs(lm_rows())), "counts")).ready()
    draw = np.random.default_rng(5)
    context, target = draw.integers(0, lm.CLASSES, (20, lm.CONTEXT)), draw.integers(0, lm.CLASSES, 20)
    times = draw.integers(1, 4, 20)
    one, many = (lm.Trainer(lm.start(lex), lex, 3) for _ in range(2))
    one.step(context, target, times.astype(np.float32))
    many.step(np.repeat(context, times, axis=0), np.repeat(target, times), np.ones(times.sum(), np.float32))
    assert all(np.allclose(one.p[k], many.p[k], atol=1e-3) for k in one.p)


def test_class_probabilities_are_normalised(spark, docs, scratch):
    given = docs(lm_rows())
    lex = lm.lexicon(scratch.keep(lm.count_words(given), "counts"))
    params = lm.train(given, lex, scratch)
    context = np.random.default_rng(1).integers(0, lm.CLASSES, (50, lm.CONTEXT))
    table = lm.log_probabilities(params, context)
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-4)
    target = np.arange(50) % lm.CLASSES
    assert np.allclose(lm.class_scores(params, context, target), table[np.arange(50), target] / np.log(10), atol=1e-5)


def test_language_model_of_an_empty_table(spark, docs):
    assert lm.score(docs([])).count() == 0
