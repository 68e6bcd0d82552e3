import random
import re

import numpy as np
import pytest

from graphloom.llm import minhash
from graphloom.llm.text import shingle_set, word_hashes, words


def brute(rows, per, cent):
    sets = {k: set_by_hand(t) for k, t in rows}
    low = {k: k for k in sets}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                inter = len(sets[a] & sets[b])
                if cent * inter >= per * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    low[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def corpus(seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, key = [], 0
    for size in (3, 5, 8, 60, 150):
        base = [draw.choice(vocabulary) for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 2, 3, 3, 4, 6):
            text = list(base)
            for _ in range(edits):
                text[draw.randrange(size)] = draw.choice(vocabulary)
            rows.append((key, " ".join(text)))
            key += 1
    hot = [draw.choice(vocabulary) for _ in range(140)]
    for _ in range(150):
        text = list(hot)
        for _ in range(draw.randrange(9)):
            text[draw.randrange(140)] = draw.choice(vocabulary)
        rows.append((key, " ".join(text)))
        key += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("per", [85, 80])
def test_components_equal_brute_force(spark, docs, per):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows), per, 100).collect()}
    assert got == brute(rows, per, 100)


def test_edge_cases(spark, docs, edge_rows):
    got = minhash.near_duplicates(docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    by = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (None, 2, 5, False), (5, 2, 5, True)} <= by
    assert minhash.near_duplicates(docs([])).count() == 0


def test_dedup_keeps_one_row_and_all_columns(spark, docs, edge_rows):
    got = minhash.dedup(docs([*edge_rows, (9, "one two three four five six")]))
    assert got.columns == ["doc_id", "text", "node", "label"]
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8]


def test_rows_are_judged_by_their_own_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    c = " ".join(f"c{k}" for k in range(30))
    rows = [(3, b), (5, a), (5, b), (None, b), (5, c), (5, c), (7, c + " c30"), (8, None), (8, None)]
    given = spark.createDataFrame([(k, t, n, "x", "y") for n, (k, t) in enumerate(rows)], "doc_id long, text string, _row int, row_key string, label string")
    got = minhash.dedup(given)
    assert got.columns == given.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted([(3, b), (5, a), (-1, b), (5, c), (8, "")])
    found = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(given).collect())
    assert found == sorted([(3, 3, True), (5, 5, True), (5, 3, False), (-1, 3, False), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (8, 8, True)])


def set_by_hand(text):
    """Shingles as strings, from the definition alone."""
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def test_hashed_sets_equal_those_by_hand(edge_rows):
    texts = [t for _, t in [*edge_rows, *corpus()]]
    hashed = [set(shingle_set(t.encode() if t else None).tolist()) for t in texts]
    by_hand = [set_by_hand(t) for t in texts]
    assert [len(s) for s in hashed] == [len(s) for s in by_hand]
    for k in range(0, len(texts), 7):
        assert [len(hashed[k] & s) for s in hashed] == [len(by_hand[k] & s) for s in by_hand]


def test_sketches_fill_and_estimate():
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 2**63, 4000).astype(np.uint64)
    a, b, one = pool[:1000], pool[200:1200], pool[:1]
    owner = np.repeat([0, 1, 2], [1000, 1000, 1])
    marks = minhash.sketch(np.concatenate([a, b, one]), owner, 3, 512)
    assert (marks != np.uint64(2**64 - 1)).all()
    assert abs((marks[0] == marks[1]).mean() - 800 / 1200) < 0.08
    alone = minhash.sketch(b, np.zeros(1000, np.int64), 1, 512)
    assert (alone[0] == marks[1]).all()


def test_words_and_pieces(monkeypatch):
    text = "Ab C\x0bd  É\n"
    assert words(text.encode()) == ["ab c".encode(), b"d", "É".encode()]
    import graphloom.llm.text as t

    data = b"some words " * 500
    whole = word_hashes(data)
    monkeypatch.setattr(t, "PIECE", 64)
    assert (word_hashes(data) == whole).all()
