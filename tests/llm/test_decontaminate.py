import random

import numpy as np

from graphloom.llm import decontaminate


def planted(seed=5):
    draw = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(k, some(n)) for k, n in enumerate((20, 40, 60, 5, 1))]
    rows, want = [], set()
    for k in range(60):
        text = some(80)
        if k % 3 == 0:
            item, own = items[k // 3 % 4]
            own = list(own)
            if len(own) > 15:
                for at in range(6, len(own), 9):
                    own[at] = "changed"
            text[30:30] = own
            want.add((k, item))
        rows.append((k, " ".join(text).upper() if k % 2 else " ".join(text)))
    return rows, [(k, " ".join(w)) for k, w in items], want


def table(spark, items):
    return spark.createDataFrame([(k, t, "y") for k, t in items], "item_id long, text string, doc_id string")


def test_planted_passages_with_substitutions(spark, docs):
    rows, items, want = planted()
    items = [x for x in items if x[0] != 4]
    got = decontaminate.find_overlaps(docs(rows), table(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {r.doc_start for r in got} == {30} and all(r.n_equal >= 0.8 * r.n_tokens for r in got)


def test_blocks_equal_one_pass(spark, docs, monkeypatch):
    rows, items, want = planted()
    once = sorted(map(tuple, decontaminate.find_overlaps(docs(rows), table(spark, items)).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, decontaminate.find_overlaps(docs(rows), table(spark, items)).collect())) == once


def test_exact_hits_equal_brute_force(spark, docs):
    rows, items, _ = planted(9)
    seeds = decontaminate.Seeds([(k, t.encode()) for k, t in items])
    for k, text in rows:
        found = {(r[1]) for r in decontaminate.overlaps(seeds, [k], [text.encode()])}
        own = f" {text.lower()} "
        assert {i for i, t in items if f" {t} " in own} <= found


def test_edge_cases(spark, docs, edge_rows):
    items = table(spark, [(1, None), (2, ""), (None, "one"), (3, "one two three four five six"), (4, "a b a b a b a b a b a b a b")])
    got = decontaminate.find_overlaps(docs(edge_rows), items)
    assert sorted((r.doc_id or -1, r.item_id) for r in got.collect()) == [(-1, 3), (5, 3), (5, 3), (8, 4)]
    left = decontaminate.decontaminate(docs(edge_rows), items)
    assert left.columns == ["doc_id", "text", "node", "label"]
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 7]
    assert decontaminate.find_overlaps(docs([]), items).count() == 0
    assert decontaminate.find_overlaps(docs(edge_rows), items.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark, docs, monkeypatch):
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(5, passage), (5, "a clean text"), (5, "a clean text"), (6, "other"), (None, passage), (None, "clean too")]
    want = [(str(k), t) for k, t in rows if t != passage]
    for size in (decontaminate.BLOCK_BYTES, 50):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        left = decontaminate.decontaminate(docs(rows), table(spark, [(1, passage), (2, "nothing like it"), (3, passage + " more")]))
        assert left.columns == docs(rows).columns
        assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted(want)


def brute_force(same, least):
    """The most equal tokens of any stretch that the rule accepts, 0 if none."""
    total = np.concatenate([[0], np.cumsum(same)])
    each = [int(total[e] - total[s]) for s in range(len(same)) for e in range(s + 1, len(same) + 1) if 5 * (total[e] - total[s]) >= 4 * (e - s)]
    return max([x for x in each if x >= least], default=0)


def test_best_stretch_equals_brute_force():
    draw = np.random.default_rng(3)
    for k in range(400):
        n, noise = int(draw.integers(1, 90)), draw.choice([0.1, 0.2, 0.25, 0.3, 0.5])
        item = np.arange(1, n + 1).astype(np.uint64)
        same = draw.random(n) >= noise
        doc = np.concatenate([np.zeros(k % 3, np.uint64), np.where(same, item, np.uint64(0))])
        found, want = decontaminate.best_overlap(doc, item, k % 3), brute_force(same, min(12, n))
        assert (found[3] if found else 0) == want
        if found:
            own = same[found[1] : found[1] + found[2]]
            assert found[0] == found[1] + k % 3 and own.sum() == found[3] and own[0] and own[-1] and 5 * found[3] >= 4 * found[2]


def test_verbatim_part_before_a_similar_rest(spark, docs):
    words = [f"w{k}" for k in range(130)]
    text = words[:30] + [f"x{k}" if k % 10 in (2, 5, 8) else words[k] for k in range(30, 130)]
    got = decontaminate.find_overlaps(docs([(1, " ".join(text))]), table(spark, [(7, " ".join(words))])).collect()
    assert [(r.doc_id, r.item_id, r.doc_start, r.item_start) for r in got] == [(1, 7, 0, 0)] and got[0].n_equal >= 30


def test_no_accepted_overlap_is_without_a_hit():
    """The least substitutions that leave no hit, by length; as its parts add up, 45 tokens prove it for all lengths."""
    span = max(map(len, decontaminate.MASKS))
    masks = [int(m, 2) for m in decontaminate.MASKS]
    least = {0: 0}
    for n in range(1, 61):
        new = {}
        for last, count in least.items():
            for same in (0, 1):
                seen = last << 1 | same
                if not any(seen & m == m for m in masks):
                    key = seen & ((1 << (span - 1)) - 1)
                    new[key] = min(new.get(key, n), count + 1 - same)
        least = new
        if n >= decontaminate.MIN_EQUAL:
            assert min(least.values()) > min(n - decontaminate.MIN_EQUAL, n // 5), n


def test_overlaps_equal_brute_force_on_substituted_passages(monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS", 16)
    draw = random.Random(8)
    vocabulary = [f"v{k}" for k in range(500)]
    items = [(k, [draw.choice(vocabulary) for _ in range(draw.randint(1, 60))]) for k in range(25)]
    items.append((25, ["again"] * 30))
    seeds = decontaminate.Seeds([(k, " ".join(w).encode()) for k, w in items])
    for doc in range(150):
        own = [draw.choice(vocabulary) for _ in range(60)]
        _, passage = draw.choice(items)
        noisy = [w if draw.random() > 0.2 else "changed" for w in passage]
        own[20:20] = noisy
        want = set()
        for k, words in items:
            least = min(decontaminate.MIN_EQUAL, len(words))
            for shift in range(-len(words), len(own)):
                same = np.array([0 <= j + shift < len(own) and own[j + shift] == w for j, w in enumerate(words)])
                if same.sum() >= least and brute_force(same, least):
                    want.add((k, max(brute_force(same, least), dict(want).get(k, 0))))
        best = {k: max(n for j, n in want if j == k) for k, _ in want}
        assert {r[1]: r[5] for r in decontaminate.overlaps(seeds, [doc], [" ".join(own).encode()])} == best
