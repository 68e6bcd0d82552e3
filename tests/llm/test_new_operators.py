"""Personal data, periodic runs and importance resampling against brute force."""

import math
import random
import re
import zlib
from hashlib import sha256

import pytest

from graphloom.llm import pii, resample, runs

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
ODD = ["a@b.c@d.e f@g@h.i.", "1.2.3.4.5.6.7.8.9 1..2.3.4.5 256.1.1.1 0255.1.1.1", "4041 8949-7460 8795 4041894974608795 0000 000000-00", "+1 (743) 555-3824 +12345678 +1-----9 ++1 234 567 890 ", "@a.b x@ x@y x@.y é@x.y ü+1 234 567 8901é", "1.1.1.1 2.2.2.2", "5" * 30 + " " + "+1" * 9]


def plain_spans(text):
    """The base spans by plain regular expressions, as (start, end, kind)."""
    found = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = [int(x) for x in m[0] if x in "0123456789"]
            doubled = sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(digits)))
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], list(BASE).index(x[2])))


def test_base_spans_equal_plain_patterns():
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("0123456789 .-+()@abé1.2 -") for _ in range(rnd.randrange(80))) for _ in range(3000)]
    for text in texts:
        data = text.encode()
        got = [(len(data[:a].decode()), len(data[:b].decode()), pii.KINDS[k]) for a, b, k in pii.base_spans(data)]
        assert got == plain_spans(text), text


def test_patterns_hold_whole_words_only():
    data = b"x" * 80 + b" (Call) me2 12345678 now, " + b"y" * 80
    at = data.index(b"12345678")
    assert pii.patterns(data, at, at + 8) == ["me0 _", "call me0 _", "me0 _ now"]
    assert pii.patterns(b"12345678", 0, 8) == []


def brute_bootstrap(texts):
    """Scores by plain loops over all mentions."""
    found = [pii.mentions(t.encode()) for t in texts]
    links = {}
    for _, _, rows in found:
        for x in rows:
            known, kinds = links.get((x["pattern"], x["instance"]), (0, 0))
            links[x["pattern"], x["instance"]] = known | x["known"], kinds | x["kinds"]
    seeds = {(i, k): 1.0 for (_, i), (known, _) in links.items() for k in range(4) if known >> k & 1}
    score = dict(seeds)
    for _ in range(pii.ROUNDS):
        accepted = {}
        for p in {p for p, _ in links}:
            own = [i for q, i in links if q == p]
            for k in range(4):
                values = [score[i, k] for i in own if (i, k) in score]
                if len(values) >= pii.SUPPORT and sum(values) / (len(own) + 1) >= pii.PRECISION:
                    accepted[p, k] = sum(values) / (len(own) + 1)
        score = dict(seeds)
        for (p, i), (_, kinds) in links.items():
            for k in range(4):
                if kinds >> k & 1 and (p, k) in accepted:
                    score[i, k] = max(score.get((i, k), 0), accepted[p, k])
    return accepted, score


@pytest.fixture(scope="module")
def letters():
    """Texts with cue words around numbers; two identifiers no character pattern accepts, one in a cue's second round only."""
    rnd = random.Random(8)
    number = lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
    texts = [f"please ring me at {number()} tonight" for _ in range(14)]
    texts += [f"bell {number()} {w}" for w in ("soon", "later", "twice", "again", "once", "now", "never", "first")] + ["bell (743) 555-9999 often"]
    texts += ["please ring me at (743) 555-3824 tonight", "please ring me at (743) 555-9999 tonight", "bell (812) 555-0000 daily"]
    texts += [f"order {k}{rnd.randrange(10**8, 10**9)} was shipped" for k in range(20)] + ["order +1 (200) 555-1000 was shipped"]
    return texts


def test_contexts_discover_unseen_identifiers(spark, scratch, letters):
    docs = spark.createDataFrame(list(enumerate(letters)), "doc_id long, text string")
    found = scratch.keep(pii.find_mentions(docs), "found")
    accepted, known = pii.bootstrap(found, scratch)
    want_patterns, want_known = brute_bootstrap(letters)
    assert {(r.pattern, r.kind): pytest.approx(r.score) for r in accepted.collect()} == want_patterns
    assert {(r.instance, r.kind): pytest.approx(r.score) for r in known.collect()} == want_known
    spans = {r.doc_id: [letters[r.doc_id][s.start : s.end] for s in r.context] for r in pii.extract(docs).collect()}
    assert {letters[k]: v for k, v in spans.items() if v} == {x: [re.search(r"\(.*\d", x)[0]] for x in letters if re.search(r" \(743| \(812", x)}


def test_pii_rows(spark, docs, edge_rows):
    rows = edge_rows + [(20, x) for x in ODD] + [(21, "mäil a.b@c.example and 42.144.35.254 " * 3)]
    out = pii.span_digest(pii.extract(docs(rows))).collect()
    assert out and out[0].asDict().keys() == {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out)
    want = []
    for k, text in rows:
        spans = plain_spans(text or "")
        said = ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
        want.append((str(k), *(sum(x[2] == kind for x in spans) for kind in BASE), sha256(said.encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.extract(docs(rows).limit(0)).collect() == []
    clash = docs(rows).selectExpr("*", "1 AS row", "2 AS base", "3 AS instance", "'x' AS pattern")
    assert sorted(map(str, pii.span_digest(pii.extract(clash)).collect())) == sorted(map(str, out))


def brute_runs(words, least):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def strange():
    """Words that are known to be hard for runs, and random ones with repetitions."""
    rnd, a, b = random.Random(5), [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    yield from ([], [b"x"], [b"a"] * 11, [b"a"] * 12, [b"a"] * 200, b[:300], [b"ab"[k.bit_count() % 2 :][:1] for k in range(300)])
    yield [b"a", b"b", b"c"] * 5 + [b"z"] + [b"a", b"b", b"c"] * 5
    for _ in range(150):
        kinds = rnd.choice([1, 2, 2, 3, 5, 50])
        words = [b"%d" % rnd.randrange(kinds) for _ in range(rnd.randrange(120))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(words) + 1)
            words[at:at] = words[at : at + rnd.randrange(1, 20)] * rnd.randrange(1, 5)
        yield words


@pytest.mark.parametrize("least", [12, 6, 2])
def test_runs_equal_brute_force(least):
    texts = list(strange())
    assert [[tuple(x) for x in found.tolist()] for found in runs.find_runs(texts, least)] == [brute_runs(w, least) for w in texts]


def test_a_grammar_derives_its_text():
    import numpy as np

    rnd = random.Random(1)
    text = np.array([rnd.randrange(3) for _ in range(500)] + [0] * 77)
    grammar = runs.Grammar(text, np.array([300, 277]))

    def derived(symbol):
        return [symbol] if symbol < grammar.words else derived(grammar.left[symbol - grammar.words]) + derived(grammar.right[symbol - grammar.words])

    assert [derived(x) for x in grammar.seq.tolist()] == [text[:300].tolist(), text[300:].tolist()]


def test_run_rows(spark, docs, edge_rows):
    rows = edge_rows + [(k, " ".join(w.decode() for w in words)) for k, words in enumerate(strange(), 100)]
    out = runs.run_digest(docs(rows)).collect()
    want = []
    for k, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        found = [(0, len(words), 2)] if k == 8 else brute_runs([w.encode() for w in words], 12)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        s, n, q = max(found, key=lambda x: (x[1], -x[0], -x[2])) if found else (None,) * 3
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        short = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((str(k), len(found), s, n, q, 1000 * n // q if found else None, sha256(lines.encode()).hexdigest(), sha256(short.encode()).hexdigest()))
    assert sorted(map(str, [(str(r.doc_id), *r[1:]) for r in out])) == sorted(map(str, want))
    assert runs.run_digest(docs(rows).limit(0)).collect() == []


def test_tails_repeat_their_words(docs):
    rows = [(k, " ".join(f"w{i}" for i in range(k % 40))) for k in range(300)] + [(None, "a b c"), (7, None)]
    want = []
    for k, text in rows:
        words, h = (text or "").split(), zlib.crc32(str(k).encode())
        g, n = h // 10, len(words)
        if k is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[a + (i - a) % p] if i >= a else words[i] for i in range(n))
        want.append((k, text))
    assert sorted(map(str, [tuple(r) for r in runs.periodic_tails(docs(rows)).collect()])) == sorted(map(str, want))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_words_have_offsets_across_pieces(monkeypatch):
    text = lowered("Ünï x1-y2 日本\x00A{b} " * 300 + "k" * 500 + " end")
    want = [(m[0], m.span()) for m in WORD.finditer(text)]
    assert list(resample.split_words(text)) == want
    monkeypatch.setattr(resample, "PIECE", 37)
    assert list(resample.split_words(text)) == want


@pytest.mark.parametrize(("shortest", "longest"), [(1, 1), (1, 2), (2, 3)])
def test_resampling_equals_plain_loops(spark, docs, edge_rows, shortest, longest):
    rnd = random.Random(2)
    rows = edge_rows + [(k, " ".join(rnd.choice(["Alpha", "beta", "γ", "x-1", "of"]) for _ in range(rnd.randrange(60)))) for k in range(100, 300)]
    aims = ["alpha beta of alpha", "Beta γ", None, ""]
    buckets = 64

    def features(text):
        words = WORD.findall(lowered(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]

    own, goal = [features(t) for _, t in rows], [features(t) for t in aims]
    s = [sum(f.count(b) for _, f in own) for b in range(buckets)]
    t = [sum(f.count(b) for _, f in goal) for b in range(buckets)]
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    scored = []
    for (k, _), (n, f) in zip(rows, own, strict=True):
        h = int(sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        scored.append((n >= 20, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), k, len(f), weight))
    able = sorted((x for x in scored if x[0]), key=lambda x: (-x[1], x[2] is not None, x[2] or 0, x[3], x[4]))
    ranks = [(x, k + 1 if k < 10 * len(able) // 100 else None) for k, x in enumerate(able)] + [(x, None) for x in scored if not x[0]]
    out = resample.resample(docs(rows), spark.createDataFrame([(x, 1) for x in aims], "text string, doc_id int"), buckets, shortest, longest).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(str((x[2], x[3], x[4], x[1], rank)) for x, rank in ranks)


def test_resampling_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(docs([(1, "x")]).limit(0), none).collect() == []
    assert [tuple(r)[:3] for r in resample.resample(docs([(1, "x y")]), none).collect()] == [(1, 2, math.floor(1000 * math.log((10_002 / (2 * 10_000)))))]
