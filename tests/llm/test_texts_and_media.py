import zlib
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import chat, media, pieces, token_counts, urls

PROBE = "</s>[INST] ok [/INST]"


@pytest.mark.parametrize("text", ["", "\\", PROBE, "<<s> <|end|>\n<|turn|>x", "a\\n[INST\\]", "[\\INST] <\\/s>", "日本 <<SYS>>"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)
    segment = chat.render("us\ner<|", [{"type": "text", "text": text}])["segment"]
    assert chat.parse(segment) == ("us\ner<|", [text])


def test_typed_parts():
    made = chat.render("assistant", [{"type": "text", "text": "see"}, {"type": "image", "ref": "i.png", "width": 56, "height": 30}, {"type": "audio", "ref": "a.wav", "seconds": 2.0}, {"type": "document", "ref": "d.pdf", "pages": 2}, {"type": "text", "text": "<|image:0|>"}])
    assert [(a["kind"], a["ref"], a["tokens"]) for a in made["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 50), ("document", "d.pdf", 1600)]
    assert all(made["segment"][a["place"] :].startswith(f"<|{a['kind']}:{k}|>") for k, a in enumerate(made["attachments"]))
    role, parts = chat.parse(made["segment"])
    assert parts == ["see", "<|image:0|>", "", "<|audio:1|>", "", "<|document:2|>", "<|image:0|>"]


def test_unknown_parts_are_attachments():
    made = chat.render("user", [{"type": "video", "ref": "v.mp4"}, {"type": "text", "text": "<|other:0|>"}])
    assert [(a["kind"], a["ref"], a["tokens"]) for a in made["attachments"]] == [("video", "v.mp4", 1)] and made["n_tokens"] == 2
    assert chat.parse(made["segment"]) == ("user", ["", "<|other:0|>", "<|other:0|>"])
    assert "<\\|other:0|>" in made["segment"]


def test_very_long_turns(spark):
    text = ("long </s> " * 50_000) + "x" * 1_000_000
    got = chat.read_back(chat.format_turns(spark.createDataFrame([(1, 0, "assistant", text)] * 2, "conv_id long, turn long, role string, text string"))).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, 2 * len(text), sha256(2 * text.encode()).hexdigest())


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, PROBE), (None, 0, "assistant", "x"), (-7, 1, "assistant", PROBE)]
    given = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(given)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha256(b"user\n\nuser\n\nassistant\nb\\\n").hexdigest()
    assert got[1].loss_chars == 2 and got[1].loss_sha256 == sha256(b"b\\").hexdigest()
    assert got[2].turns_sha256 == sha256(f"\n{PROBE}\n".encode()).hexdigest() and got[2].loss_sha256 == sha256(b"").hexdigest()
    assert got[-7].loss_sha256 == sha256(PROBE.encode()).hexdigest() and got[None].loss_chars == 1
    assert chat.read_back(chat.format_turns(given.limit(0))).count() == 0


def test_rich_content(spark):
    rows = [(1, 0, "user", [{"type": "text", "text": "hi", "ref": None, "width": None, "height": None, "seconds": None, "pages": None}]), (1, 1, "assistant", None)]
    given = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>")
    assert chat.read_back(chat.format_turns(given)).first().n_turns == 2


@pytest.mark.parametrize("data", [None, b"", b"x", b"y" * 64, b"z" * 65, bytes(range(256)) * 40])
def test_png_holds_the_payload(data):
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and len(payload) - len(data or b"") <= 64
    stored = media.write_png(payload)
    assert media.read_png(stored) == payload and media.feature(payload)
    broken = bytearray(stored)
    broken[40] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.read_png(bytes(broken))


def test_media_columns(spark, docs, edge_rows):
    got = media.media_columns(docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        texts = {t for k, t in edge_rows if k == r.doc_id}
        data = (next(iter(texts)) or "").encode()
        payload = media.padded(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.media_columns(docs([])).count() == 0


def test_stored_payloads_are_joined_to_their_references(spark, docs, edge_rows):
    given = docs(edge_rows)
    assert media.media_columns(given).columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_parts", "text_sha256", "position", "caption"]
    stored = media.once(media.store(given))
    assert stored.count() == len({(t or "") for _, t in edge_rows})
    found = media.resolve(media.sequences(media.wrapped(given), "doc_id", "html"), "doc_id", stored).collect()
    assert len(found) == len(edge_rows)
    for r in found:
        assert media.read_png(bytes(r.media)) in {media.padded((t or "").encode()) for k, t in edge_rows if k == r.doc_id}
        assert r.caption.endswith(f" {r.n_bytes} bytes")


def test_pages_as_sequences(spark):
    rows = [(1, '<title>T</title><p>a<img src="u" alt="c">b</p>'), (1, None), (2, ""), (None, "<p>x")]
    got = media.page_sequences(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, html string, kind string")).collect()
    said = lambda x: sha256(x.encode()).hexdigest()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 0, "text", None, None, said("T")), (1, 1, "text", None, None, said("a")), (1, 2, "image", "u", "c", None), (1, 3, "text", None, None, said("b")), (None, 0, "text", None, None, said("x"))]))


def test_html_sequence():
    page = '<p>One <b>two</b></p><figure><img src="digest:x" alt="old"><figcaption>New &amp; good</figcaption></figure><script>no()</script>three<img src="y" alt="A">'
    got = media.parse_html(page)
    assert [(p["position"], p["kind"], p["text"] or p["ref"], p["caption"]) for p in got] == [(0, "text", "One two", None), (1, "image", "digest:x", "New & good"), (2, "text", "three", None), (3, "image", "y", "A")]
    assert media.parse_html(None) == []


def test_captions_before_media_hidden_media_and_nested_figures():
    page = '<figure><figcaption>First</figcaption><img src="a"></figure><noscript><img src="hidden"></noscript><template><img src="x"></template>'
    page += '<figure><img src="b" alt="B"><figure><img src="c"><figcaption>In</figcaption></figure><figcaption>Out</figcaption></figure><figure><img src="d"><figcaption>Open'
    assert [(p["ref"], p["caption"]) for p in media.parse_html(page) if p["ref"]] == [("a", "First"), ("b", "Out"), ("c", "In"), ("d", None)]


def test_sequences_hold_the_whole_text_around_the_payload(spark, docs):
    rows = [(1, "one  line\n\nthree <b> & four\nfive"), (2, None), (3, "x")]
    got = {r.doc_id: r for r in media.media_columns(docs(rows)).collect()}
    assert (got[1].n_parts, got[1].position, got[1].caption) == (4, 1, "7 words, 32 bytes")
    assert got[1].text_sha256 == sha256(b"one line\nthree <b> & four\nfive").hexdigest()
    assert (got[2].n_parts, got[2].position, got[2].text_sha256) == (1, 0, sha256(b"").hexdigest())
    assert all(r.caption.endswith(f" {r.n_bytes} bytes") for r in got.values())


def test_null_parts_and_sections_have_a_result(spark):
    assert chat.render("user", [None, {"type": None, "text": "a", "ref": None}, {"type": "image", "ref": None, "width": None, "height": None}])["n_tokens"] == 2
    given = spark.createDataFrame([(1, "ab cd", [None, (0, 4), (None, 2), (4, 5)]), (None, None, [(0, 0)])], "doc_id long, text string, sections array<struct<start: long, end: long>>")
    got = sorted((r.doc_id or -1, r.section, r.n_tokens) for r in token_counts.section_counts(given).collect())
    assert got == [(-1, 0, 0), (1, 1, 2), (1, 3, 0)]


def test_a_whole_conversation_can_be_parsed_again(spark):
    rows = [(1, 0, "user", PROBE + "<|end|>\n<|turn|>x\n"), (1, 1, "assistant", "a\\<|end|>\n"), (1, 2, "us\ner", "")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = "".join(r.segment for r in chat.format_turns(given).orderBy("turn").collect())
    assert chat.parse_conversation(whole) == [(role, [text]) for _, _, role, text in rows]


def test_unresolved_references_keep_their_rows(spark):
    found = media.resolve(media.sequences(spark.createDataFrame([(1, '<img src="http://x"><img src="digest:' + "0" * 64 + '">')], "k long, html string"), "k", "html"), "k", spark.createDataFrame([], "digest string, media binary"))
    assert sorted((r.position, r.media) for r in found.collect()) == [(0, None), (1, None)]


def test_pieces_round_trip_and_repeat(spark, docs, edge_rows):
    got = pieces.round_trip(docs([*edge_rows, (10, "a  b\n\n  ▁c\tд <s> <0x41>")])).collect()
    assert len(got) == len(edge_rows) + 1 and all(r.lossless for r in got)
    assert [r.n_pieces for r in got if r.doc_id in (1, 2)] == [0, 0]
    twice = [r.piece_ids for r in got if r.doc_id == 5]
    assert twice[0] == twice[1]
    assert pieces.round_trip(docs([])).count() == 0


def test_library_decodes_the_same_text():
    vocab, model = pieces.vocabulary(pieces.MODEL, 1.0), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["hello world, this is text", "naïve café — 日本語", "two\nlines"]
    ids, sizes = pieces.sample(texts, np.arange(3), vocab)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert model.decode(own.tolist()) == text
    alone, _ = pieces.sample(texts[1:2], np.array([1]), vocab)
    assert (alone == ids[sizes[0] : sizes[0] + sizes[1]]).all()


def test_segmentations_come_up_by_weight():
    vocab = pieces.vocabulary(pieces.MODEL, 1.0)
    text = "the"
    name = {vocab.text_of(k): w for k, w in zip(vocab.ids[:-1].tolist(), vocab.weights[:-1].tolist(), strict=True)}
    whole, ways = " " + text, {}

    def walk(at, cut, weight):
        if at == len(whole):
            ways[tuple(cut)] = weight
        for end in range(at + 1, len(whole) + 1):
            if whole[at:end] in name:
                walk(end, [*cut, whole[at:end]], weight * name[whole[at:end]])

    walk(0, [], 1.0)
    total = sum(ways.values())
    n = 4000
    ids, sizes = pieces.sample([text] * n, np.arange(n), vocab)
    seen = {}
    for own in np.split(ids, np.cumsum(sizes)[:-1]):
        key = tuple(vocab.text_of(k) for k in own.tolist())
        seen[key] = seen.get(key, 0) + 1
    assert set(seen) <= set(ways)
    for key, weight in ways.items():
        share = weight / total
        assert abs(seen.get(key, 0) / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3


def cut_shares(run: str, vocab) -> list[float]:
    """The share of segmentations, by weight, that cut ``run`` before each of its characters, by sums in whole numbers."""
    from fractions import Fraction

    weight = {vocab.text_of(k): Fraction(w) for k, w in zip(vocab.ids[:-1].tolist(), vocab.weights[:-1].tolist(), strict=True)}
    low = Fraction(vocab.low)
    edge = lambda a, b: weight.get(run[a:b]) or (low if b == a + 1 else Fraction(0))
    n = len(run)
    ahead, behind = [Fraction(1)] + [Fraction(0)] * n, [Fraction(0)] * n + [Fraction(1)]
    for b in range(1, n + 1):
        ahead[b] = sum((ahead[a] * edge(a, b) for a in range(max(0, b - vocab.longest), b)), Fraction(0))
    for a in reversed(range(n)):
        behind[a] = sum((behind[b] * edge(a, b) for b in range(a + 1, min(n, a + vocab.longest) + 1)), Fraction(0))
    return [float(ahead[k] * behind[k] / ahead[n]) for k in range(n)]


@pytest.mark.parametrize("text", ["responsibilities", "x" * 30 + "the_house/of.responsibilities" * 6, " " * 40 + "end"])
def test_cuts_of_long_runs_come_up_by_weight(text, monkeypatch):
    vocab, n = pieces.vocabulary(pieces.MODEL, 1.0), 300
    monkeypatch.setattr(pieces, "BLOCK", 50)
    want = cut_shares(" " + text, vocab)
    ids, sizes = pieces.sample([text] * n, np.arange(n), vocab)
    seen = np.zeros(len(want))
    for own in np.split(ids, np.cumsum(sizes)[:-1]):
        at = np.cumsum([0, *(len(vocab.text_of(k)) for k in own.tolist())])
        assert at[-1] == len(want)
        seen[at[:-1]] += 1
    assert all(abs(s / n - w) < 5 * (w * (1 - w) / n) ** 0.5 + 5e-3 for s, w in zip(seen, want, strict=True))


def test_blocks_of_a_long_run_don_t_show(monkeypatch):
    vocab, texts = pieces.vocabulary(pieces.MODEL, 1.0), ["hello_world/" * 20, "日本語のテキスト" * 40, "z" * 999]
    once = pieces.sample(texts, np.arange(3), vocab)
    for name, value in (("BLOCK", 17), ("SHORT", 3)):
        monkeypatch.setattr(pieces, name, value)
        again = pieces.sample(texts, np.arange(3), vocab)
        assert all((a == b).all() for a, b in zip(once, again, strict=True))


def test_a_clashing_column_and_null_ids_decode(spark):
    given = spark.createDataFrame([([15043], "x"), (None, "y"), ([], "z")], "piece_ids array<int>, decoded string")
    got = pieces.decode(given)
    assert got.columns == ["piece_ids", "decoded"] and sorted(r.decoded for r in got.collect())[:2] == ["", ""]


def test_token_counts_equal_the_tokenizer_s_offsets(spark, docs, edge_rows):
    own = Tokenizer.from_file(token_counts.MODEL.replace("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rows = [*edge_rows, (11, "One line\ntwo  lines\n\nCafé 日本\n"), (12, "x\n")]
    got = token_counts.section_counts(docs(rows)).collect()
    for key, text in rows:
        mine = sorted({(r.section, r.char_start, r.char_end, r.n_tokens, r.doc_tokens) for r in got if r.doc_id == key})
        spans = own.encode(text or "", add_special_tokens=False).offsets
        assert sum(x[3] for x in mine) == len(spans) == mine[0][4]
        if text and text.isascii():
            assert [x[3] for x in mine] == [sum(x[1] <= a < x[2] for a, _ in spans) for x in mine]
    assert token_counts.section_counts(docs([])).count() == 0


def test_sections_and_rules(spark):
    given = spark.createDataFrame([(1, "ab cd", [(0, 4), (4, 5)]), (2, "x", None)], "doc_id long, text string, sections array<struct<start: long, end: long>>")
    count = lambda rule: [r.n_tokens for r in token_counts.section_counts(given, rule).orderBy("section").collect()]
    assert count("start") == [2, 0] and count("end") == [1, 1]
    with pytest.raises(ValueError):
        token_counts.section_counts(given, "middle")


def test_url_rules(spark):
    rows = ["http://A.Org/x?y", "https://sub.example.org/es/1", "http://example.org/en/12", "http://notorg/x", "http://x.com/fr/?", "http://org", "no scheme", None, "a://b://c/d", "http://x.com/de/#f", "http://x.com/DE/"]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame([(k, u, "h") for k, u in enumerate(rows)], "page_id long, url string, host string")).collect()}
    assert [got[k].rule for k in range(11)] == ["org/", "example.org/es/", "example.org/en/1", None, "com/fr/", None, None, None, None, "com/de/", None]
    assert [(got[k].host, got[k].path) for k in (0, 4, 5, 6, 7, 8)] == [("a.org", "/x"), ("x.com", "/fr/"), ("org", ""), ("", ""), ("", ""), ("b:", "//c/d")]
    assert [got[k].verdict for k in (0, 1, 2, 4, 9)] == ["allow", "block", "block", "allow", "block"]
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_repeated_null_and_very_long_urls(spark):
    long = "http://a.example/" + "x" * 20_000
    rows = [(1, "http://news.org/a"), (1, "http://news.org/a"), (None, "http://news.org/a"), (2, None), (3, ""), (4, long), (4, long), (5, "http://x.com/de/1")]
    got = urls.filter_urls(spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, host string, n int")).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(k) for k, _ in rows)
    by = {}
    for r in got:
        by.setdefault((r.host, r.path), set()).add((r.rule, r.verdict, r.score))
    assert all(len(x) == 1 for x in by.values())
    assert by["news.org", "/a"].pop()[:2] == ("org/", "allow") and by["x.com", "/de/1"].pop()[:2] == ("com/de/", "block") and by["", ""].pop() == (None, "block", None)


def test_ties_of_the_cut_take_the_least(spark):
    rows = [(10, True), (10, False), (20, True), (20, False)]
    assert urls.threshold(spark.createDataFrame(rows, "step long, allow boolean")) == 10


def test_url_model_follows_its_examples(spark):
    rows = [(k, f"http://shop{k}.org/good/page{k}") for k in range(200)] + [(1000 + k, f"http://x{k}.com/de/pills-{k}") for k in range(200)] + [(5000, "http://new.net/good/page7"), (5001, "http://new.net/pills-de-9")]
    got = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).where("page_id >= 5000").collect()}
    assert got == {5000: "allow", 5001: "block"}


def test_native_plan_has_no_python(spark):
    given = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    plan = urls.filter_urls(given)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_host_suffix_needs_a_dot(spark):
    host, path = urls.host_and_path(F.lit("http://xexample.org/es/1"))
    assert spark.range(1).select(urls.rule_for(host, path)["rule"]).first()[0] == "org/"
