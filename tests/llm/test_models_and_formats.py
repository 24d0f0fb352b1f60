"""Audio, html, classifier, search, packing, tokens, chats: round trips, brute force, held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, html_extract, media, mtree, packing, quality
from tidemark.llm.bpe import Bpe, encode_decode
from tidemark.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


ODD = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "<|endoftext|>", "<|endof", "日本", "\U0001f600", "1", "23", "!", " ", "\x85", "\xa0", "\x1c", "​", "﻿", "́", "²", "'", "\x00", "　", "᠎"]


@pytest.mark.parametrize("kind", [Bpe, packing._Compiled])
def test_tokens_against_the_library(reference, kind):
    bpe, r = kind(open(vocabulary_path(), "rb").read()), random.Random(1)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["ab" * 20_000, ""]
    for t in texts:
        ids = np.frombuffer(bpe.packed(t), "<u4")
        assert ids.tolist() == reference.encode(t, add_special_tokens=False).ids, repr(t)
        assert bpe.decode(ids) == reference.decode(ids.tolist(), skip_special_tokens=False)


def test_decoding_of_broken_bytes(reference):
    bpe = Bpe(open(vocabulary_path(), "rb").read())
    ids = np.frombuffer(bpe.packed("\U0001f600"), "<u4")[:-1]
    assert bpe.decode(ids) == reference.decode(ids.tolist(), skip_special_tokens=False)


def test_encode_decode_rows(spark, reference):
    rows = [(1, "Hello <|endoftext|> wörld"), (2, None), (2, ""), (None, "x")]
    out = encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary_path()).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == sorted((i or 0, t or "") for i, t in rows)


def test_audio_round_trip_and_resync():
    for raw in (b"", b"x", bytes(range(255)) * 9, b"\xc3\xa9" * 3000):
        size = max(576, -(-len(raw) // 576) * 576)
        payload = raw.ljust(size, b"\xff")
        stream = media.write_stream(payload, len(raw))
        s = media.read_stream(stream)
        assert media.payload_of(stream, s) == payload and s.tags["n_bytes"] == str(len(raw))
        assert s.vbr["frames"] == len(s.offsets) == size // 576 and s.duration() == (size, 16000)
        assert (s.bad_crc, s.resyncs, s.skipped) == (0, 0, 0) and media.seek(s, 0) == s.offsets[0]
    damaged = stream[:700] + b"\x00\xff\xfbjunk" + stream[700:]
    assert media.read_stream(damaged).resyncs >= 1
    at = s.offsets[2]
    bad = bytearray(stream)
    bad[at + 8] ^= 1
    assert media.read_stream(bytes(bad)).bad_crc == 1
    cut = media.read_stream(stream[: s.offsets[3] + 10])
    assert len(cut.offsets) == 3
    between = stream[:at] + b"garbage without sync" + stream[at:]
    again = media.read_stream(between)
    assert again.resyncs == 1 and media.payload_of(between, again) == payload


@pytest.mark.parametrize("word,want", [("fffb9064", (1, 3, 128, 44100, 417, 1152)), ("fff3a0c0", (2, 3, 96, 22050, 313, 576)), ("fffd8804", (1, 2, 128, 32000, 576, 1152)), ("ffe318c4", (25, 3, 8, 8000, 72, 576)), ("fffbf064", None), ("ffef9064", None)])
def test_audio_headers(word, want):
    h = media.header(bytes.fromhex(word))
    assert (h and (h.version, h.layer, h.kbits, h.rate, h.length, h.samples)) == want


def _frame(word, fill=b""):
    h = media.header(word)
    return (word + fill).ljust(h.length, b"\0")[: h.length]


def test_audio_of_mpeg1_stereo_with_a_vbri_table():
    word = bytes.fromhex("fffb9064")  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, joint stereo
    sizes = [417, 2 * 417]
    table = b"\0" * 32 + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 4 * 417, 3, 2, 1, 2, 1) + struct.pack(">HH", *sizes)
    data = _frame(word, table) + 3 * _frame(word)
    s = media.read_stream(data)
    assert s.vbr == {"kind": "VBRI", "bytes": 4 * 417, "frames": 3, "seek": [0, 417, 3 * 417]}
    assert s.offsets == [417, 834, 1251] and s.duration() == (3 * 1152, 44100) and s.resyncs == 0


def test_audio_of_mixed_rates_is_timed_exactly():
    a, b = bytes.fromhex("fffb9064"), bytes.fromhex("fffb9464")  # 44.1 and 48 kHz
    s = media.read_stream(2 * _frame(a) + 2 * _frame(b))
    rate = 7_056_000
    assert len(s.offsets) == 4 and s.duration() == (2 * 1152 * (rate // 44100) + 2 * 1152 * (rate // 48000), rate)


def test_audio_delay_and_padding_of_an_encoder():
    word = bytes.fromhex("fffb9064")
    table = b"\0" * 32 + b"Info" + struct.pack(">III", 7, 4, 5 * 417) + bytes(range(100)) + b"LAME3.100" + b"\0" * 12 + (576 << 12 | 1000).to_bytes(3, "big")
    s = media.read_stream(_frame(word, table) + 4 * _frame(word))
    assert s.duration() == (4 * 1152 - 576 - 1000, 44100) and s.vbr["seek"][10] == 10 * 5 * 417 // 256


def test_audio_checksums_of_layer_one():
    word = bytes.fromhex("fffe10c0")  # MPEG-1 Layer I, CRC, mono
    h = media.header(word)
    assert (h.layer, h.protected, h.covered) == (1, True, 16) and media.header(bytes.fromhex("fffc10c0")).covered is None
    assert [media.header(bytes.fromhex(w)).covered for w in ("fffe1000", "fffe1040", "fffe1070")] == [32, 18, 24]
    body = bytes(range(1, 17))
    crc = int(media.crc16(np.frombuffer(word[2:4] + body, np.uint8)[None])[0])
    good, bad = (_frame(word, x.to_bytes(2, "big") + body) for x in (crc, crc ^ 1))
    s = media.read_stream(good + bad + good)
    assert len(s.offsets) == 3 and s.bad_crc == 1


@pytest.mark.parametrize("tag,want", [
    (b"ID3\x03\0\x40" + b"\0\0\0\x1f" + b"\0\0\0\x06" + b"\0" * 6 + b"TIT2\0\0\0\x05\0\0\0name" + b"\0" * 6, {"TIT2": "name"}),
    (b"ID3\x04\0\x50" + b"\0\0\0\x15" + b"\0\0\0\x06\x01\0" + b"TIT2\0\0\0\x05\0\0\x03name" + b"3DI\x04\0\x50\0\0\0\x15", {"TIT2": "name"}),
    (b"ID3\x02\0\0" + b"\0\0\0\x0b" + b"TT2\0\0\x05\0name", {"TT2": "name"}),
    (b"ID3\x03\0\x80" + b"\0\0\0\x12" + b"TIT2\0\0\0\x07\0\0\x01\xff\0\xfen\0o\0", {"TIT2": "no"}),
    (b"ID3\x04\0\0" + b"\0\0\0\x0f" + b"TIT2\0\0\0\x05\0\x08\x03name", {}),
])
def test_audio_tags(tag, want):
    s = media.read_stream(tag + 2 * _frame(bytes.fromhex("fffb9064")))
    assert (s.tags, len(s.offsets), s.resyncs) == (want, 2, 0) and s.offsets[0] == len(tag)


def test_audio_of_odd_tables(spark):
    odd = spark.createDataFrame([(1, "a", "x", 7)], "doc_id long, text string, media string, n_bytes int")
    out = media.media_features(media.to_media(odd)).collect()
    assert [(r.doc_id, r.n_bytes) for r in out] == [(1, 1)]
    assert media.media_features(media.to_media(odd.limit(0))).isEmpty()


def test_audio_rows(spark):
    rows = [(1, "téxt"), (2, None), (3, "téxt"), (None, "z" * 5000)]
    out = {r.doc_id: r for r in media.media_features(media.to_media(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out[1].asDict() | {"doc_id": 3} == out[3].asDict()
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert (out[i].n_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_html_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small tree."""
    page = html_extract.Page("<div class=content><p>Some words are here.</p><div class=ad>buy</div></div><footer>end</footer>")
    m = html_extract.trained()
    n, x = len(page.parent), page.node_features()
    total, on = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        p = m.root[y[0]] + sum(t[x[i, f], y[i]] for i in range(n) for f, t in enumerate(m.nodes))
        p += sum(m.edges[x[i, 0], y[page.parent[i]], y[i]] for i in range(1, n))
        total += np.exp(p)
        on += np.exp(p) * np.array(y)
    assert np.allclose(m.marginals([page])[0], on / total)


def test_html_held_out():
    import re

    label = re.compile(r'<([a-z0-9]+) data-y="([01])"')
    wrong = seen = 0
    for source, base in html_extract.label_pages(80, seed=99):
        page = html_extract.Page(source)
        marks = [int(y) for tag, y in label.findall(source) if tag not in html_extract.INLINE]
        y = np.array([base] * (len(page.parent) - len(marks)) + marks)
        guess = html_extract.trained().marginals([page])[0] >= 0.5
        at = sorted({n for n, t, _ in page.runs if t.strip()})
        wrong, seen = wrong + int((guess[at] != y[at]).sum()), seen + len(at)
    assert wrong / seen < 0.03


@pytest.mark.parametrize("source,want", [
    ("", ""), ("<p", ""), ("<article><p>One &amp; two.<p>Three<br>four <b>f</b>ive.</article><footer>no</footer>", "One & two. Three four five."),
    ("<nav><a href=/>x</a></nav><article><h1>T</h1><script>if (a<b) '</p>'</script><p>Body  of\n it.</p><div class='ad'>Buy</div></article>", "T Body of it."),
    ("<body><header>Site</header><div id=content><p>Some text that is main.</p></div><div class=comments><p>Nice one, I like this.</p></div></body>", "Some text that is main."),
])
def test_html_text(source, want):
    assert html_extract.extract(source) == want


@pytest.mark.parametrize("source", [
    "<html><head><title>t</title><body><article>{}</article>",
    "<html><head><meta charset=utf-8><title>t</title><article>{}</article>",
    "<html><head><script>x = '<!--'; y = '</head>'</script></head><body><article>{}</article>",
    "<article><script>x = '<!--'</script>{}</article>",
    "<div><button>Menu</div><article>{}</article>", "<div><select><option>A<option>B</div><article>{}</article>",
    "<div><svg><g><path d=''/></div><article>{}</article>", "<article><svg><g>{}</article>",
    "<div><object data=x>none</div><article>{}</article>", "<article><svg><svg><text>no</text></svg><text>no</text></svg>{}</article>",
])
def test_html_unclosed_silent_elements(source):
    assert html_extract.extract(source.format("<p>Some text that is main.</p>")) == "Some text that is main."


@pytest.mark.parametrize("source", ["<div>" * 20_000, "<a " * 300_000, "<svg>" + "<g>" * 100_000, "<p><button>" + "<div>" * 20_000, "<" + "a" * 900_000, '<a b="c ' * 100_000, "<!" * 400_000, "<i>" * 60_000 + "</b>" * 100_000, "<p " + "x " * 400_000 + ">"])
def test_html_hostile_pages_take_linear_time(source):
    began = time.process_time()
    assert html_extract.extract(source + "<p>no") is not None
    assert time.process_time() - began < 8


OTHER_SITES = [  # pages of other hands than label_pages: their own class names and order of parts
    ("<body><div class=wrap><h4 class=brand>Paperboy</h4><ul class=lnks><li><a href=/a>Home</a><li><a href=/b>World</a></ul><article class=piece><h1>Rain over the hills</h1><p>It rained for three days, and the river rose.</p><p>Nobody was hurt.</p></article><footer>All rights kept.</footer></div>", "Rain over the hills It rained for three days, and the river rose. Nobody was hurt."),
    ("<main><h1>Soup</h1><p>Cut the onions. Fry them slowly.</p><ol><li>Add water.<li>Boil it for an hour.</ol><aside><p>See our other soups!</p></aside></main><div id=cookie-bar>We use cookies.</div>", "Soup Cut the onions. Fry them slowly. Add water. Boil it for an hour."),
    ("<table><tr><td><a href=1>One</a> <a href=2>Two</a><td><article><h2>Old page</h2><p>Written in a table, as was done then, with some length to it.</article></table>", "Old page Written in a table, as was done then, with some length to it."),
    ("<article><h1>Uh.***</h1><p>Uh.*** Oh.###</p></article><footer>(c) x</footer>", "Uh.*** Uh.*** Oh.###"),
    ("<nav>menu</nav><article><p>Short</p></article><form>Name <input></form>", "Short"),
    ("<div class=masthead>The Daily</div><div class=article-body><p>A first paragraph that is long enough to be read as one.</p><blockquote>And a quotation.</blockquote></div><div class=replies><p>I do not agree with any of this, sorry.</p></div>", "A first paragraph that is long enough to be read as one. And a quotation."),
]


@pytest.mark.parametrize("source,want", OTHER_SITES)
def test_html_of_other_sites(source, want):
    assert html_extract.extract(source) == want


def test_html_rows_of_odd_tables(spark):
    rows = [(1, "u", "<article><p>Hi there, you.</p></article>", "x", 5)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_extract.extract_pages(odd).collect()] == [(1, "u", "Hi there, you.", 14)]
    assert html_extract.extract_pages(odd.limit(0)).isEmpty()


def test_html_rows(spark):
    rows = [(1, None, None), (2, "u", "<article><p>Hi there, you.</p></article>"), (2, "u", "<article><p>Hi there, you.</p></article>")]
    out = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert out == [(1, "", 0), (2, "Hi there, you.", 14), (2, "Hi there, you.", 14)]


def test_machine_identity_and_gradient():
    r = np.random.default_rng(0)
    m = quality.Machine(30, 3)
    m.v, m.w, m.w0 = r.normal(size=(30, 3)), r.normal(size=30), 0.3
    x = r.normal(size=(5, 30))
    pairs = [sum(m.v[i] @ m.v[j] * row[i] * row[j] for i in range(30) for j in range(i)) for row in x]
    assert np.allclose(m.raw(x), m.w0 + x @ m.w + pairs)


def test_machine_learns_interactions():
    r = np.random.default_rng(1)
    x = np.zeros((3000, 40), np.float32)
    x[:, :6] = r.integers(0, 2, (3000, 6))
    y = (x[:, 0] == x[:, 1]).astype(np.float32)
    m = quality.Machine(40, 4)
    m.__class__.fit(m, x[:2500], y[:2500])
    assert ((m.score(x[2500:]) > 0.5) == y[2500:]).mean() > 0.9


def test_quality_held_out(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    machine = quality.fit(docs, labels.where(~quality.held_out()))
    out = quality.scored(docs, machine).join(labels, "doc_id").where(quality.held_out())
    rows = out.select("predicted", "quality").collect()
    assert sum(r[0] == r[1] for r in rows) / len(rows) > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.scored(docs, quality.fit(docs, none)).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, quality.fit(docs, labels)).collect())


def _nearest(vectors, k, every):
    v = {i: np.floor(256 * np.array(x, float)).astype(object) for i, x in vectors.items()}
    for q in v:
        if q % every == 0:
            hits = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q and len(v[i]) == len(v[q])))[:k]
            for rank, (s, i) in enumerate(hits, 1):
                yield q, rank, i, -s


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 90, "BLOCK": 4, "TOGETHER": 2}])
def test_search_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(mtree, "PAGE", 16)
    for name, n in sizes.items():  # several trees of a node, and several copies of a tree
        monkeypatch.setattr(mtree, name, n)
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    vectors = {i: (centres[i % 6] + r.normal(scale=0.2, size=8)).astype(np.float32).tolist() for i in range(700)}
    vectors |= {700 + i: vectors[0] for i in range(9)} | {800: [1.0, 2.0], 850: [2.0, 1.0], 900: [1e6] * 8}
    odd = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (1003, []), (None, [1.0] * 8), (0, vectors[0])]
    df = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    got = sorted(tuple(x) for x in mtree.top_k(df, df.where("vec_id % 50 = 0"), 5).collect())
    assert got == sorted(_nearest(vectors, 5, 50))
    assert mtree.top_k(df.limit(0), df.limit(0)).isEmpty()


def test_trees_skip_work(monkeypatch):
    """Stored parent distances spare most centres of a clustered tree, and the result stays exact."""
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(mtree, "FAN", 4)
    r = np.random.default_rng(5)
    v = np.concatenate([r.integers(-9, 9, (200, 6)) + 300 * c for c in np.concatenate([np.eye(6, dtype=int), -np.eye(6, dtype=int)])])
    most = int((v * v).sum(1).max())
    parts = mtree._pages(mtree.lifted(v, most), np.arange(len(v)), 16)
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(v))) and max(map(len, parts)) <= 16
    root = SimpleNamespace(value={6: (most, mtree.lifted(v[:1], most))})
    rows = pa.table({"vec_id": np.arange(len(v)), "v": v.tolist()})
    row = mtree._tree(root)([pa.scalar(6), pa.scalar(0), pa.scalar(0)], rows).to_pylist()[0]
    tree = mtree.Tree(row, most)
    ids = np.arange(0, len(v), 40)
    got = {}
    for q, i, s in tree.search(ids, v[ids], np.full(len(ids), np.inf), 3):
        got.setdefault(q, []).append((-s, i))
    for q in ids.tolist():
        assert sorted(got[q]) == sorted((-int(v[q] @ v[i]), i) for i in range(len(v)) if i != q)[:3]
    assert len(tree.pages.ends) > 60 and len(tree.inner.ends) > 12
    assert tree.computed < 0.6 * len(ids) * (len(tree.pages.ends) + len(tree.inner.ends)) and tree.skipped > len(ids)


def test_search_of_very_large_components(spark):
    vectors = {0: [1e7, 1.0], 1: [1e7, 3.0], 2: [1e7, 2.0], 3: [-1e7, 0.0], 4: [1e30, 1.0], 5: [3e9, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in mtree.top_k(df, df.where("vec_id in (0, 5)"), 5).collect()}
    whole = {i: [min(max(int(np.floor(256 * c)) if abs(c) < 1e15 else (1 << 63) - 1, -(1 << 63)), (1 << 63) - 1) for c in v] for i, v in vectors.items()}
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert got == {(q, i): clip(sum(a * b for a, b in zip(whole[q], whole[i]))) for q in (0, 5) for i in vectors if i != q}


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_hilbert_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = packing.hilbert_key(grid, bits)
    order = np.argsort(key)
    assert key[order].tolist() == list(range(len(grid)))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_packing_whole(spark, reference):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "über"]) for _ in range(r.choice([0, 1, 50, 900])))) for i in range(60)] + [(60, None), (61, "x " * 6000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary_path(), length=256).collect()
    ids = {i: reference.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, x in ids.items():
        assert sum(n for _, n in by_doc[i]) == len(x)
    for x in by_sequence.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0


def test_chat_windows():
    r = random.Random(7)
    for _ in range(60):
        turns = [("system", "sys [INST]")] * r.randint(0, 1) + [(r.choice(["user", "assistant"]), r.choice(["</s>[INST] ok [/INST]", "a\\b <\\/s>", "word " * r.randint(0, 60), ""])) for _ in range(r.randint(1, 14))]
        w = chat.Windows(1, 60, 25)
        out = [x for role, text in turns for x in w.add(role, text)] + [w.close()]
        seen, said = [], []
        for _, _, repeated, text, loss in out:
            found = [(chat.unescape(a), chat.unescape(b)) for a, b in chat._turn.findall(text)]
            assert not repeated or turns[0][0] != "system" or found[0] == turns[0]
            assert found[:repeated] == ([turns[0]] if found[:repeated] and turns[0][0] == "system" else []) + seen[len(seen) - repeated + (turns[0][0] == "system" and repeated > 0) :][: max(0, repeated - (turns[0][0] == "system"))]
            size = sum(chat.tokens(b) for _, b in found)
            assert size <= 60 or len(found) == repeated + 1
            seen += found[repeated:]
            said += [chat.unescape(text[s["start"] : s["stop"]]) for s in loss]
        assert seen == turns and said == [t for role, t in turns if role == "assistant"]


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "<<SYS>><</SYS>>", "<s><s>", "<</s>"])
def test_escaping(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_chat_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "y"), (3, 0, "assistant", "z " * 4000)]
    turns = chat.with_control_case(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(0)))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 3, 2: 1, None: 1, 3: 1, -7: 2}
    assert got[-7].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n\nassistant\n\n").hexdigest()
    assert got[3].loss_chars == 8000


PARAGRAPH = "The river rose in the night and by morning the lower fields were under water, so the farmers moved their cattle."
AROUND = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav>{}<div class="cookie-notice"><p>We use cookies to make this site better.</p></div><footer>© 2024 Some company</footer>'
ASIDE = '<div class="sidebar"><h3>Related</h3><ul><li><a href="/x">One</a></li></ul></div>'


@pytest.mark.parametrize(
    "main,want",
    [
        (f'<div class="zq-wrap"><p>{PARAGRAPH}</p></div>', PARAGRAPH),
        (f'<div class="zq-wrap"><h1>Flood</h1><p>{PARAGRAPH}</p></div>', f"Flood {PARAGRAPH}"),
        (f'<div class="grid7"><div class="cell-x"><h1>Flood</h1><p>{PARAGRAPH}</p></div>{ASIDE}</div>', f"Flood {PARAGRAPH}"),
        (f"<div><div><p>{PARAGRAPH}</p></div>{ASIDE}</div>", PARAGRAPH),
        ('<div class="zq-wrap"><p>Rain fell.</p></div>', "Rain fell."),
        (f'<div class="zq-wrap"><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>', f"{PARAGRAPH} {PARAGRAPH}"),
        (ASIDE, ""),
        (f'<div class="comments"><div class="comment"><p>{PARAGRAPH}</p></div></div>', ""),
        ("", ""),
    ],
)
def test_articles_of_one_paragraph(main, want):
    assert html_extract.extract(f"<html><body>{AROUND.format(main)}</body></html>") == want
