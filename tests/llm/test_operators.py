"""Operators against brute force, exact round trips and held-out accuracy, with the odd inputs each must bear."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("edgeloom.llm")
import numpy as np
import pandas as pd

import public_tokenizers
from edgeloom.llm import bpe, common, components, exact_dedup, html_text, line_dedup, packing, quality, queries, simhash, token_files, tokens, topk, toxicity

PATH = tokens.default_path()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n", "A", "a", "Éa", "éA", "word " * 30_000, "x" * 60_000, "  a  b\n c \n\n  d", "tab\tand\x0bvt", "<|endoftext|> x", "日本語 テキスト", "a\x00b"]


def docs_frame(spark, texts, ids=None):
    """With extra columns whose names clash with what operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "k", None, 1.5) for i, t in zip(ids, texts)], "doc_id long, text string, key string, norm string, score double")


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_token_chunks(library):
    rng = random.Random(3)
    marks = ["a", "the", " ", "  ", "\n", "\t", "é", "1", "!!", "'s", " ", "　", "\x85", "\x1c", "​", "᠎", "﻿", "日本"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [t or "" for t in ODD]
    texts += ["a <|endoftext|> b", "foo\n <|endoftext|>", "x ²³½ab don't naïve½ aÅ ǆx x²", "<|endoftext|>" * 3]
    for t, got in zip(texts, tokens.token_bytes(texts, PATH)):
        assert np.frombuffer(got, np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])
    assert np.frombuffer(tokens.token_bytes(["a <|endoftext|> b"], PATH)[0], np.uint32).tolist() == [64, 220, 50256, 275]


def test_chunk_memory_is_bounded():
    calls = []

    def encode(chunks):
        calls.append(chunks)
        return [np.array([ord(x) for x in c], np.uint32).tobytes() for c in chunks]

    m = tokens.ChunkMemory(encode, memory=50)
    for i in range(40):
        texts = [f"h x{i} y{i} common z{i}", "", f"h  odd {i} ", "h"]
        assert [np.frombuffer(x, np.uint32).tolist() for x in m.ids(texts)] == [list(map(ord, t)) for t in texts]
    assert len(m.seen) < 60 and sum(" common" in c for c in calls) < 5


# op 1


def test_best_fit_and_bound():
    rng = random.Random(1)
    for n in (1, 5, 60):
        lengths = np.array([rng.randint(1, 64) for _ in range(n)])
        bins, offsets = packing.best_fit_decreasing(lengths, 64)
        for b in set(bins.tolist()):
            own = sorted((o, s) for o, s, c in zip(offsets.tolist(), lengths.tolist(), bins.tolist()) if c == b)
            assert own[0][0] == 0 and all(o + s == p for (o, s), (p, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 64
        assert packing.lower_bound(np.bincount(lengths, minlength=65), 64) <= bins.max() + 1
    # items over half fill a bin each, which volume alone doesn't see
    assert packing.lower_bound(np.bincount([33, 33, 33], minlength=65), 64) == 3
    assert packing.lower_bound(np.bincount([22] * 7, minlength=65), 64) == 4


def check_packing(got, texts, ids, library):
    by_doc = defaultdict(list)
    for r in got.itertuples():
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(ids)
    for d, t in zip(ids, texts):
        full = library.encode(t or "", add_special_tokens=False).ids + [2]
        rows = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        at = 0
        for r in rows:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(full[at : at + r.length], np.uint32).tobytes())
            at += r.length
        assert at == len(full) and all(r.length == 1024 for r in rows[1:]) and (len(rows) == 1) == (len(full) <= 1024)
    for _, group in got.groupby("sequence_id"):
        o = group.sort_values("offset")
        assert o.offset.iloc[0] == 0 and (o.offset + o.length).iloc[-1] <= 1024
        assert ((o.offset + o.length).iloc[:-1].values == o.offset.iloc[1:].values).all()


def test_packing(spark, library):
    rng = random.Random(5)
    texts = ODD + [words(rng, rng.randint(1, 400)) for _ in range(300)]
    got = packing.pack_documents(docs_frame(spark, texts), group_pieces=64).toPandas()
    check_packing(got, texts, list(range(len(texts))), library)
    pieces = got.length[got.length < 1024]
    assert got.sequence_id.nunique() <= (got.length == 1024).sum() + -(-pieces.sum() // 1024) * 1.05 + 2
    assert packing.pack_documents(docs_frame(spark, [])).count() == 0
    again = packing.pack_documents(docs_frame(spark, ["a b", "a b", None], [7, 7, None])).toPandas()
    assert len(again) == 3 and again.sequence_id.nunique() == 1 and sorted(again.offset) == [0, *np.cumsum(sorted(again.length, reverse=True))[:-1]]


def fewest(lengths, capacity):
    """The least number of bins, by trying all."""
    best = len(lengths)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for r in sorted({r for r in room if r >= lengths[i]}):
            rest = list(room)
            rest.remove(r)
            place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*room, capacity - lengths[i]])

    place(0, [])
    return best


def test_bound_and_packing_against_all_ways():
    rng = random.Random(21)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 8))), reverse=True)
        least = fewest(lengths, 30)
        bins, _ = packing.best_fit_decreasing(np.array(lengths), 30)
        assert packing.lower_bound(np.bincount(lengths, minlength=31), 30) <= least <= bins.max() + 1


def test_packing_rounds(spark):
    """Groups with gaps exchange pieces until the whole is certified or an exchange saves nothing; the certificate says which."""
    rng = random.Random(22)
    few = [(i, 0, 0, rng.randint(1, 60), 7) for i in range(3000)]
    halves = [(i, 0, 0, 51, 7) for i in range(1000)]  # each fills a sequence of its own
    for rows, group in ((few, 16), (few, 100_000), (halves, 16), ([(None, 0, 0, 30, 7)] * 500, 16)):
        frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
        got = packing.pack(frame, 100, group).toPandas()
        assert len(got) == len(rows) and got.groupby("sequence_id").length.sum().max() <= 100
        proof = packing.certificate(spark.createDataFrame(got), 100)
        assert proof["sequences"] == got.sequence_id.nunique() >= proof["bound"] == packing.lower_bound(np.bincount([r[3] for r in rows], minlength=101), 100)
        assert proof["certified"] == (proof["sequences"] == proof["bound"]) and proof["sequences"] <= 1.05 * proof["bound"] + 1


# op 3

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a>Menu one</a></ul></nav>"
    '<div class="cookie-notice">We use cookies, really, all of them.</div><div id="main"><h1>Head &amp; line</h1><p>First  paragraph,\n with <b>bold</b> text; it is long enough to count.'
    '<p>Second<br>one, which is also fairly long, as paragraphs go, is it not?</p><aside>Sideways talk, long and wide, with commas.</aside><form>Your name, please: <input></form>'
    '<div class="ad">Buy, buy, buy!</div><ul><li>short item</li><li>other</li></ul></div><div class="comments"><p>Great article, thanks, everyone!</p></div><footer>&copy; us</footer></body></html>'
)


def test_html():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst paragraph, with bold text; it is long enough to count.\n\nSecond one, which is also fairly long, as paragraphs go, is it not?\n\nshort item\n\nother"
    for page in (None, "", "<p", "<!-- x", "<script>var a;", "<nav>only menu</nav>"):
        assert html_text.main_text(page) == ""
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"
    assert html_text.main_text("<p>" * 3000 + "deep, indeed.") == "deep, indeed."
    assert html_text.main_text("<article><p>one, two.<article><p>x</article>") == "one, two.\n\nx"


def test_html_keeps_all_selected_blocks():
    long = [f"Paragraph {i} goes on for a while, with commas, and then some more words; it ends." for i in range(25)]
    p = lambda some: "".join(f"<p>{x}</p>" for x in some)
    story = f'<body><div class="story"><div>{p(long[:23])}</div><div>{p(long[23:])}</div></div></body>'
    assert html_text.main_text(story).split("\n\n") == long
    two = f"<body><main><article><h2>One</h2>{p(long[:15])}</article><article><h2>Two</h2>{p(long[15:])}</article></main><footer>Us.</footer></body>"
    assert html_text.main_text(two).split("\n\n") == ["One", *long[:15], "Two", *long[15:]]
    head = f"<body><div><h1>{long[0]}</h1><div>{p(long[1:])}</div></div></body>"
    assert html_text.main_text(head).split("\n\n") == long


LONG = "".join(f"<p>Sentence {i} is rather long, has some marks, and goes on for a while; then it ends.</p>" for i in range(4))
LINES = [f"Sentence {i} is rather long, has some marks, and goes on for a while; then it ends." for i in range(4)]


def test_html_paths_decide():
    lines = lambda page: html_text.main_text(page).split("\n\n")
    # things that are not the article inside it
    inside = '<article>{0}<div><a href="#">Share this</a> <a>Mail</a></div><div class="ad">Buy this now, please, and that.</div><aside>By the way, it is so.</aside>{0}</article>'
    assert lines(f"<body>{inside.format(LONG)}</body>") == LINES * 2
    assert lines(f'<body><nav><ul><li><a>Home</a></ul></nav><div class="legal-analysis">{LONG}</div><div class="share"><a>Share</a></div></body>') == LINES
    assert lines(f'<body><div class="search related social">{LONG}</div></body>') == LINES
    # what adjoins the article's long paragraphs stays: headings, short paragraphs, lists
    items = "".join(f"<li>item {i}</li>" for i in range(12))
    assert lines(f"<body><article><h1>Title</h1>{LONG}<ul>{items}</ul><p>Yes.</p></article></body>") == ["Title", *LINES, *(f"item {i}" for i in range(12)), "Yes."]
    assert lines(f"<body><article><header><h1>Title</h1></header>{LONG}</article><section id=comments>{LONG}</section><footer>Us.</footer></body>") == ["Title", *LINES]
    assert html_text.main_text("<body><ul><li><a>One</a><li><a>Two, three.</a></ul></body>") == ""


def test_html_broken_quotes():
    assert html_text.main_text(f'<body><div title="abc>{LONG}</div></body>').split("\n\n") == LINES
    assert html_text.main_text(f"<body><p class='x>{LINES[0]}</p><p>{LINES[1]}</p></body>").split("\n\n") == LINES[:2]
    assert html_text.main_text(f'<body><p title="a > b < c">{LINES[0]}</p></body>') == LINES[0]
    assert html_text.main_text(f'<img src="data:{"x" * 5000}"><p>{LINES[0]}') == LINES[0]


@pytest.mark.parametrize("part", ['<a title="x ', "<div><p>", "<a <", "<b><div><i>", "</b>", "<!", "<script ", "<li>", "<ul><li>a", "<td>", "<a 'x", '"<a "', "&amp", "<!--"])
def test_html_takes_time_in_proportion(part):
    import time

    began = time.process_time()
    html_text.main_text(part * 8000)
    assert time.process_time() - began < 3


def test_html_names(spark):
    rows = spark.createDataFrame([(1, "x", "<p>Hi, you.")], "`page id` long, c0 string, `text` string")
    got = html_text.extract(rows, "text", ("page id", "c0")).collect()
    assert [tuple(r) for r in got] == [(1, "x", "Hi, you.", 8)]


def test_html_table(spark, sf):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "y"), (None, "v", "<p>Hi, you.", "z")], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert got[1, None] == ("", 0) and got[None, "v"] == ("Hi, you.", 8) and got[1, "u"][0].startswith("Head & line")
    rows = queries.op3_html_extraction(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count() and all(r["text"] for r in rows)


# op 4


def brute_topk(rows, k):
    usable = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in usable:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in usable if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(230)]
    same = [0.5] * 8
    rows += [(i, same) for i in range(300, 420)] + [(500, None), (550, [1.0, None]), (600, [float("nan")] * 8), (650, []), (None, same), (700, [1.0, 2.0]), (701, [0.5, 0.5])]
    table = topk.quantized(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, q int").repartition(5))
    for block in (4096, 3):
        got = {tuple(r) for r in topk.exact_topk(table, table.where("vec_id % 50 = 0"), 5, block).collect()}
        assert got == brute_topk([(i, v and [np.float32(x) if x is not None else None for x in v]) for i, v in rows], 5)
    assert topk.exact_topk(table.limit(0), table.limit(0)).count() == 0
    few = topk.quantized(spark.createDataFrame([(0, same), (50, same)], "vec_id long, embedding array<float>"))
    assert {tuple(r)[:3] for r in topk.exact_topk(few, few, 5).collect()} == {(0, 1, 50), (50, 1, 0)}
    with pytest.raises(ValueError):
        big = topk.quantized(spark.createDataFrame([(0, [1e30] * 2)], "vec_id long, embedding array<double>"))
        topk.exact_topk(big, big)
    rows = [(i, [float(rng.integers(-(2**22), 2**22)) for _ in range(4)]) for i in range(60)]  # scores beyond 2**53
    big = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {i: [int(256 * x) for x in v] for i, v in rows}
    want = {(q, n + 1, i, -s) for q in (0, 50) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5])}
    assert {tuple(r) for r in topk.exact_topk(big, big.where("vec_id % 50 = 0")).collect()} == want and max(abs(r[3]) for r in want) > 2**53


def test_histograms_decide(spark, monkeypatch):
    """What passes the thresholds is the result: neither more rows nor fewer, with huge ties and repeated rows."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(1000, 3000)] + [(1000, [0.5] * 8)] * 3
    table = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    queries = table.where("vec_id % 50 = 0").groupBy("vec_id").agg({"v": "min"}).collect()
    q_ids = np.array([r[0] for r in queries], np.int64)
    mats = np.array([r[1] for r in queries], np.int64)
    value, last, copies = topk.thresholds(table, q_ids, {8: (np.arange(len(q_ids)), mats)}, 5, 10**9, False)
    for n, q in enumerate(q_ids):
        scores = [(int(mats[n] @ np.floor(256 * np.float32(v).astype(np.float64)).astype(np.int64)), i) for i, v in rows if i != q]
        passed = sorted((-s, i) for s, i in scores if s > value[n] or (s == value[n] and i <= last[n]))
        extra = sum(-s == value[n] and i == last[n] for s, i in passed) - copies[n]
        assert len(passed) - max(0, extra) == 5
    want = brute_topk([(i, [np.float32(x) for x in v]) for i, v in rows], 5)
    got = topk.exact_topk(table, table.where("vec_id % 50 = 0")).collect()
    assert len(got) == 5 * len(q_ids) and {tuple(r) for r in got} == want
    low = topk.thresholds
    monkeypatch.setattr(topk, "thresholds", lambda *a: (np.full_like(low(*a)[0], -(2**63)), *low(*a)[1:]))
    assert topk.exact_topk(table, table.where("vec_id = 50")).count() > 5


# op 5


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, keep):
    rng = random.Random(4)
    texts = ODD + [rng.choice(["Same Text", "same text", "other", "Ä x", "ä x", ""]) for _ in range(400)] + ["hot copy"] * 500
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[(t or "").translate(LOWER)].append(i)
    got = exact_dedup.exact_dedup(docs_frame(spark, texts, ids), keep=keep, partitions=7).collect()
    pick = max if keep == "largest" else min
    expected = {(i, pick(g), len(g), i == pick(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for i in g}
    assert len(got) == len(texts) and {tuple(r) for r in got} == expected


def test_exact_dedup_odd(spark):
    got = exact_dedup.exact_dedup(docs_frame(spark, ["a", "A", "a", "b"], [5, 5, None, None]), keep="largest").collect()
    assert sorted((r["group_size"], r["kept"]) for r in got) == [(1, True), (3, False), (3, False), (3, True)]
    assert exact_dedup.exact_dedup(docs_frame(spark, [])).count() == 0
    kept = exact_dedup.drop_duplicates(docs_frame(spark, ["x", "X", "y"]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and kept.columns == docs_frame(spark, []).columns


# op 6


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 20_000])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 3, 50257):
        docs = [(i if i else None, (rng.zipf(1.3, n) % top).astype("<u4").tobytes()) for i in range(3)]
        assert token_files.read_block(token_files.write_block(docs)) == docs
    data = token_files.write_block([(1, b"\x05\x00\x00\x00" * 10)])
    for bad in (data[:10], data[:-1], data[:-1] + bytes([data[-1] ^ 1]), b"X" + data[1:]):
        with pytest.raises(ValueError):
            token_files.read_block(bad)


def test_every_bit_is_checked():
    data = token_files.write_block([(1, b"\x05\x00\x00\x00" * 10), (None, b"")])
    for i in range(8 * len(data)):
        bad = bytearray(data)
        bad[i // 8] ^= 1 << i % 8
        with pytest.raises(ValueError):
            token_files.read_block(bytes(bad))


def test_intervals_are_a_mixture():
    """At any time the ids' intervals tile the axis, and an id's width is the weighted sum of three distributions,
    recomputed here from plain counts."""
    rng = np.random.default_rng(4)
    v, lanes = 23, 40
    model = token_files._Model(v, True)
    a, b = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    every = np.repeat(np.arange(v), 6)
    for t in range(80):
        model.refresh(t)
        model.begin(a, b)
        starts, widths = zip(*(model.interval(np.full(lanes, x, np.int32), np.full(lanes, x)) for x in range(v)))
        starts, widths = np.array(starts), np.array(widths)
        assert (starts[0] == 0).all() and (starts[1:] == (starts + widths)[:-1]).all() and (widths > 0).all() and ((starts + widths)[-1] == 1 << token_files._TOTAL).all()
        unit = 1 << token_files._UNIT
        for lane in range(0, lanes, 7):
            w0 = int(model.w0[lane])
            plain = [w0 * int(model.width_of(x)) for x in range(v)]
            for order, its in ((0, (0, 1)), (1, (2,))):
                counts = divmod(int(model.counts[order][lane]), 16)
                mass = sum(int(model.mass[i][lane]) for i in its)
                assert (mass > 0) <= (sum(counts) > 0) and mass % unit == 0 and (order == 0 or not counts[1])
                if mass:
                    lead = mass // unit * (unit * counts[0] // sum(counts))
                    for i, m in zip(its, (lead, mass - lead)):
                        plain[int(model.ids[i][lane])] += m
            assert plain == widths[:, lane].tolist()
        x = rng.choice(every, lanes).astype(np.int32) if t % 3 else ((a + 3 * b + 1) % v).astype(np.int32)
        for v_at in (starts[x, np.arange(lanes)], (starts + widths)[x, np.arange(lanes)] - 1):
            found, start, width = model.find(v_at.astype(np.int32))
            assert (found == x).all() and (start == starts[x, np.arange(lanes)]).all() and (width == widths[x, np.arange(lanes)]).all()
        model.interval(x, x)
        model.update(x, x)
        a, b = b, x
    assert max(model.counts[1]) > 0 and (model.credit >= 0).all()


def test_repeats_shrink():
    ids = np.tile(np.arange(1000, dtype="<u4"), 60).tobytes()
    assert len(token_files.write_block([(1, ids)])) < len(ids) / 8


def test_token_files(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 2000)
    rng = random.Random(8)
    texts = ODD + [words(rng, rng.randint(1, 200)) for _ in range(80)]
    ids = [i * 3 for i in range(len(texts))]
    order = list(zip(ids, texts))
    rng.shuffle(order)
    got = token_files.through_files(docs_frame(spark, [t for _, t in order], [i for i, _ in order]), files=5).collect()
    rows = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in got}
    at = 0
    for i, t in zip(ids, texts):
        want = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], np.uint32)
        assert rows[i] == (at, want.tobytes())
        at += len(want)
    assert token_files.through_files(docs_frame(spark, [])).count() == 0
    assert [r["start"] for r in sorted(token_files.through_files(docs_frame(spark, ["a", "a", "b"], [1, 1, None])).collect(), key=lambda r: r["start"])] == [0, 2, 4]


# op 7


def brute_lines(rows, min_words=line_dedup.MIN_WORDS):
    hashed = {i: line_dedup.line_hashes(t) for i, t in rows if t is not None}
    holders = defaultdict(list)
    for i in sorted(hashed):
        for h in {h for h, w in zip(*hashed[i]) if w >= line_dedup.ANCHOR_WORDS}:
            holders[h].append(i)
    covered = defaultdict(set)
    for found in holders.values():
        pairs = {(d, found[0]) for d in found[1:]}
        if 3 <= len(found) <= line_dedup.RARE:
            pairs |= {(a, b) for a in found for b in found if a > b}
        for d, p in pairs:
            covered[d] |= set(line_dedup.covered_lines(hashed[d][0], hashed[p][0]))
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in line_dedup.deleted_lines(covered[i], hashed[i][1], min_words)) for i, t in rows}


def test_patience():
    assert line_dedup.patience(list("abcdef"), list("abXdef")) == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]
    assert line_dedup.patience(list("xab"), list("abx")) in ([(1, 0), (2, 1)], [(0, 2)])
    assert line_dedup.patience([], list("a")) == [] and line_dedup.patience(list("aa"), list("aaa")) == [(0, 0), (1, 1)]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_doubled_passages_in_the_middle():
    one, two = list("zABCv"), list("oABCxABCq")
    assert line_dedup.covered_lines(two, one) == [1, 2, 3, 5, 6, 7]
    assert line_dedup.covered_lines(list("oABCq"), list("zABCxABCv")) == [1, 2, 3]
    assert line_dedup.covered_lines(list("oABCyABCq"), list("zABCxABCv")) == [1, 2, 3, 5, 6, 7]
    assert line_dedup.covered_lines(["o", "", "A", "", "q"], ["z", "", "A", "", "x", "", "A", "v"]) == [2]
    assert len(line_dedup.covered_lines(["o"] + ["A"] * 20_000 + ["q"], ["z", "A", "x", "A", "v"])) == 20_000


def test_passages_that_many_share(spark):
    """Earlier documents hold single lines of a passage; the short lines between them must not save it."""
    rng = random.Random(16)
    long = [words(rng, 20) for _ in range(3)]
    passage = "\n".join([long[0], "Of.", long[1], "Be.", long[2]])
    texts = [*long, *(f"own words of {i}\n{passage}\nand the end {i}" for i in range(6))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == texts[:4]
    assert all(got[i] == f"own words of {i - 3}\nand the end {i - 3}" for i in range(4, 9))


def test_passages_of_short_lines(spark):
    verse = "\n".join(f"so{i} on{i}" if i % 2 else f"and{i}\n" for i in range(40))  # 60 words, no line of four
    texts = [f"first text\n{verse}\nends", *(f"other text {i}\n{verse}\nstops {i}" for i in range(5)), "so1 on1\nand2\nso3 on3"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_frame(spark, texts)).collect()}
    assert got[0] == texts[0] and got[6] == texts[6]
    assert all(got[i + 1] == f"other text {i}\nstops {i}" for i in range(5))


def test_line_dedup(spark, sf):
    rng = random.Random(6)
    passage = "\n".join(words(rng, 20) for _ in range(3))  # 60 words
    short = "a short line of six words"
    texts = [None, "", passage, short, f"{words(rng, 9)}\n{passage}\n{words(rng, 9)}", f"{short}\n{words(rng, 40)}", f"{passage}\n\n{passage}", short, "Of.\nBe."] + [f"{words(rng, 12)}\n{passage}\nOf.\n{words(rng, 7)}" for _ in range(30)]
    frame = docs_frame(spark, texts).selectExpr("*", "cast(doc_id as int) AS n_chars")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame, n_chars="n_chars").collect()}
    want = brute_lines(list(enumerate(texts)))
    assert {i: r["text"] for i, r in got.items()} == want
    assert passage in got[2]["text"] and all(passage not in (r["text"] or "") for i, r in got.items() if i > 2)
    assert got[3]["text"] == got[7]["text"] == short and got[8]["text"] == "Of.\nBe."
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values()) and got[4]["key"] == "k"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table).collect()} == brute_lines(rows)
    empty = line_dedup.dedup_lines(docs_frame(spark, []))
    assert empty.count() == 0 and empty.columns == docs_frame(spark, []).columns
    twice = line_dedup.dedup_lines(docs_frame(spark, [passage, passage, passage, passage], [1, 1, 2, None])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in twice) == sorted([(1, passage), (1, passage), (2, ""), (0, passage)])


# op 8


def test_bpe(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.default_path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBPE(ranks)
    assert all(own.merge(b) == (i,) for b, i in ranks.items())  # the joining rule rests on this
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "th", "ing", " ", "\n", "é", "日", "1", "!", "aaaa", "=-"]) for _ in range(rng.randint(0, 80))) for _ in range(800)] + [t or "" for t in ODD]
    for t, (ids, data) in zip(texts, bpe.encode_decode(texts)):
        assert ids == " ".join(map(str, other.encode_ordinary(t))) and data == t.encode()
    long = "".join(rng.choice("abcdefghij") for _ in range(5000)).encode()
    assert own.encode(long) == own.merge(long) and own.decode(own.encode(long)) == long
    got = bpe.digests(docs_frame(spark, ODD)).collect()
    for r in got:
        ids = other.encode_ordinary(ODD[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((ODD[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.encode_documents(docs_frame(spark, [])).count() == 0


# op 9


def brute_simhash(rows, shingle=3, radius=3):
    import xxhash

    prints = {}
    for i, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        grams = [b" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {(i, f"{prints[i]:016x}", find(i)) for i in ids}


def test_simhash(spark):
    rng = random.Random(10)
    base = [words(rng, 120) for _ in range(12)]
    texts = list(ODD[:12])
    for b in base:
        w = b.split()
        for _ in range(10):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [base[0]] * 40 + ["", None, "two words"]
    got = {tuple(r) for r in simhash.simhash_groups(docs_frame(spark, texts)).collect()}
    assert got == brute_simhash(list(enumerate(texts)))
    assert simhash.simhash_groups(docs_frame(spark, [])).count() == 0
    odd = simhash.simhash_groups(docs_frame(spark, ["q w e r", "q w e r", "q w e r"], [4, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in odd) == [(-1, -1), (4, 4), (4, 4)]


@pytest.mark.parametrize("radius,segments", [(3, 2), (1, 2), (7, 4), (5, 2), (3, 4)])
def test_every_link_is_found(spark, radius, segments):
    rng = random.Random(radius)
    prints = []
    for _ in range(40):
        p = rng.getrandbits(64)
        prints.append(p)
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randint(0, radius + 1)):
                q ^= 1 << b
            prints.append(q)
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "rep long, f0 long")
    found = {r["node"]: r["component"] for r in components.connected_components(simhash.link_edges(frame, radius, segments)).collect()}
    root = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    assert [found.get(i, i) for i in range(len(prints))] == root


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 201)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


def test_near_duplicates_at_stage_settings(spark):
    rng = random.Random(12)
    texts, want = [], []
    for g in range(30):
        w = words(rng, 300).split()
        for c in range(3):
            v = list(w)
            for k in rng.sample(range(300), 2 * c):
                v[k] = f"new{k}"
            texts.append(" ".join(v))
            want.append(3 * g)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs_frame(spark, texts)).collect()}
    hit = sum(got[i] == w for i, w in enumerate(want))
    assert hit >= 0.95 * len(want) and all(got[i] >= w for i, w in enumerate(want))


def test_pairs_at_exactly_the_similarity(spark):
    """900 shingles each, 800 in common: Jaccard 0.8. Every such group of two is found."""
    texts = []
    for g in range(150):
        w = [f"g{g}w{k}" for k in range(904)]
        texts += [" ".join(w), " ".join(w[:804] + [f"n{g}x{k}" for k in range(100)])]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    assert all(100 * len(np.intersect1d(a, b)) == 80 * len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs_frame(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_links_are_verified(spark):
    """Below the similarity nothing is linked, whatever the distance of the fingerprints; and every link of a crowd is found."""
    rng = random.Random(14)
    texts = []
    for g in range(60):
        w = [f"g{g}w{k}" for k in range(904)]
        texts += [" ".join(w), " ".join(w[:774] + [f"n{g}x{k}" for k in range(130)])]  # 770 of 1030: 0.748
    texts += [f"{'spam ' * 200}{words(rng, 40)}" for _ in range(10)]
    base = words(rng, 120).split()
    for _ in range(60):
        v = list(base)
        for k in rng.sample(range(120), 3):
            v[k] = f"c{rng.random()}"
        texts.append(" ".join(v))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == root and root[:130] == list(range(130))



def jaccard_roots(texts, shingle=5):
    sets = [set(simhash.shingle_set(t, shingle).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    return root


def crowd(rng, n, changes=4):
    """Texts of 300 words that are all near, most of them just below the similarity, some linked."""
    base, texts = words(rng, 300).split(), []
    for _ in range(n):
        v = list(base)
        for k in rng.sample(range(300), changes):
            v[k] = f"c{rng.random()}"
        texts.append(" ".join(v))
    return texts


def test_a_crowd_that_is_not_linked_sends_few_rows(spark, monkeypatch):
    """What buckets send is bounded by what they get, not by its pairs, and no link is lost."""
    rng = random.Random(21)
    texts = crowd(rng, 150, 5) + crowd(rng, 10, 2)
    made, plain = {}, simhash.materialize

    def counted(df, tag="step"):
        table = plain(df, tag)
        made[tag] = made.get(tag, 0) + table.count()
        if tag == "reps":
            made["visits"] = sum(len(r["keys"]) for r in table.collect())
        return table

    monkeypatch.setattr(simhash, "materialize", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs_frame(spark, texts)).collect()}
    root = jaccard_roots(texts)
    assert [got[i] for i in range(len(texts))] == root and 140 < len(set(root)) < len(texts)
    assert made["named"] <= (simhash.NAMED + 1) * made["visits"] and made["crowd"] <= made["visits"] and made["links"] <= made["visits"]


@pytest.mark.parametrize("held,earlier,seen", [(700, 64, 4), (1, 0, 1), (10**6, 3, 1)])
def test_a_crowd_in_blocks(spark, monkeypatch, held, earlier, seen):
    """Blocks of a few sets, and any number of earlier buckets told, give the same groups."""
    for name, value in (("HELD_MEMBERS", held), ("EARLIER", earlier), ("SEEN_WORDS", seen), ("NAMED", 1)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(held)
    texts = crowd(rng, 40) + crowd(rng, 25, 3) + crowd(rng, 12, 5) + ["short", ""]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == jaccard_roots(texts)



def test_free_memory_is_given_back():
    def run(batches):
        for x in batches:
            yield 2 * x

    some = common.gives_back(run)
    assert list(some(iter([1, 2]))) == [2, 4] and list(some(iter([]))) == [] and some.__name__ == "run"


# ops 2 and 10


def labelled(spark, sf, label, modulus, held_out):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r[label]) for r in docs.join(labels, "doc_id").collect()]
    return docs, labels, {i: y for i, _, y in rows if zlib.crc32(str(i).encode()) % modulus == held_out}


def area(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels, held = labelled(spark, sf, "quality", 4, 2)
    got = queries.op10_quality(spark, sf).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    scores = dict(zip(got.doc_id, got.score))
    assert area([(scores[i], y) for i, y in held.items()]) > 0.97
    assert np.mean([(scores[i] >= 0.7) == bool(y) for i, y in held.items()]) > 0.95


def test_quality_field_is_exact():
    """Marginals against the sum over all labellings."""
    from itertools import product

    rng = np.random.default_rng(1)
    n_lines = np.array([1, 4, 2])
    theta, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    good, pairs, whole = quality.marginals(theta, trans, n_lines)
    at, total = 0, np.zeros((2, 2))
    for n, log_sum in zip(n_lines, whole):
        z, p = 0.0, np.zeros(n)
        t = np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(theta[at + i] * v for i, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:]):
                t[a, b] += w
        assert np.allclose(p / z, good[at : at + n]) and np.isclose(np.log(z), log_sum)
        total += t / z
        at += n
    assert np.allclose(total, pairs)


def test_quality_field_of_long_documents():
    """The scan in blocks against one line after another."""
    rng = np.random.default_rng(7)
    n_lines = np.array([1, 33, 1500, 64, 2, 32])
    theta, trans = rng.normal(size=n_lines.sum()) * 3, rng.normal(size=(2, 2))
    good, _, whole = quality.marginals(theta, trans, n_lines)
    at = 0
    for n, log_sum in zip(n_lines, whole):
        own = theta[at : at + n]
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0, 1] = own[0]
        for t in range(1, n):
            a[t] = [np.logaddexp(*(a[t - 1] + trans[:, j])) + j * own[t] for j in (0, 1)]
            b[n - 1 - t] = [np.logaddexp(trans[i, 0] + b[n - t, 0], trans[i, 1] + b[n - t, 1] + own[n - t]) for i in (0, 1)]
        z = np.logaddexp(*a[-1])
        assert np.isclose(z, log_sum) and np.allclose(np.exp(a[:, 1] + b[:, 1] - z), good[at : at + n])
        at += n


def test_quality_gradient():
    rng = np.random.default_rng(8)
    n_lines = np.array([3, 1, 40, 7])
    x, y = rng.normal(size=(n_lines.sum(), 5)), np.array([1.0, 0, 0, 1])
    params = rng.normal(size=9) * 0.5
    _, grad = quality.likelihood(params, x, y, n_lines, 0.01)
    for i in range(len(params)):
        up, down = params.copy(), params.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((quality.likelihood(up, x, y, n_lines, 0.01)[0] - quality.likelihood(down, x, y, n_lines, 0.01)[0]) / 2e-5 - grad[i]) < 1e-6


def test_quality_of_very_many_lines():
    import time

    model = quality.fit([(f"good line {i}, as they go.\nand more of it.", 1) for i in range(20)] + [(f"!!! {i} ||| ###\n|||", 0) for i in range(20)], steps=20)
    began = time.process_time()
    got = quality.document_scores(model[:2], ["\n" * 200_000, "a\n" * 100_000], model[2])
    assert len(got) == 2 and time.process_time() - began < 8


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels, held = labelled(spark, sf, "toxic", 5, 0)
    got = queries.op2_toxicity(spark, sf).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    scores = dict(zip(got.doc_id, got.score))
    assert area([(scores[i], y) for i, y in held.items()]) > 0.75  # a few dozen toxic labels


def test_toxicity_gradients():
    """Back-propagation against differences."""
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in toxicity.init(3).items()}
    x = rng.normal(size=(5, 3, 6 * toxicity.HIDDEN)) * 0.5
    mask = np.arange(5)[:, None] < np.array([5, 3, 1])[None]
    y = np.array([1.0, 0, 1])
    loss = lambda q, x: float(np.sum(np.log1p(np.exp(-(2 * y - 1) * toxicity.forward(q, x, mask)))))
    logit, saved = toxicity.forward(p, x, mask, True)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dx = toxicity._backward(p, g, toxicity._sigmoid(logit) - y, mask, saved)
    for name in ("uf", "ub", "wa", "va", "wo", "bo", "ba"):
        i = tuple(rng.integers(0, s) for s in p[name].shape)
        q = {k: v.copy() for k, v in p.items()}
        q[name][i] += 1e-2
        up = loss(q, x)
        q[name][i] -= 2e-2
        assert abs((up - loss(q, x)) / 2e-2 - g[name][i]) < 2e-3, name
    for _ in range(5):
        i = tuple(rng.integers(0, s) for s in x.shape)
        a, b = x.copy(), x.copy()
        a[i] += 1e-2
        b[i] -= 1e-2
        assert abs((loss(p, a) - loss(p, b)) / 2e-2 - dx[i]) < 2e-3


def test_windows_cover_all_words():
    for n in (0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 100, 1003):
        starts = toxicity.windows_of(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
        assert all(b - a <= toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_long_words_are_read_whole():
    rng = random.Random(18)
    for sep in ("", ".", "_", "\U0001f600"):
        long = sep.join(rng.choice(["abc", "日本語", "défg", "xyz1"]) for _ in range(3000))
        got = toxicity.words_of(f"{long} end")
        assert max(len(w.encode()) for w in got) <= 80 and got[-1] == "end" and set("".join(got[:-1])) == set(long)
        bare = [w for w in got[:-1] if len(w) > 2]
        assert {long[i : i + 3] for i in range(len(long) - 2) if long[i : i + 3].isalnum()} <= {w[i : i + 3] for w in bare for i in range(len(w) - 2)}
    assert toxicity.words_of("a" * 78) == ["a" * 78] and toxicity.words_of("." * 100) and toxicity.words_of(" \n") == []
    rows = [(f"{'bad awful ' * 3}{i} word", 1) for i in range(30)] + [(f"nice fine {i} word", 0) for i in range(30)]
    scorer = toxicity.Scorer(toxicity.fit(rows, epochs=10))
    clean = ["nice", "fine", "word"] * 600
    for at in (100, 777, 1500):
        joined = [".".join(clean), ".".join([*clean[:at], *["bad", "awful"] * 8, *clean[at:]])]
        low, high = scorer.scores(joined)
        assert low < 0.5 < high


def test_scores_of_odd_texts(spark):
    rows = [(f"{'bad awful ' * 3}{i} word", 1) for i in range(30)] + [(f"nice fine {i} word", 0) for i in range(30)]
    frame = docs_frame(spark, [*ODD, "bad awful"], [*range(len(ODD)), None])
    for module, model in ((toxicity, toxicity.fit(rows, epochs=3)), (quality, quality.fit(rows, steps=10)), (toxicity, None), (quality, None)):
        got = module.score(frame, model).toPandas()
        assert len(got) == len(ODD) + 1 and got.score.between(0, 1).all() and got.held_out.notna().all()
        assert module.score(docs_frame(spark, []), model).count() == 0
    assert toxicity.fit([]) is None and quality.fit([("a", 1)]) is None
    for kept in (toxicity.keep_clean(frame, None), quality.keep_good(frame, None)):
        assert kept.columns == frame.columns and kept.count() == frame.count()


def test_the_collector_waits_while_texts_are_encoded(monkeypatch):
    import gc

    seen = []
    monkeypatch.setattr(tokens.Library, "ids", lambda self, texts: seen.append(gc.isenabled()) or [b""] * len(texts))
    assert tokens.token_bytes(["a"], tokens.default_path()) == [b""] and seen == [False] and gc.isenabled()
