"""Operators and stages against plain versions that share no code with them."""

import random
import zlib

import pytest

pytest.importorskip("edgeloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import numpy as np

from edgeloom.llm import common, components, html_text, line_dedup, quality, simhash, toxicity
from edgeloom.llm.common import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `row` string, gone long, d string, score double"


# op 2: one word, one gate, one window at a time


def plain_toxicity(model, text):
    p, slope, offset = model
    sig = lambda x: 1 / (1 + np.exp(-x))
    e, h = p["word"].shape[1], p["uf"].shape[0]

    def inputs(word):
        w = word.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())).lower() or word
        raw = f"<{w}>".encode()
        grams = [raw[i : i + 3] for i in range(len(raw) - 2)]
        x = np.concatenate([p["word"][zlib.crc32(raw) % len(p["word"])], np.mean([p["gram"][zlib.crc32(g) % len(p["gram"])] for g in grams], axis=0)])
        assert len(x) == 2 * e
        return x @ p["wx"] + p["bx"]

    def layer(xs, u):
        state, out = np.zeros(h), []
        for x in xs:
            g = state @ u
            z, r = sig(x[:h] + g[:h]), sig(x[h : 2 * h] + g[h : 2 * h])
            c = np.tanh(x[2 * h :] + r * g[2 * h :])
            state = (1 - z) * c + z * state
            out.append(state)
        return out

    words = text.split()
    starts = [0] if len(words) <= 24 else [*range(0, len(words) - 24, 12), len(words) - 24]
    best = -np.inf
    for s in starts:
        xs = [inputs(w) for w in words[s : s + 24]]
        states = [np.concatenate(x) for x in zip(layer([x[: 3 * h] for x in xs], p["uf"]), layer([x[3 * h :] for x in xs][::-1], p["ub"])[::-1])]
        weights = np.exp([float(np.tanh(x @ p["wa"] + p["ba"]) @ p["va"][:, 0]) for x in states])
        pooled = sum(w * x for w, x in zip(weights / weights.sum(), states))
        best = max(best, float(pooled @ p["wo"][:, 0] + p["bo"][0]))
    return sig(slope * best + offset)


def test_toxicity_scores():
    rng = random.Random(1)
    common = ["nice", "fine", "word", "day", "Sun,", "(rain)", "so-so", "x1", "été"]
    rows = [(" ".join(rng.choice([*common, "awful", "bad!"]) for _ in range(20)), 1) for _ in range(30)] + [(" ".join(rng.choice(common) for _ in range(20)), 0) for _ in range(30)]
    model = toxicity.fit(rows, epochs=3)
    texts = [" ".join(rng.choice([*common, "awful"]) for _ in range(n)) for n in (1, 5, 24, 25, 36, 37, 100)]
    assert np.allclose(toxicity.Scorer(model).scores(texts), [plain_toxicity(model, t) for t in texts], atol=1e-4)


# op 10: features of a line by characters, marginals by one step after another


def plain_features(line):
    marks = ".,;:?'\"()-"
    kind = lambda b: "space" if chr(b) in " \t\x0b\x0c\r" else "letter" if b >= 128 or "a" <= chr(b) <= "z" else "upper" if "A" <= chr(b) <= "Z" else "digit" if "0" <= chr(b) <= "9" else "mark" if chr(b) in marks else "shout" if chr(b) == "!" else "bar" if chr(b) == "|" else "odd"
    raw = line.encode()
    n = {k: sum(kind(b) == k for b in raw) for k in ("space", "letter", "upper", "digit", "mark", "shout", "bar", "odd")}
    words = raw.split()
    solid, w = max(1, len(raw) - n["space"]), max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    return [
        1, np.log1p(len(words)) / 4, min(solid / w, 20) / 10, n["letter"] / solid, n["upper"] / solid, n["digit"] / solid, 4 * n["mark"] / solid, min(8 * n["shout"] / solid, 4),
        min(8 * n["bar"] / solid, 4), min(8 * n["odd"] / solid, 4), again / w, not words, n["space"] / max(1, len(raw)), 0 < len(words) < 4,
    ]


def plain_quality(model, text):
    w, trans, (slope, offset) = model
    lines = text.split("\n")
    x = np.array([plain_features(s) for s in lines], float)
    none = np.zeros((1, x.shape[1]))
    theta = np.concatenate([x, np.concatenate([none, x[:-1]]), np.concatenate([x[1:], none])], 1) @ w
    n = len(lines)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0, 1] = theta[0]
    for t in range(1, n):
        a[t] = [np.logaddexp(*(a[t - 1] + trans[:, j])) + j * theta[t] for j in (0, 1)]
        b[n - 1 - t] = [np.logaddexp(trans[i, 0] + b[n - t, 0], trans[i, 1] + b[n - t, 1] + theta[n - t]) for i in (0, 1)]
    good = np.exp(a[:, 1] + b[:, 1] - np.logaddexp(*a[-1]))
    weight = np.array([len(s.encode()) + 1 for s in lines])
    raw = np.clip((good * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(slope * np.log(raw / (1 - raw)) + offset)))


def test_quality_of_many_lines_is_held_as_few_numbers(monkeypatch):
    import tracemalloc

    texts = ["\n" * 300_000, "", "One line.\n\nTwo two | three", "x" * 5000 + "\n"]
    model = (np.linspace(-1, 1, 3 * quality.BASE), np.array([[0.3, -0.2], [0.1, 0.4]]))
    tracemalloc.start()
    got = quality.document_scores(model, texts, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000 * 400  # its features and its neighbours' alone take 336 bytes a line, with copies 681
    whole = quality.line_features(texts[1:])
    monkeypatch.setattr(quality, "PIECE", 7)
    assert np.allclose(quality.document_scores(model, texts[1:], None), got[1:])
    assert all((a == b).all() for a, b in zip(quality.line_features(texts[1:]), whole))
    theta, _, n_lines = quality.line_scores(texts[1:], model[0])
    assert np.allclose(theta, quality.with_neighbours(whole[0], n_lines) @ model[0])


def test_quality_scores():
    rng = random.Random(2)
    line = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    good, bad = ["The", "sun", "is", "out,", "today.", "été", "x"], ["|", "!!!", "BUY", "NOW", "100%", "###", "sun", "sun"]
    rows = [("\n".join(line(good) for _ in range(rng.randint(1, 6))), 1) for _ in range(40)] + [("\n".join(line(bad) for _ in range(rng.randint(1, 6))), 0) for _ in range(40)]
    model = quality.fit(rows, steps=30)
    texts = ["", "\n\n", " a\tb  ", *("\n".join(line(good + bad) for _ in range(n)) for n in (1, 2, 3, 31, 32, 33, 70, 200))]
    got = quality.document_scores(model[:2], texts, model[2])
    assert np.allclose(got, [plain_quality(model, t) for t in texts], atol=1e-6)


# op 3: articles put into pages by hand


def test_html_of_made_pages():
    rng = random.Random(3)
    sentence = lambda n: " ".join(rng.choice(["some", "words", "of", "text", "here", "più", "日本"]) for _ in range(n)) + rng.choice([".", "!", ", so."])
    for _ in range(150):
        blocks = [(rng.choice(["h1", "h2"]), sentence(3))] + [("p", " ".join(sentence(rng.randint(2, 15)) for _ in range(rng.randint(1, 6)))) for _ in range(rng.randint(2, 8))]
        if rng.random() < 0.5:
            blocks.insert(rng.randint(1, len(blocks)), ("blockquote", sentence(9)))
        mark = lambda t: t.replace(*rng.choice([("words", "<b>words</b>"), ("words", "<a href='#'>words</a>"), (" ", "\n \t"), ("words", "&#119;ords")]), 1)
        body = "".join(f"<{tag}>{mark(t)}</{tag}>" for tag, t in blocks)
        noise = [
            '<nav><ul><li><a href="/x">Home, sweet home.</a></li></ul></nav>', f'<div class="ad">{sentence(8)}</div>', f'<div id="sidebar"><p>{sentence(9)}</p></div>', f"<aside>{sentence(12)}</aside>",
            f"<form><label>{sentence(5)}</label></form>", f'<div class="cookie-notice">{sentence(7)}</div>', "<script>if (a < b) { x('</p>'); }</script>", "<style>p{a:b}</style>", f"<!-- {sentence(3)} -->",
        ]
        rng.shuffle(noise)
        tag = rng.choice(["article", "main", 'div class="story"'])
        page = f'<!DOCTYPE html><html><head><title>T</title></head><body><header>{sentence(4)}</header>{"".join(noise[:4])}<{tag}>{body}</{tag.split()[0]}>{"".join(noise[4:])}<div class="comments"><p>{sentence(14)}</p></div><footer>&copy; {sentence(4)}</footer></body></html>'
        assert html_text.main_text(page).split("\n\n") == [" ".join(t.split()) for _, t in blocks]


# op 7: what must go and what must stay, by windows of lines


def held_runs(text, least):
    """Shortest runs of lines from each line on with that many words, as tuples; with the positions of their lines."""
    lines = [(i, s.strip()) for i, s in enumerate(text.split("\n")) if s.strip()]
    out = []
    for a in range(len(lines)):
        total = 0
        for b in range(a, len(lines)):
            total += len(lines[b][1].split())
            if total >= least:
                out.append((tuple(s for _, s in lines[a : b + 1]), [i for i, _ in lines[a : b + 1]]))
                break
    return out


def kept_positions(before, after):
    """Positions of ``before``'s lines that ``after`` keeps: greedy is right, as only whole lines go."""
    lines, kept, j = after.split("\n"), [], 0
    for i, s in enumerate(before.split("\n")):
        if j < len(lines) and lines[j] == s:
            kept.append(i)
            j += 1
    assert j == len(lines) or after == ""
    return set(kept)


def check_lines(rows, got, least=line_dedup.MIN_WORDS):
    seen_runs, seen_lines = set(), set()
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        kept = kept_positions(text, got[i])
        lines = text.split("\n")
        for run, at in held_runs(text, least):
            assert run not in seen_runs or not kept.issuperset(at), (i, run)
        gone = [lines[k] for k in range(len(lines)) if k not in kept]
        assert all(not s.strip() or s.strip() in seen_lines for s in gone), i
        if not any(run in seen_runs for run, _ in held_runs(text, least)):
            assert sum(len(s.split()) for s in gone) == 0 or any(s.strip() in seen_lines for s in lines)
        seen_runs |= {run for run, _ in held_runs(text, least)}
        seen_lines |= {s.strip() for s in lines}


def test_lines_of_made_documents(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 6, 12, 25]))) for _ in range(60)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 12))] for _ in range(8)]
    texts = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(1, 5)):
            lines += rng.choice([rng.choice(passages), [rng.choice(pool)], [f"own {d} {rng.random()}"], [""]])
        texts.append("\n".join(lines))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    check_lines(list(enumerate(texts)), got)
    assert sum(got[i] != t for i, t in enumerate(texts)) > 20


def test_lines_of_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    check_lines(rows, {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table).collect()})


# the pipeline's stages as stages


ODD = [
    (0, None), (1, ""), (2, "plain words, as they go, of a text that nobody minds."), (2, "plain words, as they go, of a text that nobody minds."), (3, "plain words, as they go, of a text that nobody minds."),
    (None, "plain words, as they go, of a text that nobody minds."), (None, None), (4, "word " * 20_000), (5, "x" * 50_000), (6, "\n" * 3000), (7, "日本語 テキスト"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of odd rows, with extra columns; labels of one kind only."""
    base = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, None, "s", None, "r", 1, "d", 0.5) for i, t in ODD], COLUMNS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages_of_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"])[:50]) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0
        got = materialize(stage(spark, docs, folder), name)
        rows = got.collect()
        if name == "packing":
            assert len(rows) == len(ODD) + sum(r["piece"] > 0 for r in rows) and sum(r["doc_id"] is None for r in rows) == 2
            continue
        assert got.columns == docs.columns == empty.columns and all(r["row"] == "r" and r["gone"] == 1 and r["d"] == "d" and r["score"] == 0.5 for r in rows)
        if name in ("toxicity", "quality", "line_dedup"):  # no labels of both kinds: all stay; no passage of 30 words repeats
            assert key(rows) == key(docs.collect())
        else:  # of the copies 2, 2, 3 the rows of the smallest id stay, and those without an id; 0, 1 and 6 have no words
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(["0", "2", "2", "None", "None", "4", "5", "7"])
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_filter_stages_by_plain_scores(spark):
    """The filters keep exactly the rows that the plain versions score on the right side."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    short = {i: t for i, t in texts.items() if t.strip() and len(t) < 3000 and t.isascii() and "_" not in t and max(map(len, t.split())) < 40}
    tox, good = toxicity.fit_tables(docs, labels), quality.fit_tables(docs, labels)
    for name, plain in (("toxicity", {i: plain_toxicity(tox, t) < 0.5 for i, t in short.items()}), ("quality", {i: plain_quality(good, t) >= 0.7 for i, t in texts.items()})):
        kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)[name](spark, docs, sf).collect()}
        assert len(plain) > 20 and {i: i in kept for i in plain} == plain


def jaccard_groups(rows):
    low = {i: (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in low.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] == sets[b] or (min(len(sets[a]), len(sets[b])) * 10 >= 8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_copies_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    groups = jaccard_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, sf).collect()}
    assert kept == {i for i, g in groups.items() if i == g} and len(kept) < len(groups)


def test_hot_keys_change_nothing(spark, monkeypatch):
    """Broadcasts of hot lines, hubs and fingerprints, and copies of busy first holders, give the same rows."""
    rng = random.Random(5)
    passage = "\n".join(" ".join(f"w{rng.randint(0, 99)}" for _ in range(15)) for _ in range(3))
    texts = [f"own {i} words\n{passage if i % 3 else 'none'}\n{'the same ' * (i % 5)}" for i in range(90)] + ["a copy of this, often"] * 40
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)], "u long, v long")

    def results():
        lines = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
        prints = {tuple(r) for r in simhash.simhash_groups(frame).collect()}
        near = {tuple(r) for r in simhash.near_duplicate_groups(frame).collect()}
        return lines, prints, near, {tuple(r) for r in components.connected_components(edges).collect()}

    plain = results()
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    monkeypatch.setattr(components, "HOT_ROWS", 8)
    assert results() == plain and len(plain[0]) == len(texts)
    check_lines(list(enumerate(texts)), plain[0])


def test_no_folder_is_an_error_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)
