"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input is its hashed word embedding and the mean of the embeddings of its character trigrams; a long run
without white space counts as several words, which cover all of it. A window of
words runs through a forward and a backward gated recurrent layer; attention pools the states, and a logistic unit
scores the window. Windows of ``WINDOW`` words overlap by half and cover the whole text; a text's score is that of
its highest window.

Training takes labelled texts: a clean text's windows are all clean, a toxic text's highest window is toxic. The
first such windows come from word counts, later ones from the network itself, along with the clean windows it
scores highest.

Defined cases: null and empty texts are one empty window; null or repeated ids keep their rows; other columns are
ignored; an empty table gives an empty result; without both labels every score is 0.5 and ``keep_clean`` keeps all rows.
"""

from __future__ import annotations

import re
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, labelled_sample, remainder, ship_package, slices

#: labelled rows used for fitting, at most
FIT_ROWS = 3000
THRESHOLD = 0.5
MODULUS, HELD_OUT = 5, 0
WINDOW, STRIDE = 24, 12
WORD_ROWS, GRAM_ROWS, EMBED, HIDDEN, ATTEND = 1 << 14, 1 << 12, 12, 10, 8
#: bytes up to which a run without white space is one word; characters of the pieces of longer ones, and how many two share
LONGEST_WORD, PIECE, SHARED = 78, 18, 2
MEMORY = 150_000
LEAST_STEPS = 300
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_PART = re.compile(r"[^\W_]+[\W_]*|[\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text. Longer runs without white space count as several: cut after marks, then into pieces that
    share two characters, so that no character and no trigram of a piece is left out."""
    out = []
    for w in text.split():
        if len(w) * 4 <= LONGEST_WORD or len(w.encode("utf-8", "surrogatepass")) <= LONGEST_WORD:
            out.append(w)
            continue
        for part in _PART.findall(w):
            out += [part[i : i + PIECE] for i in range(0, max(1, len(part) - SHARED), PIECE - SHARED)]
    return out


def _features(word: str) -> tuple[int, list[int]]:
    """(word row, trigram rows) of a word, without the marks around it and its case."""
    w = _EDGE.sub("", word).lower() or word
    raw = ("<" + w + ">").encode("utf-8", "surrogatepass")
    grams = [raw[i : i + 3] for i in range(max(1, len(raw) - 2))]
    return zlib.crc32(raw) % WORD_ROWS, [zlib.crc32(g) % GRAM_ROWS for g in grams]


def windows_of(n: int) -> list[int]:
    """First words of the windows over n words."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def init(seed: int = 11) -> dict:
    import numpy as np

    r = np.random.default_rng(seed)
    g = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[0] if len(s) > 1 and s[0] < 100 else 1)).astype(np.float32)
    return {
        "word": g(WORD_ROWS, EMBED), "gram": g(GRAM_ROWS, EMBED), "wx": g(2 * EMBED, 6 * HIDDEN) * 2, "bx": np.zeros(6 * HIDDEN, np.float32),
        "uf": g(HIDDEN, 3 * HIDDEN), "ub": g(HIDDEN, 3 * HIDDEN), "wa": g(2 * HIDDEN, ATTEND) * 2, "ba": np.zeros(ATTEND, np.float32), "va": g(ATTEND, 1),
        "wo": g(2 * HIDDEN, 1) * 2, "bo": np.array([-2.0], np.float32),
    }


def _sigmoid(x):
    import numpy as np

    return 0.5 * np.tanh(0.5 * x) + 0.5


def _layer(x, u, mask, reverse: bool, keep: bool):
    """States (time, windows, HIDDEN) of one direction; with ``keep`` what the backward pass needs."""
    import numpy as np

    steps, n, _ = x.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    kept = [None] * steps
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        g = h @ u
        zr = _sigmoid(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        c = np.tanh(x[t, :, 2 * HIDDEN :] + r * gn)
        new = c + z * (h - c)
        m = mask[t][:, None]
        if keep:
            kept[t] = (h, z, r, gn, c, m)
        h = new if m.all() else np.where(m, new, h)
        out[t] = h
    return out, kept


def forward(p: dict, x, mask, keep: bool = False):
    """Logit of each window: x (time, windows, 6 * HIDDEN) are the projected inputs, mask says where words are."""
    import numpy as np

    hf, kf = _layer(x[:, :, : 3 * HIDDEN], p["uf"], mask, False, keep)
    hb, kb = _layer(x[:, :, 3 * HIDDEN :], p["ub"], mask, True, keep)
    h = np.concatenate([hf, hb], 2)
    a = np.tanh(h @ p["wa"] + p["ba"])
    e = (a @ p["va"])[:, :, 0]
    e = np.where(mask, e, -1e9)
    w = np.exp(e - e.max(0)) * mask
    w /= np.maximum(w.sum(0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", w, h)
    logit = (pooled @ p["wo"])[:, 0] + p["bo"][0]
    return (logit, (kf, kb, h, a, w, pooled)) if keep else logit


def _backward(p: dict, grads: dict, dlogit, mask, saved):
    """Adds to ``grads``; returns the gradient of the projected inputs."""
    import numpy as np

    kf, kb, h, a, w, pooled = saved
    grads["wo"] += pooled.T @ dlogit[:, None]
    grads["bo"] += dlogit.sum()
    dpool = dlogit[:, None] * p["wo"][:, 0]
    dw = np.einsum("nh,tnh->tn", dpool, h)
    de = w * (dw - (w * dw).sum(0))
    dh = w[:, :, None] * dpool[None]
    da = de[:, :, None] * p["va"][:, 0] * (1 - a * a)
    grads["va"] += np.einsum("tn,tnk->k", de, a)[:, None]
    flat = da.reshape(-1, ATTEND)
    grads["wa"] += h.reshape(-1, 2 * HIDDEN).T @ flat
    grads["ba"] += flat.sum(0)
    dh += da @ p["wa"].T
    dx = np.zeros((*mask.shape, 6 * HIDDEN), np.float32)
    for name, kept, lo, order in (("uf", kf, 0, range(len(kf) - 1, -1, -1)), ("ub", kb, HIDDEN, range(len(kb)))):
        carry = np.zeros((mask.shape[1], HIDDEN), np.float32)
        for t in order:
            before, z, r, gn, c, m = kept[t]
            total = dh[t, :, lo : lo + HIDDEN] + carry
            d = np.where(m, total, 0)
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (before - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], 1)
            grads[name] += before.T @ dg
            dx[t, :, 3 * lo : 3 * lo + 3 * HIDDEN] = np.concatenate([dz, dr, dc], 1)
            carry = np.where(m, d * z + dg @ p[name].T, total)
    return dx


class _Vocabulary:
    """Words met so far, as rows of flat feature arrays; row 0 is padding."""

    def __init__(self):
        self.row, self.words, self.grams, self.ends = {"": 0}, array("i", [0]), array("i", [0]), array("q", [1])

    def rows(self, words: list[str]):
        import numpy as np

        row = self.row
        for w in set(words).difference(row):
            row[w] = len(self.words)
            a, b = _features(w)
            self.words.append(a)
            self.grams.extend(b)
            self.ends.append(len(self.grams))
        return np.fromiter(map(row.__getitem__, words), np.int32, len(words))

    def arrays(self, since: int = 0):
        """(word rows, trigram rows of all words in turn, how many each word has)."""
        import numpy as np

        ends = np.array(self.ends[max(since - 1, 0) :], np.int64)
        begin = int(ends[0]) if since else 0
        counts = np.diff(ends) if since else np.diff(ends, prepend=0)
        return np.array(self.words[since:], np.int32), np.array(self.grams[begin:], np.int32), counts


def _inputs(p: dict, words, grams, counts):
    import numpy as np

    out = np.empty((len(words), 2 * EMBED), np.float32)
    out[:, :EMBED] = p["word"][words]
    ends = np.cumsum(counts)
    starts = ends - counts
    for i in range(0, len(words), 4096):
        s = starts[i : i + 4096]
        own = p["gram"][grams[s[0] : ends[min(i + 4096, len(words)) - 1]]]
        out[i : i + 4096, EMBED:] = np.add.reduceat(own, s - s[0]) / counts[i : i + 4096, None]
    return out


def _cut(rows):
    """(window rows (windows, WINDOW), number of words in each, first window of each text)."""
    import numpy as np

    starts, sizes, first, at = [], [], [], 0
    for r in rows:
        first.append(len(starts))
        for s in windows_of(len(r)):
            starts.append(at + s)
            sizes.append(min(len(r), WINDOW))
        at += len(r)
    flat = np.concatenate([*rows, np.zeros(WINDOW, np.int32)])
    sizes = np.array(sizes, np.int32)
    idx = flat[np.array(starts, np.int64)[:, None] + np.arange(WINDOW)] if len(starts) else np.zeros((0, WINDOW), np.int32)
    idx[np.arange(WINDOW)[None, :] >= sizes[:, None]] = 0
    return idx, sizes, np.array(first, np.int64)


def _window_logits(p: dict, table, idx, sizes):
    """Logits of windows whose projected inputs are rows of ``table``; full and short windows apart."""
    import numpy as np

    out = np.empty(len(idx), np.float32)
    order = np.argsort(sizes, kind="stable")
    for i in range(0, len(idx), 1024):
        at = order[i : i + 1024]
        steps = max(1, int(sizes[at].max()))
        mask = np.arange(steps)[:, None] < sizes[at][None, :]
        out[at] = forward(p, table[idx[at, :steps].T], mask)
    return out


def fit(rows: list[tuple[str, int]], epochs: int = 10, seed: int = 11):
    """A model (parameters, slope, offset) from (text, 0 or 1) rows; None without both labels."""
    import numpy as np

    y = np.array([v for _, v in rows], np.float32)
    if len(rows) == 0 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    vocabulary = _Vocabulary()
    texts = [vocabulary.rows(words_of(t)) for t, _ in rows]
    words, grams, counts = vocabulary.arrays()
    del vocabulary
    gram_at = np.cumsum(counts) - counts
    idx, sizes, first = _cut(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(idx))))
    # how much likelier each word (its hash row) is in toxic texts: for the first choice of windows only
    hits = [np.zeros(WORD_ROWS), np.zeros(WORD_ROWS)]
    for t, v in zip(texts, y):
        hits[int(v)][np.unique(words[t])] += 1
    odds = np.log((hits[1] + 0.5) / (y.sum() + 1)) - np.log((hits[0] + 0.5) / ((1 - y).sum() + 1))
    odds[(hits[0] + hits[1]) < 5] = 0
    odds[words[0]] = 0
    level = odds[words[idx]].max(1)
    p = init(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    clean = np.flatnonzero(y[owner] == 0)
    # few labels: smaller batches and more rounds, for about as many steps
    size = int(np.clip(5 * y.sum() // 16, 16, 128))
    epochs = max(epochs, min(60, int(LEAST_STEPS * size // (5 * y.sum() + 1))))
    for epoch in range(epochs):
        if epoch in (3 * epochs // 10, 6 * epochs // 10):
            level = _window_logits(p, _inputs(p, words, grams, counts) @ p["wx"] + p["bx"], idx, sizes)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, level)
        top = np.flatnonzero((level == best[owner]) & (y[owner] > 0))
        hard = clean[np.argsort(-level[clean], kind="stable")[: len(top)]]
        chosen = np.concatenate([top, hard, rng.choice(clean, min(len(clean), 3 * len(top)), replace=False)])
        rng.shuffle(chosen)
        for b in range(0, len(chosen), size):
            at = chosen[b : b + size]
            used, place = np.unique(idx[at], return_inverse=True)
            place = place.reshape(len(at), WINDOW).T
            many = counts[used]
            gr = grams[np.repeat(gram_at[used] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            inp = _inputs(p, words[used], gr, many)
            mask = np.arange(WINDOW)[:, None] < sizes[at][None, :]
            logit, saved = forward(p, (inp @ p["wx"] + p["bx"])[place], mask, True)
            g = {k: np.zeros_like(v) for k, v in p.items()}
            dlogit = ((_sigmoid(logit) - y[owner[at]]) / len(at)).astype(np.float32)
            dx = _backward(p, g, dlogit, mask, saved)
            dproj = np.zeros((len(used), 6 * HIDDEN), np.float32)
            np.add.at(dproj, place.ravel(), dx.reshape(-1, 6 * HIDDEN))
            g["wx"] += inp.T @ dproj
            g["bx"] += dproj.sum(0)
            dinp = dproj @ p["wx"].T
            np.add.at(g["word"], words[used], dinp[:, :EMBED])
            np.add.at(g["gram"], gr, np.repeat(dinp[:, EMBED:] / many[:, None].astype(np.float32), many, axis=0))
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] * g[k] - s[k])
                p[k] -= np.float32(0.01) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7)
    logits = _window_logits(p, _inputs(p, words, grams, counts) @ p["wx"] + p["bx"], idx, sizes)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, owner, logits)
    return p, *_calibrate(best, y)


def _calibrate(z, y):
    """Slope and offset that put score 0.5 at the logit that parts the labels with the fewest errors."""
    import numpy as np

    o = np.argsort(z)
    z, y = z[o], y[o]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])  # cut before each position
    k = np.flatnonzero(wrong == wrong.min())
    edge = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gaps = edge[k + 1] - edge[k]
    i = k[gaps.argmax()]
    return 1.0, -float((edge[i] + edge[i + 1]) / 2)


class Scorer:
    """Scores texts with one model; projected inputs of words met before are kept, within a bound."""

    def __init__(self, model):
        self.model, self.vocabulary, self.table = model, _Vocabulary(), None

    def scores(self, texts: list[str]):
        import numpy as np

        if self.model is None:
            return np.full(len(texts), 0.5)
        p, slope, offset = self.model
        if len(self.vocabulary.words) > MEMORY:
            self.vocabulary, self.table = _Vocabulary(), None
        rows = [self.vocabulary.rows(words_of(t)) for t in texts]
        have = 0 if self.table is None else len(self.table)
        if have < len(self.vocabulary.words):
            new = _inputs(p, *self.vocabulary.arrays(have)) @ p["wx"] + p["bx"]
            self.table = new if self.table is None else np.concatenate([self.table, new])
        idx, sizes, first = _cut(rows)
        z = np.maximum.reduceat(_window_logits(p, self.table, idx, sizes), first) if len(first) else np.zeros(0)
        return 1 / (1 + np.exp(-(slope * z.astype(np.float64) + offset)))


def fit_tables(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """A model from at most ``rows`` labelled documents that aren't held out."""
    return fit(labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, rows))


def _with_score(rows: DataFrame, model) -> DataFrame:
    """``rows`` (key, text) as key, score; the key can be of any type."""
    from pyspark.sql import types as T

    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    key = rows.columns[0]

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, rows=256, max_bytes=2 << 20, text=1):
                s = scorer.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=[key, "score"])

    return rows.mapInArrow(gives_back(run), T.StructType([rows.schema.fields[0], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _with_score(rows, model).select("doc_id", (F.coalesce(remainder("doc_id", MODULUS), F.lit(-1)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns; all rows without a model."""
    if model is None:
        return docs
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    return _with_score(rows, model).where(F.col("score") < THRESHOLD).select("row.*")
