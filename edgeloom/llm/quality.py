"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own shape (lengths, kinds of characters, repeated words) and that of the
lines before and after it. The field is fitted by gradient ascent on the log-likelihood of labelled documents, whose
lines take the document's label, each weighted by one over its lines. A document's quality is the mean of its lines' forward-backward marginals of good,
weighted by line length.

Defined cases: null and empty texts are one empty line; null or repeated ids keep their rows; other columns are
ignored; an empty table gives an empty result; without labelled rows of both kinds the score is 0.5 and
``keep_good`` keeps all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, labelled_sample, remainder, ship_package, slices

#: labelled rows used for fitting, at most
FIT_ROWS = 2500
THRESHOLD = 0.7
#: of the driver's crc32 split: rows with this remainder are held out
MODULUS, HELD_OUT = 4, 2
_KINDS = 8  # space, lower or other letter, upper, digit, sentence mark, exclamation, bar, symbol
BASE = 14
#: lines that forward-backward takes one after another
STEP = 32
#: bytes whose features are worked out at a time, bytes of the texts scored at a time, fitted texts scored at a time
PIECE, SLICE, FIT_PART = 1 << 20, 2 << 20, 100


def _kind_table():
    import numpy as np

    kind = np.full(256, 7, np.uint8)
    for b in range(256):
        c = chr(b)
        if b in (32, 9, 11, 12, 13):
            kind[b] = 0
        elif b >= 128 or "a" <= c <= "z":
            kind[b] = 1
        elif "A" <= c <= "Z":
            kind[b] = 2
        elif "0" <= c <= "9":
            kind[b] = 3
        elif c in ".,;:?'\"()-":
            kind[b] = 4
        elif c == "!":
            kind[b] = 5
        elif c == "|":
            kind[b] = 6
    return kind


def line_features(texts: list[str]):
    """(lines x BASE features, bytes of each line, lines of each text)."""
    return by_pieces(texts, lambda x: x)


def by_pieces(texts: list[str], of):
    """``of`` (lines x BASE features), bytes of each line, lines of each text. Lines have features of their own, so
    those of about ``PIECE`` bytes are worked out at a time: what a byte takes meanwhile isn't held for all texts."""
    import numpy as np

    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n_lines = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8)
    del raw
    ends = np.flatnonzero(data == 10)
    out, sizes, at, lo = [], [], 0, 0
    while at < len(ends) or not out:
        to = max(at + 1, int(np.searchsorted(ends, lo + PIECE)))
        hi = int(ends[to - 1]) + 1 if len(ends) else 0
        x, size = _features(data[lo:hi])
        out.append(of(x))
        sizes.append(size)
        at, lo = to, hi
    return np.concatenate(out), np.concatenate(sizes), n_lines


def _features(data):
    """(lines x BASE features, bytes of each line) of UTF-8 lines, each with its line feed."""
    import numpy as np

    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts
    kind = _kind_table()[data]
    kind[ends] = 0
    counts = np.stack([np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(_KINDS)], 1) if len(ends) else np.zeros((0, _KINDS))
    counts[:, 0] -= 1  # the line feed itself
    # words: their lines, hashes, and whether they repeat the word before or the one before that
    solid = kind != 0
    first = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    line_of = np.searchsorted(ends, first)
    words = np.bincount(line_of, minlength=len(ends)).astype(np.float64)
    again = np.zeros(len(ends))
    if len(first):
        place = np.arange(len(data)) - np.repeat(first, np.diff(np.concatenate([first, [len(data)]])))[-len(data) :] if first[0] == 0 else None
        if place is None:
            reach = np.diff(np.concatenate([first, [len(data)]]))
            place = np.concatenate([np.zeros(first[0], np.int64), np.arange(first[0], len(data)) - np.repeat(first, reach)])
        weight = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
        value = np.where(solid, data, 0).astype(np.uint64) * weight
        value ^= value >> np.uint64(31)
        hashed = np.add.reduceat(np.where(solid, value, np.uint64(0)), first)
        same = np.zeros(len(first), bool)
        same[1:] = (hashed[1:] == hashed[:-1]) & (line_of[1:] == line_of[:-1])
        again = np.bincount(line_of, weights=same, minlength=len(ends))
    chars = np.maximum(size, 1).astype(np.float64)
    solid_chars = np.maximum(counts[:, 1:].sum(1), 1).astype(np.float64)
    w = np.maximum(words, 1)
    out = np.stack(
        [
            np.ones(len(ends)), np.log1p(words) / 4, np.minimum(solid_chars / w, 20) / 10, counts[:, 1] / solid_chars, counts[:, 2] / solid_chars, counts[:, 3] / solid_chars,
            4 * counts[:, 4] / solid_chars, np.minimum(8 * counts[:, 5] / solid_chars, 4), np.minimum(8 * counts[:, 6] / solid_chars, 4), np.minimum(8 * counts[:, 7] / solid_chars, 4),
            again / w, (words == 0), counts[:, 0] / chars, (words > 0) & (words < 4),
        ], 1)
    return out, size


def with_neighbours(x, n_lines):
    """Own features, those of the line before and after (zero past the document's ends)."""
    import numpy as np

    if not len(x):
        return np.zeros((0, 3 * x.shape[1]))
    ends = np.cumsum(n_lines)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - n_lines] = 0
    after[ends - 1] = 0
    return np.concatenate([x, before, after], 1)


def line_scores(texts: list[str], w):
    """(``with_neighbours`` times ``w``, bytes of each line, lines of each text): a line's three products, its own and
    those that the lines after and before it take from it, in place of its features and theirs."""
    import numpy as np

    part, size, n_lines = by_pieces(texts, lambda x: x @ w.reshape(3, BASE).T)
    theta = part[:, 0].copy()
    ends = np.cumsum(n_lines)
    inner = np.ones(len(theta), bool)
    inner[ends - n_lines] = False
    at = np.flatnonzero(inner)
    theta[at] += part[at - 1, 1]
    theta[at - 1] += part[at, 2]
    return theta, size, n_lines


def _times(a, b):
    """Products of 2 x 2 matrices: rows 00, 01, 10, 11 relative to the largest, and the logarithm of that."""
    import numpy as np

    out = np.empty_like(a)
    for i in (0, 2):
        for j in (0, 1):
            out[i + j] = a[i] * b[j] + a[i + 1] * b[2 + j]
    top = out[:4].max(0)
    out[:4] /= top
    out[4] = a[4] + b[4] + np.log(top)
    return out


def _prefixes(m, sizes):
    """Products of all matrices up to each one, inside chains of the given sizes. Chains are cut into blocks of ``STEP``
    that advance in step; the blocks' own products form shorter chains: some STEP * log(longest) steps for any length."""
    import numpy as np

    out = m.copy()
    if not len(sizes) or sizes.max() <= 1:
        return out
    begin = np.cumsum(sizes) - sizes
    blocks = -(-sizes // STEP)
    many = np.repeat(np.arange(len(sizes)), blocks)
    at = (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * STEP
    first = begin[many] + at
    length = np.minimum(STEP, sizes[many] - at)
    for t in range(1, int(length.max())):
        i = first[length > t] + t
        out[:, i] = _times(out[:, i - 1], m[:, i])
    if blocks.max() > 1:
        whole = _prefixes(out[:, first + length - 1], blocks)
        later = np.flatnonzero(at > 0)  # blocks with others before them
        size = length[later]
        i = np.repeat(first[later] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out[:, i] = _times(np.repeat(whole[:, later - 1], size, axis=1), out[:, i])
    return out


def marginals(theta, trans, n_lines, weight=None):
    """(P(good) of each line, expected transition counts, log of each document's sum over labellings) by
    forward-backward over all documents at once; ``weight`` of each document scales its transition counts.

    theta: score of good of each line; trans[i, j]: score of state j after state i."""
    import numpy as np

    total = len(theta)
    if not total:
        return np.zeros(0), np.zeros((2, 2)), np.zeros(0)
    ends = np.cumsum(n_lines)
    begin = ends - n_lines
    # one matrix a line, from the state before it to its own; a first line has no state before
    step = np.empty((5, total))
    step[:4] = trans.reshape(4, 1)
    step[:4, begin] = 0
    step[1] += theta
    step[3] += theta
    step[4] = step[:4].max(0)
    step[:4] = np.exp(step[:4] - step[4])
    alpha = _prefixes(step, n_lines)
    # backwards: the same on reversed documents, with the matrices that lead on, transposed
    back = np.repeat(begin + ends - 1, n_lines) - np.arange(total)
    lead = step[[0, 2, 1, 3, 4]][:, np.minimum(np.arange(total) + 1, total - 1)]
    lead[:, ends - 1] = np.array([[1], [0], [0], [1], [0]])
    beta = _prefixes(lead[:, back], n_lines)[:, back]
    b = [beta[0] + beta[2], beta[1] + beta[3]]  # of each state: the sum over what follows
    whole = alpha[4, ends - 1] + np.log(alpha[0, ends - 1] + alpha[1, ends - 1])
    each = np.repeat(whole, n_lines)
    good = np.minimum(alpha[1] * b[1] * np.exp(alpha[4] + beta[4] - each), 1.0)
    inner = np.ones(total, bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    scale = np.exp(alpha[4, at - 1] + step[4, at] + beta[4, at] - each[at]) * (1.0 if weight is None else np.repeat(weight, n_lines)[at])
    pairs = np.array([[(scale * alpha[i, at - 1] * step[2 * i + j, at] * b[j][at]).sum() for j in (0, 1)] for i in (0, 1)])
    return good, pairs, whole


def likelihood(params, x, y, n_lines, penalty: float):
    """(minus the mean weighted log-likelihood of the documents' labellings, its gradient).

    Every line of a document has its label ``y`` (of each document). A document weighs mean lines / its lines, so that
    long documents count like short ones."""
    import numpy as np

    w, trans = params[:-4], params[-4:].reshape(2, 2)
    weight = n_lines.mean() / n_lines
    theta = x @ w
    good, pairs, whole = marginals(theta, trans, n_lines, weight)
    lines = np.repeat(y, n_lines)
    own = np.add.reduceat(theta * lines, np.cumsum(n_lines) - n_lines) + (n_lines - 1) * np.where(y > 0, trans[1, 1], trans[0, 0])
    wanted = np.diag([(weight * (n_lines - 1) * (y == v)).sum() for v in (0, 1)])
    value = (weight * (whole - own)).sum() / len(y) + penalty / 2 * (params**2).sum()
    return value, np.concatenate([x.T @ ((good - lines) * np.repeat(weight, n_lines)), (pairs - wanted).ravel()]) / len(y) + penalty * params


def fit(rows: list[tuple[str, int]], steps: int = 90, penalty: float = 1e-3):
    """Weights and transitions from (text, 0 or 1) rows; None without both labels."""
    import numpy as np

    if len({y for _, y in rows}) < 2:
        return None
    x, size, n_lines = line_features([t for t, _ in rows])
    x = with_neighbours(x, n_lines)
    y = np.array([y for _, y in rows], np.float64)
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        _, grad = likelihood(params, x, y, n_lines, penalty)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = (params[:-4], params[-4:].reshape(2, 2))
    # the marginals of labelled documents put the threshold where their labels part
    raw = np.concatenate([document_scores(model, [t for t, _ in rows[i : i + FIT_PART]], None) for i in range(0, len(rows), FIT_PART)])
    return (*model, _calibrate(raw, np.array([y for _, y in rows], np.float64)))


def _calibrate(raw, y, steps: int = 400):
    """Slope and offset on the logit of raw scores, balanced so that ``THRESHOLD`` parts the labels."""
    import numpy as np

    z = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / np.clip(1 - raw, 1e-6, 1))
    cuts = np.unique(np.quantile(z, np.linspace(0, 1, 401)))
    cuts = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [cuts[0] - 1]])
    wrong = [((z >= c) != (y > 0.5)).sum() for c in cuts]
    best = np.flatnonzero(np.array(wrong) == min(wrong))
    cut = float(np.median(cuts[best]))
    return 1.0, float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)


def document_scores(model, texts: list[str], calibration):
    """Quality of each text: its lines' marginals of good, weighted by length."""
    import numpy as np

    theta, size, n_lines = line_scores(texts, model[0])
    good, _, _ = marginals(theta, model[1], n_lines)
    at = np.cumsum(n_lines) - n_lines
    weight = size + 1.0
    raw = np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at) if len(at) else np.zeros(0)
    if calibration is None:
        return raw
    slope, offset = calibration
    z = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / np.clip(1 - raw, 1e-6, 1))
    return 1 / (1 + np.exp(-(slope * z + offset)))


def fit_tables(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """A model from at most ``rows`` labelled documents that aren't held out."""
    return fit(labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, rows))


def score(docs: DataFrame, model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    return _with_score(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), model).select(
        "doc_id", (F.coalesce(remainder("doc_id", MODULUS), F.lit(-1)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def _with_score(rows: DataFrame, model) -> DataFrame:
    """``rows`` (key, text) as key, score; the key can be of any type."""
    from pyspark.sql import types as T

    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    key = rows.columns[0]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, max_bytes=SLICE, text=1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                model = shared.value
                s = document_scores(model[:2], texts, model[2]) if model is not None else [0.5] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=[key, "score"])

    return rows.mapInArrow(gives_back(run), T.StructType([rows.schema.fields[0], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` at or above the threshold, with all their columns; all rows without a model."""
    if model is None:
        return docs
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    return _with_score(rows, model).where(F.col("score") >= THRESHOLD).select("row.*")
