"""Token-id files: an adaptive context-mixing range coder in independently reset, checksummed blocks.

A block holds whole documents. Its ids are cut into lanes of equal length that are coded in step: each step takes
one id from every lane, with one model for all lanes that has seen all earlier steps. The model mixes three
distributions of the next id:

    P(x) = w2 * P2(x | two ids before, one before) + w1 * P1(x | one before) + w0 * P0(x)

P1 comes from the counts of the two leading followers of the id before; P2 from the leading follower of the two ids
before and how often it held (in hashed slots with a check of the context); a context not met yet has no weight; P0
comes from the counts of all ids. The weights are learned for each pair of
confidences of the orders: each id adds to the weight of the order that foresaw it; where both did, to each its share.
All three share one axis, ids in their order, so an id's interval is the sum of what the orders give to the ids before
it and to itself. A range coder (48-bit low, 16-bit words) turns the intervals into bits.

Block layout, little-endian: magic, version, n ids, lane length, vocabulary, n documents, crc32 of the fields before
and of all that follows; then documents (id, id present, length), words per lane, words. Blocks are rows of a table
that Spark writes, so that lost tasks leave no half files: file_no, block_no, file_start (ids of the file before the
block), n_tokens, payload.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, ship_package, shuffle_width, slices

MAGIC = b"CMR3"
FIELDS, CHECK = struct.Struct("<4sHQIIQ"), struct.Struct("<I")
INDEX = struct.Struct("<qBQ")
BLOCK_IDS = 1 << 20
LANE = 128
_ID_BITS, _UNIT, _WEIGHT = 17, 19, 8  # bits of an id, of an order's axis, of the weights
_TOTAL = _UNIT + _WEIGHT
_SLOTS = 1 << 17
_GAIN = 16
_MOST = 1 << 17


def _tables():
    """By the packed counts (leading, second: 4 bits each) of a context's followers: the confidence 0..7, the share of
    the leading one, and by case (leading, second, other) and counts the new counts, with bit 8 set to swap the two;
    last, in place of the second case, the other where there is no second follower."""
    import numpy as np

    sure, share, after = np.zeros(256, np.int32), np.zeros(256, np.int32), np.zeros(1024, np.int32)
    for p in range(16):
        for q in range(16):
            at, n = p << 4 | q, p + q
            sure[at] = 0 if not n else 1 + min(2, (n > 1) + (n > 4)) + (3 if n > 1 and not q else 1 if n > 2 and p > 2 * q else 0)
            share[at] = ((1 << _UNIT) * p // n) if n else 0
            after[at] = min(p + 1, 15) << 4 | q
            after[256 + at] = (min(q + 1, 15) << 4 | p) + 256 if q + 1 > p else p << 4 | min(q + 1, 15)
            after[512 + at] = 1 << 4 | 256 if not p else max(1, p - (p > 2)) << 4 | 1
            after[768 + at] = (p - 1) << 4 if p > 1 else 1 << 4 | 256
    return np.minimum(sure, 7), share, after


def _joined(a, b):
    """Two int32 arrays as one of int64, to be taken at once."""
    import numpy as np

    both = np.empty((len(a), 2), np.int32)
    both[:, 0], both[:, 1] = a, b
    return both.view(np.int64)[:, 0]


def _parts(both, at):
    import numpy as np

    got = both.take(at).view(np.int32)
    return got[::2], got[1::2]


class _Model:
    """Shared model of all lanes; encoder and decoder call the same methods in the same order.

    All in 32-bit integers; comparisons are masks of all bits or none, from the sign of a difference.
    """

    def __init__(self, vocabulary: int, inverse: bool):
        import numpy as np

        if vocabulary > 1 << _ID_BITS:
            raise ValueError(f"ids must lie below {1 << _ID_BITS}")
        self.np, self.inverse, self.size = np, inverse, vocabulary
        sure, share, self.after = _tables()
        self.known = _joined(sure, share)
        self.freq = np.ones(vocabulary, np.int64)
        self.fresh: list = []
        self.base = np.arange(vocabulary + 1, dtype=np.int64)
        # a context's two words: leading id and counts, second id or check of the context
        self.tables = [np.zeros(n, np.int64) for n in (vocabulary, _SLOTS)]
        self.credit = np.full((3, 64), 16.0)
        self.credit[0] *= 2
        self.credit[1, np.arange(64) % 8 == 0] = 0  # order 1, order 2: nothing known
        self.credit[2, np.arange(64) < 8] = 0

    def refresh(self, step: int):
        """Order-0 intervals of all ids (at steps 0, 1, 2, 4, ..), one part at least for each."""
        if step & (step - 1):
            return
        np = self.np
        if self.fresh:
            self.freq += _GAIN * np.bincount(np.concatenate(self.fresh), minlength=self.size)
            self.fresh = []
        cum = np.zeros(self.size + 1, np.int64)
        np.cumsum(self.freq, out=cum[1:])
        cum = self.base + cum * ((1 << _UNIT) - self.size) // cum[-1]
        width = np.diff(cum).astype(np.int32)
        self.base_of = _joined(cum[:-1].astype(np.int32), width)  # start and width of each id
        if self.inverse:
            self.id_at = np.repeat(np.arange(self.size, dtype=np.int32), width)

    def width_of(self, x) -> int:
        return self.base_of[x : x + 1].view(self.np.int32)[1]

    def begin(self, a, b):
        """Candidates and their masses after the ids a (two before) and b (int32), and the weight of order 0."""
        np = self.np
        mixed = a.view(np.uint32) * np.uint32(0x9E3779B1) + b.view(np.uint32) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
        self.at = b.astype(np.intp), (mixed & np.uint32(_SLOTS - 1)).astype(np.intp)
        self.check = (mixed >> np.uint32(_ID_BITS)).view(np.int32)
        low = (1 << _ID_BITS) - 1
        self.ids, self.counts, sure = [], [], []
        for order in (0, 1):
            p, q = _parts(self.tables[order], self.at[order])
            if order:
                other = q ^ self.check
                p &= ~(other | -other) >> 31
            c = p >> _ID_BITS
            self.counts.append(c)
            self.ids += [p & low] if order else [p & low, q]
            sure.append(_parts(self.known, c))
        self.pair = (sure[1][0] << 3) + sure[0][0]
        part = self.credit * (((1 << _WEIGHT) - 2) / self.credit.sum(0))
        w1, w2 = part[1].astype(np.int32), part[2].astype(np.int32)
        self.w0 = ((1 << _WEIGHT) - w1 - w2).take(self.pair)
        w1 = w1.take(self.pair)
        lead = w1 * sure[0][1]
        self.mass = [lead, (w1 << _UNIT) - lead, w2.take(self.pair) << _UNIT]

    def interval(self, x, at):
        """(start, width) of each id x (``at``: the same as an index), in parts of 2 ** _TOTAL."""
        start, width = _parts(self.base_of, at)
        start, width = self.w0 * start, self.w0 * width
        self.hits = []
        for c, m in zip(self.ids, self.mass):
            start += m & (c - x) >> 31
            hit = ((c ^ x) - 1) >> 31
            width += m & hit
            self.hits.append(hit)
        return start, width

    def find(self, v):
        """(x, start, width) of the id x whose interval holds each v."""
        np, ids, mass = self.np, self.ids, self.mass
        lo, wide = [], []
        for c, m in zip(ids, mass):
            start, width = _parts(self.base_of, c)
            lo.append(self.w0 * start)
            wide.append(self.w0 * width + m)
        for j in (1, 2):
            for k in range(j):
                less = (ids[j] - ids[k]) >> 31
                lo[k] += mass[j] & less
                same = ((ids[j] ^ ids[k]) - 1) >> 31
                lo[j] += mass[k] & ~(less | same)
                wide[j] += mass[k] & same
                wide[k] += mass[j] & same
        x, at, far, below = (np.zeros(len(v), np.int32) for _ in range(4))
        self.hits = []
        for c, m, a, w in zip(ids, mass, lo, wide):
            past = v - a
            short = (past - w) >> 31
            hit = short & ~(past >> 31)
            x |= c & hit
            at |= a & hit
            far |= w & hit
            below += m & ~short
            self.hits.append(hit)
        rest = np.flatnonzero(far == 0)
        low, w0 = below[rest], self.w0[rest]
        x[rest] = new = self.id_at.take(((v[rest] - low) / w0).astype(np.intp))
        start, width = _parts(self.base_of, new)
        at[rest], far[rest] = w0 * start + low, w0 * width
        return x, at, far

    def update(self, x, at):
        """Counts of followers, and the weights: what foresaw an id gains; two orders that both did share it by weight."""
        np = self.np
        self.fresh.append(at)
        real = [h & (-m) >> 31 for h, m in zip(self.hits, self.mass)]
        by1, by2 = real[0] | real[1], real[2]
        cells = np.bincount((self.pair << 2) - by1 - (by2 << 1), minlength=256).reshape(64, 4)
        mine = self.credit[2] / np.maximum(self.credit[1] + self.credit[2], 1e-9)
        self.credit += cells[:, 0], cells[:, 1] + cells[:, 3] * (1 - mine), cells[:, 2] + cells[:, 3] * mine
        over = self.credit.sum(0) > _MOST
        if over.any():
            self.credit[:, over] *= 0.5
        p, q, held = self.ids
        is_p, is_q, is_held = self.hits
        then = self.after.take(self.counts[0] + (256 & ~is_p) + (256 & ~(is_p | is_q)))
        other = x ^ (x ^ q) & is_p
        turn = (p ^ other) & -(then >> 8)
        self.tables[0][self.at[0]] = _joined(p ^ turn | (then & 255) << _ID_BITS, other ^ turn)
        then = self.after.take(self.counts[1] + (768 & ~is_held))
        self.tables[1][self.at[1]] = _joined(held ^ (held ^ x) & -(then >> 8) | (then & 255) << _ID_BITS, self.check)


def _shape(n: int) -> int:
    return LANE if n >= LANE * LANE else max(1, int(n**0.5))


def encode_ids(ids, vocabulary: int):
    """(words per lane, words) of a block's ids (int64 array, all below ``vocabulary``)."""
    import numpy as np

    n = len(ids)
    t_max = _shape(n)
    lanes = -(-n // t_max)
    steps = np.ascontiguousarray(np.concatenate([ids, np.zeros(lanes * t_max - n, np.int64)]).reshape(lanes, t_max).T)
    model = _Model(vocabulary, False)
    u = np.uint64
    s16, s32, low32, least = u(16), u(32), u(0xFFFFFFFF), u(1 << 32)
    low, rng = np.zeros(lanes, u), np.full(lanes, 1 << 48, u)
    sent: list[tuple] = []  # (lanes, their words) in the order of sending
    a, b = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for t in range(t_max):
        m = lanes if (lanes - 1) * t_max + t < n else lanes - 1
        if not m:
            break
        model.refresh(t)
        at = steps[t, :m]
        x = at.astype(np.int32)
        model.begin(a[:m], b[:m])
        start, width = model.interval(x, at)
        r = rng[:m] >> u(_TOTAL)
        low[:m] += start.astype(u) * r
        rng[:m] = width.astype(u) * r
        few = np.flatnonzero(rng[:m] < least)
        while len(few):
            now, then = low[few], rng[few] << s16
            sent.append((few, now >> s32))
            low[few] = (now & low32) << s16
            rng[few] = then
            few = few[then < least]
        model.update(x, at)
        a[:m], b[:m] = b[:m], x
    every = np.arange(lanes)
    for _ in range(3):
        sent.append((every, low >> s32))
        low = (low & low32) << s16
    carry = np.zeros(lanes, u)
    for few, words in reversed(sent):  # carries run towards the front
        words += carry[few]
        carry[few] = words >> s16
    lane = np.concatenate([few for few, _ in sent]).astype(np.int32)
    words = np.concatenate([w for _, w in sent]).astype("<u2")
    return np.bincount(lane, minlength=lanes), words[np.argsort(lane, kind="stable")]


def decode_ids(n: int, t_max: int, vocabulary: int, per, words):
    import numpy as np

    lanes = len(per)
    u = np.uint64
    s16, s32, least = u(16), u(32), u(1 << 32)
    last = np.cumsum(per)
    pos = last - per
    words = np.concatenate([words.astype(u), np.zeros(8, u)])
    code = (words[pos] << s32) | (words[pos + 1] << s16) | words[pos + 2]
    pos += 3
    rng = np.full(lanes, 1 << 48, u)
    model = _Model(vocabulary, True)
    steps = np.zeros((t_max, lanes), np.int32)
    a, b = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for t in range(t_max):
        m = lanes if (lanes - 1) * t_max + t < n else lanes - 1
        if not m:
            break
        model.refresh(t)
        model.begin(a[:m], b[:m])
        r = rng[:m] >> u(_TOTAL)
        # below 2**48 over 2**5 or more: the quotient's floor is exact in double precision
        x, start, width = model.find(np.minimum(code[:m].astype(np.float64) / r.astype(np.float64), (1 << _TOTAL) - 1).astype(np.int32))
        code[:m] -= start.astype(u) * r
        rng[:m] = width.astype(u) * r
        few = np.flatnonzero(rng[:m] < least)
        while len(few):
            here = pos[few]
            code[few] = (code[few] << s16) | np.where(here < last[few], words[here], u(0))
            pos[few] = np.minimum(here + 1, last[few])
            then = rng[few] << s16
            rng[few] = then
            few = few[then < least]
        model.update(x, x)
        a[:m], b[:m] = b[:m], x
        steps[t, :m] = x
    return steps.T.reshape(-1)[:n].astype(np.int64)


def write_block(docs: list[tuple[int | None, bytes]], vocabulary: int | None = None) -> bytes:
    """A block of whole documents: (id, ids as little-endian unsigned 32-bit integers)."""
    import numpy as np

    ids = np.frombuffer(b"".join(d for _, d in docs), "<u4").astype(np.int64)
    top = int(ids.max()) + 1 if len(ids) else 1
    vocabulary = max(vocabulary or 0, top)
    body = b"".join(INDEX.pack(d if d is not None else 0, d is not None, len(x) // 4) for d, x in docs)
    if len(ids):
        per, words = encode_ids(ids, vocabulary)
        body += struct.pack("<I", len(per)) + per.astype("<u4").tobytes() + words.tobytes()
    else:
        body += struct.pack("<I", 0)
    head = FIELDS.pack(MAGIC, 1, len(ids), _shape(len(ids)), vocabulary, len(docs))
    return head + CHECK.pack(zlib.crc32(body, zlib.crc32(head))) + body


def read_block(payload: bytes) -> list[tuple[int | None, bytes]]:
    """The documents of a block; ValueError if any bit of it is damaged."""
    import numpy as np

    begin = FIELDS.size + CHECK.size
    if len(payload) < begin:
        raise ValueError("block too short")
    head, body = payload[: FIELDS.size], payload[begin:]
    magic, version, n, t_max, vocabulary, n_docs = FIELDS.unpack(head)
    if magic != MAGIC or version != 1 or zlib.crc32(body, zlib.crc32(head)) != CHECK.unpack_from(payload, FIELDS.size)[0]:
        raise ValueError("not a block, or a damaged one")
    at = n_docs * INDEX.size
    docs = list(INDEX.iter_unpack(body[:at]))
    (lanes,) = struct.unpack_from("<I", body, at)
    at += 4
    data = b""
    if lanes:
        per = np.frombuffer(body, "<u4", lanes, at).astype(np.int64)
        words = np.frombuffer(body, "<u2", int(per.sum()), at + 4 * lanes)
        data = decode_ids(n, t_max, vocabulary, per, words).astype("<u4").tobytes()
    out, i = [], 0
    for d, there, k in docs:
        out.append((d if there else None, data[4 * i : 4 * (i + k)]))
        i += k
    return out


def write_token_blocks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, vocabulary: int = 50257, files: int | None = None) -> DataFrame:
    """Blocks of all documents in ascending doc_id order: file_no, block_no, file_start, n_tokens, payload.

    Null text is an empty text (its end id alone); a null id comes first; rows that repeat an id all stay, ordered
    by text; other columns are ignored. Files are numbered in the order of their ids.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = tokenizer or tokens.default_path()
    schema = "file_no int, block_no int, file_start long, n_tokens long, payload binary"
    keys = ["doc_id", "text"]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(files or shuffle_width(spark), "doc_id").sortWithinPartitions(*keys)

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        file_no = TaskContext.get().partitionId()
        end = np.array([tokens.END_ID], np.uint32).tobytes()
        held, size, no, start = [], 0, 0, 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([file_no], pa.int32()), pa.array([no], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([write_block(held, vocabulary)], pa.binary())], names=["file_no", "block_no", "file_start", "n_tokens", "payload"])

        for batch in batches:
            for part in slices(batch, rows=2000, max_bytes=6 << 20, text=1):
                for d, data in zip(part.column(0).to_pylist(), tokens.token_bytes(part.column(1).to_pylist(), path)):
                    data += end
                    k = len(data) // 4
                    if held and size + k > BLOCK_IDS:
                        yield block()
                        no, start, held, size = no + 1, start + size, [], 0
                    held.append((d, data))
                    size += k
        if held:
            yield block()

    return ranged.mapInArrow(write, schema)


def read_token_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary) of each document of ``write_token_blocks``."""
    totals = {r["file_no"]: r["n"] for r in blocks.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).collect()}  # one number a file
    before, at = {}, 0
    for f in sorted(totals):
        before[f] = at
        at += totals[f]
    spark = blocks.sparkSession
    shift = spark.sparkContext.broadcast(before)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for f, s, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at, rows = shift.value[f] + s, []
                for d, data in read_block(payload):
                    rows.append((d, at, data))
                    at += len(data) // 4
                for i in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[i : i + 1000]), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "ids"])

    return blocks.select("file_no", "file_start", "payload").mapInArrow(read, "doc_id long, start long, ids binary")


def save(blocks: DataFrame, path: str) -> None:
    blocks.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file_no int, block_no int, file_start long, n_tokens long, payload binary").parquet(path)


def through_files(docs: DataFrame, **options) -> DataFrame:
    """Write token files for ``docs`` in the shared folder and read them back."""
    return read_token_blocks(materialize(write_token_blocks(docs, **options), "tokens"))
