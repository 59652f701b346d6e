"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``radius`` differing bits agree in some segment up to
radius // segments bits, so each fingerprint enters one table a segment under its own key, and visits the keys of
the small Hamming ball around it. A bucket's fingerprints are compared in full; a bucket sends the edges of a
spanning forest, never its pairs. Components of these edges are the groups.

With a ball of one bit, only set bits are cleared when visiting: of two keys that differ in one bit, the one with
the bit set visits the other, so each such meeting happens once. ``ball`` can be larger.

Defined cases: null text is an empty text with fingerprint zero, linked like any other; a row with a null id gets
its fingerprint, a null component and no links; rows that repeat an id take part with each of their texts; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, discard, gives_back, lookup, materialize, ship_package, shuffle_width, slices
from .components import connected_components

SEED = 42
#: a bucket's rows are compared in blocks of this many
BLOCK = 4096


def fingerprints_of(texts, shingle: int, words: int):
    """uint64 array (texts, words): bit i set if set in over half of the hashes of the texts' shingles."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, hashes = [], []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
        if len(w) > shingle:
            grams = [b" ".join(g) for g in zip(*(w[i:] for i in range(shingle)))]
        else:
            grams = [b" ".join(w)] if w else []
        counts.append(len(grams))
        hashes += [digest(g, SEED) for g in grams]
    out = np.zeros((len(counts), words), np.uint64)
    counts = np.array(counts, np.int64)
    h = np.array(hashes, np.uint64)
    starts = np.cumsum(counts) - counts
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    for j in range(words):
        if j:  # further words of a longer fingerprint: the same hash, mixed anew
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * j)
            h ^= h >> np.uint64(32)
        for b in range(0, len(filled), 64):
            part = filled[b : b + 64]
            lo, hi = starts[part[0]], starts[part[-1]] + counts[part[-1]]
            bits = np.unpackbits(h[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts[part] - lo, axis=0, dtype=np.int64)
            out[part, j] = np.packbits(ones * 2 > counts[part][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id and columns f0.. (long: the bits of an unsigned 64-bit word) of each row."""
    schema = "doc_id long, " + ", ".join(f"f{j} long" for j in range(words))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text=1):
                f = fingerprints_of([t or "" for t in part.column(1).to_pylist()], shingle, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(f[:, j])) for j in range(words))], names=["doc_id", *(f"f{j}" for j in range(words))])

    ship_package(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def forest(f, radius: int):
    """Pairs (i, j) of rows of ``f`` (uint64, rows x words): a spanning forest of all links within ``radius`` bits.

    A row once tied to a group isn't compared with that group again.
    """
    import numpy as np

    left = np.arange(len(f))
    found = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.zeros(len(left), bool)
            for b in range(0, len(left), BLOCK):
                near[b : b + BLOCK] = np.bitwise_count(f[left[b : b + BLOCK]] ^ f[i]).sum(1, dtype=np.int64) <= radius
            hit = left[near].tolist()
            found += [(i, j) for j in hit]
            queue += hit
            left = left[~near]
    return found


def link_edges(prints: DataFrame, radius: int, segments: int, words: int = 1, ball: int | None = None) -> DataFrame:
    """Edges u, v between ``rep`` values of fingerprints (columns rep, f0..) within ``radius`` differing bits.

    Each word is cut into segments // words segments. Every pair is found that differs by at most
    segments * (ball + 1) - 1 bits; ball defaults to radius // segments, which covers ``radius``.
    """
    if segments % words:
        raise ValueError("segments are a multiple of words")
    spark = prints.sparkSession
    ship_package(spark)
    ball = radius // segments if ball is None else ball
    per_word = segments // words
    edges_of = [64 * i // per_word for i in range(per_word + 1)]
    cols = [f"f{j}" for j in range(words)]

    def visit(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=2048):
                f = [part.column(1 + j).to_numpy().view(np.uint64) for j in range(words)]
                keys, rows, own = [], [], []
                for s in range(segments):
                    i = s % per_word
                    lo, size = edges_of[i], edges_of[i + 1] - edges_of[i]
                    seg = (f[s // per_word] >> np.uint64(lo)) & np.uint64((1 << size) - 1)
                    mark = np.uint64(s)
                    for r in range(ball + 1):
                        for flip in combinations(range(size), r):
                            mask = np.uint64(sum(1 << x for x in flip))
                            # one bit: clear it only where it is set
                            at = np.flatnonzero(seg & mask) if r == 1 and ball == 1 else np.arange(len(seg))
                            keys.append(((seg[at] ^ mask) * np.uint64(segments)) + mark)
                            rows.append(at)
                            own.append(np.full(len(at), r == 0))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(own)), *(part.column(i).take(at) for i in range(words + 1))], names=["key", "own", "rep", *cols])

    def bucket(batches):
        import numpy as np
        import pyarrow as pa

        def links(key, own, rep, f):
            cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            us, vs = [], []
            size = np.diff(cut)
            for i in np.flatnonzero((size > 1) & own[cut[:-1]]).tolist():
                a, b = cut[i], cut[i + 1]
                if b - a == 2:
                    pairs = [(0, 1)] if int(np.bitwise_count(f[a] ^ f[a + 1]).sum()) <= radius else []
                else:
                    pairs = forest(f[a:b], radius)
                # a tree becomes a star around its smallest document: buckets that meet the same group send the same edges
                root: dict[int, int] = {}
                for x, y in pairs:
                    root[y] = root.setdefault(x, x)
                least: dict[int, int] = {}
                for x, r in root.items():
                    least[r] = min(least.get(r, rep[a + x]), rep[a + x])
                for x, r in root.items():
                    if rep[a + x] != least[r]:
                        us.append(rep[a + x]), vs.append(least[r])
            return pa.RecordBatch.from_arrays([pa.array(np.array(us, np.int64)), pa.array(np.array(vs, np.int64))], names=["u", "v"])

        rest = None
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(), np.stack([batch.column(3 + j).to_numpy().view(np.uint64) for j in range(words)], 1)]
            if not len(new[0]):
                continue
            if rest is not None:
                new = [np.concatenate(x) for x in zip(rest, new)]
            whole = int(np.searchsorted(new[0], new[0][-1]))  # sorted: the last bucket may go on
            if whole:
                yield links(*(x[:whole] for x in new))
            rest = [x[whole:] for x in new]
        if rest is not None:
            yield links(*rest)

    kinds = "rep long, " + ", ".join(f"{c} long" for c in cols)
    visits = prints.select("rep", *cols).mapInArrow(visit, f"key long, own boolean, {kinds}")
    dealt = visits.repartition(shuffle_width(spark), "key").sortWithinPartitions("key", F.col("own").desc())
    return dealt.mapInArrow(bucket, "u long, v long")


def group(prints: DataFrame, radius: int, segments: int, words: int = 1, ball: int | None = None) -> DataFrame:
    """``prints`` (doc_id, f0..) with component_id: the smallest doc_id reachable over links of at most ``radius`` bits.

    Equal fingerprints stand as one, under their smallest doc_id, before anything is compared.
    """
    cols = [f"f{j}" for j in range(words)]
    prints = materialize(prints, "prints")
    reps = materialize(prints.where("doc_id is not null").groupBy(*cols).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "reps")
    found = connected_components(link_edges(reps, radius, segments, words, ball))
    named = materialize(reps.join(found, reps["rep"] == found["node"], "left").select(*cols, "n", F.coalesce("component", "rep").alias("component_id")), "named")
    discard(reps)
    joined = lookup(prints, named, cols, prints.count(), "left")
    return joined.select("doc_id", *cols, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row: 64-bit SimHash over word shingles."""
    g = group(fingerprints(docs, text, doc_id, shingle), radius, segments)
    return g.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def radius_for(similarity: float, bits: int, slack: float = 5) -> int:
    """Differing bits of ``bits`` to allow for at a Jaccard similarity of shingle sets: what random hyperplanes give on
    average, and ``slack`` standard deviations more, so that nearly all pairs at the similarity itself count."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: str, shingle: int):
    """Distinct 64-bit hashes of a text's shingles, sorted."""
    import numpy as np
    import xxhash

    w = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    grams = {b" ".join(g) for g in zip(*(w[i:] for i in range(shingle)))} if len(w) > shingle else {b" ".join(w)} if w else set()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def set_mark(hashes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def set_print(hashes, words: int):
    """The SimHash of a shingle set: like ``fingerprints_of``, each shingle counted once."""
    import numpy as np

    out, h = np.zeros(words, np.uint64), hashes
    for j in range(words):
        if j:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * j)
            h ^= h >> np.uint64(32)
        if len(h):
            ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[j] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def similar(a: int, b: int, common: int, percent: int) -> bool:
    """Whether sets of a and b members with so many in common reach the Jaccard similarity, in whole numbers."""
    return 100 * common >= percent * (a + b - common)


def meeting_keys(hashes, frequent, percent: int):
    """The first members of a set, in one order for all sets: two sets at the similarity share one of them for certain.

    ``frequent`` (sorted hashes, their places) come last; that order decides the cost, never the result.
    """
    import numpy as np

    n = len(hashes)
    first = n - -(-percent * n // 100) + 1
    place = np.zeros(n, np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], hashes), len(frequent[0]) - 1)
        place = np.where(frequent[0][at] == hashes, frequent[1][at], 0)
    return hashes[np.lexsort((hashes, place))[:first]]


#: a sample of documents, one in so many, tells frequent shingles; at most so many of them
SAMPLE, MOST_FREQUENT = 64, 50_000
#: candidates a document names in a bucket
NAMED = 4
#: so many keys of full buckets are broadcast at most
MOST_SENT = 1_000_000
#: a bucket's sets are held in blocks of about this many members
HELD_MEMBERS = 1 << 20
#: of the full buckets that a document meets before this one, so many are told, and in a bucket the most frequent so many
#: words of 64; that decides the cost only
EARLIER, SEEN_WORDS = 64, 4


def _frequent_shingles(rows: DataFrame, shingle: int):
    """(sorted hashes, their places from 1) of shingles that several sampled documents hold. Bounded; for the order only."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text=1):
                sets = [shingle_set(t or "", shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "h long")
    top = some.groupBy("h").count().where("count >= 5").orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).collect()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    at = np.argsort(h)
    return h[at], (len(h) - np.arange(len(h)))[at]


def whole_groups(batches, keys: int, words: int):
    """For batches sorted by their first ``keys`` columns: (columns as arrays, where their groups begin and the end),
    never a part of a group. The last ``words`` columns become one array of unsigned words."""
    import numpy as np

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - words)]
        new.append(np.stack([batch.column(batch.num_columns - words + j).to_numpy().view(np.uint64) for j in range(words)], 1))
        if rest is not None:
            new = [np.concatenate(x) for x in zip(rest, new)]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in new[:keys]], axis=0)) + 1
        if len(cut):  # the last group may go on
            yield [x[: cut[-1]] for x in new], np.concatenate([[0], cut])
        rest = [x[cut[-1] :] for x in new] if len(cut) else new
    if rest is not None:
        yield rest, np.array([0, len(rest[0])])


def first_met(prev, key, i: int, at):
    """Which of the rows ``at`` row i doesn't already meet in the bucket of the member before: a pair is left to the
    first of several buckets in a row. Who has no member before has the bucket's own."""
    return (prev[at] != prev[i]) | (prev[i] == key)


def seen_bits(earlier, words: int):
    """Unsigned words of each row of a bucket: bits for the full buckets in its list, the frequent ones of all lists."""
    import numpy as np

    row = np.repeat(np.arange(len(earlier)), [len(x) for x in earlier])
    names, code, n = np.unique(np.concatenate(earlier).astype(np.int64), return_inverse=True, return_counts=True)
    place = np.empty(len(names), np.int64)
    place[np.argsort(-n, kind="stable")] = np.arange(len(names))
    place = place[code]
    kept = place < 64 * words
    out = np.zeros((len(earlier), words), np.uint64)
    np.bitwise_or.at(out, (row[kept], place[kept] // 64), np.uint64(1) << (place[kept] % 64).astype(np.uint64))
    return out


def possible(part, key: int, i: int, at, radius: int, percent: int):
    """Those of the rows ``at`` of a bucket that may link with row i: other groups' that size and distance allow, and
    that don't meet it in an earlier bucket anyway."""
    import numpy as np

    _, _, label, prev, size, f, seen = part
    ok = (label[at] != label[i]) & first_met(prev, key, i, at) & ~(seen[at] & seen[i]).any(1) & (100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i]))
    at = at[ok]
    return at[np.bitwise_count(f[at] ^ f[i]).sum(1, dtype=np.int64) <= radius]


def candidates(part, key: int, radius: int, percent: int, limit: int):
    """(pairs of rows, whether a row has named ``limit`` and may have more) in one bucket, whose rows rise by ``rep``.

    Each row names the first ``limit`` earlier rows that it may link with.
    """
    import numpy as np

    pairs, cut = [], False
    left, named = np.arange(len(part[0])), np.zeros(len(part[0]), np.int64)
    for i in range(len(named) - 1):
        left = left[np.searchsorted(left, i + 1) :]
        if not len(left):
            break
        at = possible(part, key, i, left, radius, percent)
        if len(at):
            pairs += [(j, i) for j in at.tolist()]
            named[at] += 1
            if named[at].max() >= limit:
                cut = True
                left = left[named[left] < limit]
    return pairs, cut


def unsettled(part, key: int, radius: int, percent: int):
    """The rows of a bucket that may link with one of another group, in order."""
    import numpy as np

    open_ = np.zeros(len(part[0]), bool)
    for i in range(len(open_) - 1):
        at = possible(part, key, i, np.arange(i + 1, len(open_)), radius, percent)
        open_[at] = True
        open_[i] |= len(at) > 0
    return np.flatnonzero(open_)


def crowd_links(part, key: int, block, members, radius: int, percent: int):
    """Pairs of rows: a spanning forest of the exact links between the groups of one bucket, whose rows come with the
    members of their sets. Where the rows are of two blocks, only pairs across them are compared."""
    import numpy as np

    rep, _, label, *_ = part = [x.copy() if k == 2 else x for k, x in enumerate(part)]
    sets = [np.frombuffer(m, np.uint64) for m in members]
    ends = np.cumsum([len(m) for m in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mine = [codes[b - len(m) : b] for m, b in zip(sets, ends.tolist())]
    flag = np.zeros(codes.max() + 1, bool)
    across = (block != block[0]).any()
    found = []
    for i in range(len(rep) - 1):
        at = possible(part, key, i, np.arange(i + 1, len(rep)), radius, percent)
        if across:
            at = at[block[at] != block[i]]
        flag[mine[i]] = True
        for j in at.tolist():
            if label[j] != label[i] and similar(len(mine[i]), len(mine[j]), int(np.count_nonzero(flag[mine[j]])), percent):
                found.append((i, j))
                label[label == label[j]] = label[i]
        flag[mine[i]] = False
    return found


def near_duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, words: int = 2) -> DataFrame:
    """doc_id, component_id at a Jaccard similarity of shingle sets (a whole percentage).

    Equal sets stand as one. Documents meet on the first members of their sets (``meeting_keys``), where every pair
    at the similarity meets for certain. In a bucket, 128-bit SimHash distances within a wide radius leave few pairs,
    and each of those is a link only when the exact Jaccard similarity of the two sets says so.

    A document first names a few candidates in each bucket, and those that link make groups. In buckets where one may
    have more, the documents that may link with another group then come with their sets: what links is found there,
    and a bucket sends a spanning forest, never its pairs. So no pair of different groups stays uncompared, and what
    a bucket sends grows with its rows, not with their pairs, even where all are near and none are linked.
    """
    spark = docs.sparkSession
    ship_package(spark)
    percent = round(100 * similarity)
    radius = radius_for(similarity, 64 * words)
    cols, seen_cols = [f"f{j}" for j in range(words)], [f"e{j}" for j in range(SEEN_WORDS)]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(_frequent_shingles(rows, shingle))
    # a set with a partner other than its equals has enough members to miss one
    least = -(-percent // (100 - percent)) if percent < 100 else None

    def prints(batches):
        import numpy as np
        import pyarrow as pa

        frequent = shared.value
        for batch in batches:
            for part in slices(batch, text=1):
                sets = [shingle_set(t or "", shingle) for t in part.column(1).to_pylist()]
                f = np.stack([set_print(h, words) for h in sets]).view(np.int64)
                keys = [meeting_keys(h, frequent, percent).view(np.int64) if least and len(h) >= least else [] for h in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_mark(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()), *(pa.array(np.ascontiguousarray(f[:, j])) for j in range(words)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "mark", "size", *cols, "keys"])

    known = materialize(rows.mapInArrow(gives_back(prints), "doc_id long, mark long, size int, " + ", ".join(f"{c} long" for c in cols) + ", keys array<long>"), "prints")
    first = materialize(known.where("doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "first")
    many = known.count()
    reps = lookup(known, first, ["mark"], many).where("doc_id = rep").dropDuplicates(["rep", "mark"]).where(F.size("keys") > 0).select("rep", "mark", "size", *cols, "keys")
    reps = materialize(reps, "reps")

    def bucket(batches):
        import numpy as np
        import pyarrow as pa

        for columns, cut in whole_groups(batches, 1, words):
            out, again = [], []
            columns.append(np.zeros((len(columns[0]), 0), np.uint64))
            for _, key, part in worth(columns, cut):
                pairs, more = candidates(part, key, radius, percent, NAMED)
                rep, mark = part[:2]
                out += [(rep[x], mark[x], rep[y], mark[y], None) for x, y in pairs]
                if more:
                    again.append((None, None, None, None, key))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, *again)] or [pa.array([], pa.int64())] * 5, names=["u", "u_mark", "v", "v_mark", "again"])

    def worth(columns, cut):
        """(first row, key, rows) of the buckets with two groups at least that don't all come from one bucket."""
        import numpy as np

        key, part = columns[0], columns[1:]
        label, prev = part[2:4]
        mixed = np.logical_or.reduceat(label != np.repeat(label[cut[:-1]], np.diff(cut)), cut[:-1])
        mixed &= np.logical_or.reduceat((prev != np.repeat(prev[cut[:-1]], np.diff(cut))) | (prev == key), cut[:-1])
        for g in np.flatnonzero(mixed).tolist():
            a, b = int(cut[g]), int(cut[g + 1])
            yield a, int(key[a]), [x[a:b] for x in part]

    def gather(batches):
        import numpy as np
        import pyarrow as pa

        for columns, cut in whole_groups(batches, 1, words):
            earlier = columns.pop(1)
            found = []  # rows, blocks, number of blocks, bits
            for a, key, part in worth([*columns, earlier], cut):
                part[-1] = seen_bits(part[-1], SEEN_WORDS)
                at = unsettled(part, key, radius, percent)
                if len(at):
                    own = np.unique((np.cumsum(part[4][at], dtype=np.int64) - 1) // HELD_MEMBERS, return_inverse=True)[1]
                    found.append((a + at, own, np.full(len(at), own[-1] + 1), part[-1][at]))
            if found:
                at, block, blocks, seen = (np.concatenate(x) for x in zip(*found))
                *plain, f = (x[at] for x in columns)
                bits = np.concatenate([f, seen], 1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int32()), pa.array(blocks, pa.int32()), *map(pa.array, plain), *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(bits.shape[1]))],
                    names=["block", "blocks", "key", "rep", "mark", "label", "prev", "size", *cols, *seen_cols],
                )

    def settle(batches):
        import pyarrow as pa

        for columns, cut in whole_groups(batches, 3, words + SEEN_WORDS):
            key, _, _, block, members, *part, bits = columns
            part += [bits[:, :words], bits[:, words:]]
            out = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                some = [x[a:b] for x in part]
                out += [(some[0][x], some[0][y]) for x, y in crowd_links(some, int(key[a]), block[a:b], members[a:b], radius, percent)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 2, names=["u", "v"])

    def to_sets(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text=2):
                sets = [shingle_set(t or "", shingle) for t in part.column(2).to_pylist()]
                keep = [i for i, (h, m) in enumerate(zip(sets, part.column(1).to_pylist())) if set_mark(h) == m]
                if keep:
                    at = pa.array(keep)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["k", "m", "members"])

    def confirm(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=256):
                keep = []
                for i, (a, b) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    if similar(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), percent):
                        keep.append(i)
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["u", "v"])

    def sets_of(ends):
        return materialize(rows.join(ends, rows["doc_id"] == ends["k"]).select("k", "m", "text").mapInArrow(gives_back(to_sets), "k long, m long, members binary").dropDuplicates(["k", "m"]), "sets")

    def dealt(visits):
        return visits.repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "rep", "mark")

    # each member with the one before it, the first with itself
    visits = reps.select(F.expr("posexplode(transform(keys, (k, i) -> struct(k as key, if(i > 0, keys[i - 1], k) as prev)))").alias("pos", "at"), "rep", "mark", "size", *cols)
    visits = visits.select("at.key", "rep", "mark", F.col("rep").alias("label"), "at.prev", "size", *cols, "pos")
    named = materialize(dealt(visits.drop("pos")).mapInArrow(gives_back(bucket), "u long, u_mark long, v long, v_mark long, again long"), "named")
    pairs = named.where("u is not null").select("u", "u_mark", "v", "v_mark").distinct()
    sets = sets_of(pairs.select(F.col("u").alias("k"), F.col("u_mark").alias("m")).unionByName(pairs.select(F.col("v").alias("k"), F.col("v_mark").alias("m"))).distinct())
    mine, theirs = (sets.select(F.col("k").alias(c), F.col("m").alias(f"{c}_mark"), F.col("members").alias(f"{c}_set")) for c in "uv")
    both = pairs.join(mine, ["u", "u_mark"]).join(theirs, ["v", "v_mark"]).select("u", "v", "u_set", "v_set")
    links = materialize(both.mapInArrow(gives_back(confirm), "u long, v long"), "links")
    discard(sets)
    found = materialize(connected_components(links), "components")
    keys = named.where("again is not null").select(F.col("again").alias("key"))
    full_buckets = keys.count()
    if full_buckets:
        if full_buckets <= MOST_SENT:  # the others' visits aren't shuffled for it
            keys = F.broadcast(keys)
        # a document's full buckets in their order, each with those before it
        full = visits.join(keys, "key", "left_semi").groupBy("rep", "mark", "size", *cols).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "prev"))).alias("at"))
        full = full.join(found, full["rep"] == found["node"], "left").withColumn("label", F.coalesce("component", "rep"))
        full = full.select(F.expr(f"explode(transform(at, (x, i) -> struct(x.key as key, x.prev as prev, slice(at.key, 1, least(i, {EARLIER})) as earlier)))").alias("at"), "rep", "mark", "label", "size", *cols)
        full = full.select("at.key", "at.earlier", "rep", "mark", "label", "at.prev", "size", *cols)
        kinds = ", ".join(f"{c} long" for c in [*cols, *seen_cols])
        crowd = materialize(dealt(full).mapInArrow(gives_back(gather), f"block int, blocks int, key long, rep long, mark long, label long, prev long, size int, {kinds}"), "crowd")
        sets = sets_of(crowd.select(F.col("rep").alias("k"), F.col("mark").alias("m")).distinct())
        # a bucket of several blocks is compared by pairs of them
        held = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets, (F.col("rep") == F.col("k")) & (F.col("mark") == F.col("m")))
        held = held.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "members", "rep", "mark", "label", "prev", "size", *cols, *seen_cols)
        held = held.repartition(shuffle_width(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep", "mark")
        links = links.unionByName(materialize(held.mapInArrow(gives_back(settle), "u long, v long"), "links"))
        discard(sets)
        found = materialize(connected_components(links), "components")
    ends = materialize(first.join(found, first["rep"] == found["node"], "left").select("mark", "n", F.coalesce("component", "rep").alias("component_id")), "ends")
    joined = lookup(known.select("doc_id", "mark"), ends, ["mark"], many, "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
