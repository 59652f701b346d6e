"""Line deduplication by pairwise alignment.

Documents that overlap are found through the hashes of shared lines of ``ANCHOR_WORDS`` words or more: each line hash
leads from a document to the first document (smallest id) that holds the line, and from a rare line's documents to all
earlier ones among them. Each such pair is aligned by patience diff on line hashes; the lines of the later document
that lie in aligned common blocks are covered. Runs of covered lines of at least ``min_words`` words are deleted from
the later document; the first document keeps its lines.

What stays is held against whole passages: from each line on and up to each line, the shortest run of lines of
``min_words`` words leads to the first document that holds this run. Runs of ``min_words`` words that alignment with
these covers, among the lines that stay, are deleted too. A passage of that length is made of such runs (those from
its first lines on, and the one up to its last line), so none that an earlier document holds stays, however short its
lines are and however many documents hold them. Fewer words beside a deleted run stay.

Going to the first holder gives one pair for each line or run and document, however many documents share it; the
pairs among a rare line's documents are bounded by ``rare``.

Defined cases: null text stays null and takes no part; a null id takes no part and its text stays; rows that share
an id count as one document for pairing (they are never paired with each other), each is aligned and cut on its own;
lines are compared without surrounding white space, blank lines never match by themselves but go with a deleted run
that surrounds them; a document all of whose lines go keeps its row with an empty text; columns other than the text
(and n_chars, where present and asked for) stay as they are, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, gives_back, hot_from, lookup, materialize, ship_package, slices

MIN_WORDS = 30
ANCHOR_WORDS = 4
RARE = 4
HASH_BYTES = 16


def line_hashes(text: str) -> tuple[list[bytes], list[int]]:
    """(128-bit hash, number of words) of each line; blank lines have an empty hash."""
    import xxhash

    hashes, words = [], []
    for line in text.split("\n"):
        line = line.strip()
        n = len(line.split())
        hashes.append(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) if n else b"")
        words.append(n)
    return hashes, words


def anchors(hashes: list[bytes], words: list[int], min_words: int) -> set[int]:
    """64-bit hashes that documents meet on: even ones of single lines, odd ones of the shortest runs of lines with
    ``min_words`` words; blank lines don't part a run."""
    import xxhash

    full = [i for i, n in enumerate(words) if n]
    value = lambda h: int.from_bytes(h[:8], "little", signed=True)
    found = {value(hashes[i]) & ~1 for i in full if words[i] >= ANCHOR_WORDS}

    def run(lo, hi):  # of full, both included
        if hi > lo or words[full[lo]] < ANCHOR_WORDS:  # a longer line alone is met as such
            found.add(value(xxhash.xxh3_64_digest(b"".join(hashes[i] for i in full[lo : hi + 1]))) | 1)

    lo = total = 0
    for hi, i in enumerate(full):
        total += words[i]
        while total - words[full[lo]] >= min_words:  # the shortest run up to this line
            total -= words[full[lo]]
            lo += 1
        if total >= min_words:
            run(lo, hi)
    hi = total = 0
    for lo in range(len(full)):  # the shortest run from this line on
        while hi < len(full) and total < min_words:
            total += words[full[hi]]
            hi += 1
        if total < min_words:
            break
        run(lo, hi - 1)
        total -= words[full[lo]]
    return found


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], rising in both: equal ends, then lines unique in both sides by
    their longest rising run, then the same between them. In a stretch without such lines the k-th occurrences of a
    line in both sides stand for them."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo1, hi1, lo2, hi2 = todo.pop()
        while lo1 < hi1 and lo2 < hi2 and a[lo1] == b[lo2]:
            out.append((lo1, lo2))
            lo1, lo2 = lo1 + 1, lo2 + 1
        while lo1 < hi1 and lo2 < hi2 and a[hi1 - 1] == b[hi2 - 1]:
            hi1, hi2 = hi1 - 1, hi2 - 1
            out.append((hi1, hi2))
        if lo1 >= hi1 or lo2 >= hi2:
            continue
        once: dict = {}
        for i in range(lo1, hi1):
            once[a[i]] = -1 if a[i] in once else i
        seen: dict = {}
        for j in range(lo2, hi2):
            if a_at := once.get(b[j], -1) + 1:
                seen[b[j]] = (-1, -1) if b[j] in seen else (a_at - 1, j)
        pairs = sorted((j, i) for i, j in seen.values() if i >= 0)
        if not pairs:
            places: dict = {}
            for i in range(lo1, hi1):
                places.setdefault(a[i], []).append(i)
            met: dict = {}
            for j in range(lo2, hi2):
                k = met[b[j]] = met.get(b[j], -1) + 1
                if k < len(places.get(b[j], ())):
                    pairs.append((j, places[b[j]][k]))
        if not pairs:
            continue
        tails: list[int] = []  # patience piles: last i of the best run of each length
        at: list[int] = []
        back = [-1] * len(pairs)
        for n, (_, i) in enumerate(pairs):
            k = bisect_left(tails, i)
            back[n] = at[k - 1] if k else -1
            if k == len(tails):
                tails.append(i)
                at.append(n)
            else:
                tails[k], at[k] = i, n
        run, n = [], at[-1]
        while n >= 0:
            run.append(pairs[n])
            n = back[n]
        run.reverse()
        l1, l2 = lo1, lo2
        for j, i in run:
            out.append((i, j))
            todo.append((l1, i, l2, j))
            l1, l2 = i + 1, j + 1
        todo.append((l1, hi1, l2, hi2))
    return sorted(out)


def covered_lines(own: list[bytes], partner: list[bytes]) -> list[int]:
    """Positions of ``own`` in blocks that patience diff aligns with ``partner``; blank lines cover nothing.

    What is left is aligned again, until no common line is: a passage can stand twice in either document. All copies
    of a line count with the first that is aligned, as later passes would find them.
    """
    partner = [h for h in partner if h]
    left, covered = [i for i, h in enumerate(own) if h], []
    while True:
        met = {own[left[i]] for i, _ in patience([own[i] for i in left], partner)}
        if not met:
            return sorted(covered)
        covered += [i for i in left if own[i] in met]
        left = [i for i in left if own[i] not in met]
        partner = [h for h in partner if h not in met]


def deleted_lines(covered, words: list[int], min_words: int) -> set[int]:
    """Runs of covered lines (blank lines between them included) with at least ``min_words`` words."""
    gone: set[int] = set()
    run: list[int] = []
    total = 0
    covered = set(covered)
    for i in range(len(words) + 1):
        if i in covered:
            run.append(i)
            total += words[i]
        elif i < len(words) and words[i] == 0 and run:
            run.append(i)
        else:
            if run and total >= min_words:
                gone.update(run)
            run, total = [], 0
    return gone


def all_deleted(by_line, covered, words: list[int], min_words: int) -> set[int]:
    """Lines that the pairs by single lines delete, and runs among the others that all pairs cover."""
    gone = deleted_lines(by_line, words, min_words)
    run: list[int] = []
    more: set[int] = set()
    for i in range(len(words) + 1):
        if i < len(words) and i not in gone:
            run.append(i)
            continue
        own = set(run).intersection(covered)
        more |= {run[k] for k in deleted_lines({i - run[0] for i in own}, [words[i] for i in run], min_words)} if own else set()
        run = []
    return gone | more


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, rare: int = RARE, n_chars: str | None = None) -> DataFrame:
    """``docs`` with repeated passages cut from all but the first document that holds them.

    ``n_chars`` names a column to set to the length of the new text.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def hashes(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for part in slices(batch, text=1):
                ids, marks, seqs, words, meet = [], [], [], [], []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    h, w = line_hashes(t)
                    ids.append(d)
                    marks.append(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63))
                    seqs.append(h)
                    words.append(w)
                    meet.append(list(anchors(h, w, min_words)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(seqs, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int32())), pa.array(meet, pa.list_(pa.int64()))], names=["d", "mark", "seq", "words", "anchors"])

    usable = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    hashed = usable.mapInArrow(gives_back(hashes), "d long, mark long, seq array<binary>, words array<int>, anchors array<long>")
    lines = materialize(hashed.dropDuplicates(["d", "mark"]), "lines")

    each = lines.select("d", "mark", F.explode("anchors").alias("h"))
    total = lines.agg(F.sum(F.size("anchors"))).first()[0] or 0
    # partial aggregation first: a line that a third of all documents hold is one row a task by then
    firsts = each.groupBy("h").agg(F.min(F.struct("d", "mark")).alias("first"), F.max("d").alias("last"), F.count("*").alias("n")).where(F.col("first.d") < F.col("last"))
    firsts = materialize(firsts, "firsts")
    shared = lookup(each, firsts, ["h"], total)
    with_first = shared.where(F.col("d") > F.col("first.d")).select("d", "mark", F.col("first.d").alias("p"), F.col("first.mark").alias("p_mark"), ((F.col("h") % 2) == 0).alias("by_line"))
    # a rare line's documents: at most ``rare``, so at most rare * (rare - 1) / 2 pairs a line
    few = each.join(firsts.where(F.col("n").between(3, rare) & (F.col("h") % 2 == 0)).select("h"), "h").groupBy("h").agg(F.collect_list(F.struct("d", "mark")).alias("all"))
    among = few.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where(F.col("x.d") > F.col("y.d")).select(F.col("x.d").alias("d"), F.col("x.mark").alias("mark"), F.col("y.d").alias("p"), F.col("y.mark").alias("p_mark"), F.lit(True).alias("by_line"))
    pairs = materialize(with_first.unionByName(among).groupBy("d", "mark", "p", "p_mark").agg(F.max("by_line").alias("by_line")), "pairs")

    # a first holder that many documents meet is copied, so that no task takes more than ``portion`` of its pairs
    portion = hot_from(pairs.count())
    busy = pairs.groupBy("p", "p_mark").agg(F.ceil(F.count("*") / portion).cast("int").alias("copies")).where("copies > 1")
    busy = F.broadcast(busy)  # each stands for over ``portion`` pairs
    dealt = pairs.join(busy, ["p", "p_mark"], "left").withColumn("copy", F.pmod(F.xxhash64("d", "mark"), F.coalesce("copies", F.lit(1))))
    theirs = lines.select(F.col("d").alias("p"), F.col("mark").alias("p_mark"), F.col("seq").alias("p_seq")).join(busy, ["p", "p_mark"], "left")
    theirs = theirs.select("p", "p_mark", "p_seq", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)).cast("long") - 1)).alias("copy"))
    own = lines.select("d", "mark", "seq")
    aligned = dealt.join(theirs, ["p", "p_mark", "copy"]).join(own, ["d", "mark"])

    def align(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, rows=256):
                cov = [covered_lines(a, b) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(4), pa.array(cov, pa.list_(pa.int32()))], names=["d", "mark", "by_line", "at"])

    covered = aligned.select("d", "mark", "seq", "p_seq", "by_line").mapInArrow(gives_back(align), "d long, mark long, by_line boolean, at array<int>")
    lists = {"at": F.col("at"), "by_line": F.when(F.col("by_line"), F.col("at"))}  # collect_list leaves nulls out
    union = covered.groupBy("d", "mark").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(n) for n, c in lists.items())).where(F.size("at") > 0)
    cuts = materialize(union.join(lines.select("d", "mark", "words"), ["d", "mark"]), "cuts")
    for table in (lines, firsts, pairs):
        discard(table)

    # only documents with a cut meet their positions; hashes of whole texts keep rows of one id apart
    out_cols = docs.columns
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in out_cols)).alias("row"), F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    met = plain.join(cuts.groupBy("d").agg(F.collect_list(F.struct("mark", "at", "by_line", "words")).alias("cuts")), "d", "left")

    def cut(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for part in slices(batch, text=1):
                texts = []
                for t, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    if t is not None and found:
                        mark = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
                        for c in found:
                            if c["mark"] == mark:
                                gone = all_deleted(c["by_line"], c["at"], c["words"], min_words)
                                if gone:
                                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
                                break
                    texts.append(t)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "new_text"])

    schema = T.StructType([met.schema["row"], T.StructField("new_text", T.StringType())])
    done = met.select("row", "t", "cuts").mapInArrow(gives_back(cut), schema)
    value = {text: F.col("new_text")}
    if n_chars:
        value[n_chars] = F.length("new_text").cast(docs.schema[n_chars].dataType)
    return done.select(*(value.get(c, F.col("row").getField(c)).alias(c) for c in out_cols))
