"""Byte-level BPE by monoid tree reduction.

The encodings of strings form a monoid under joining. A string is encoded by encoding its halves and joining them:
the last token of the left and the first of the right are encoded anew as one window, which grows while its edges
don't fit. A sequence is the encoding of its bytes exactly if each of its neighbours is the encoding of the two
together (each token being the encoding of its own bytes), so once both edges of the window fit, no token outside it
can change. Decoding concatenates bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, slices
from .tokens import ChunkMemory, default_path

PAIR_MEMORY = 500_000


class ByteBPE:
    """Ranks of one vocabulary; ``encode`` takes the bytes of one pre-split match."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str) -> "ByteBPE":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Lowest-rank merging of a window."""
        if len(data) > 64:
            return self._merge_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs and a linked list of parts."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # end of the part that starts here; 0: no part starts here
        back = list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = end[i]
            if j < n and (r := ranks.get(data[i : end[j]])) is not None:
                heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                back[stop] = i
                offer(i)
            if back[i] >= 0:
                offer(back[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > PAIR_MEMORY:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b])
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of both."""
        if not left or not right:
            return left or right
        i, j = len(left) - 1, 1  # the window takes left[i:] and right[:j]
        mid, step = self.pair(left[i], right[0]), 1
        while True:  # the window doubles, so that even a text of one letter costs little more than its length
            if i and self.pair(left[i - 1], mid[0]) != (left[i - 1], mid[0]):
                i = max(0, i - step)
            elif j < len(right) and self.pair(mid[-1], right[j]) != (mid[-1], right[j]):
                j = min(len(right), j + step)
            else:
                return left[:i] + mid + right[j:]
            step *= 2
            mid = self.merge(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))

    def encode(self, data: bytes) -> tuple[int, ...]:
        if not data:
            return ()
        got = self.ranks.get(data)
        if got is not None:
            return (got,)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def decode(self, ids) -> bytes:
        """Bytes of ids, joined pairwise up a tree."""
        level = [self.bytes_of[i] for i in ids]
        while len(level) > 1:
            level = [level[i] + level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else b""


_memories: dict[tuple[str, str], tuple[ByteBPE, ChunkMemory]] = {}


def _memory(path: str, pattern: str) -> tuple[ByteBPE, ChunkMemory]:
    if (path, pattern) not in _memories:
        import regex

        bpe, split = ByteBPE.from_file(path), regex.compile(pattern).findall

        def encode(chunks):
            out = []
            for c in chunks:
                ids = [i for m in split(c) for i in bpe.encode(m.encode("utf-8", "surrogatepass"))]
                out.append((" ".join(map(str, ids)), bpe.decode(ids)))
            return out

        _memories[path, pattern] = bpe, ChunkMemory(encode, 600_000)
    return _memories[path, pattern]


def encode_decode(texts: list[str], path: str | None = None, pattern: str | None = None) -> list[tuple[str, bytes]]:
    """(decimal ids joined by a space, decoded bytes) of each text."""
    import public_tokenizers

    if not texts:
        return []
    memory = _memory(path or default_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)[1]
    out = []
    for parts in memory.lists(texts):
        out.append((" ".join([p[0] for p in parts if p[0]]), b"".join([p[1] for p in parts])))
    return out


def encode_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (decimal, joined by a space), decoded (binary) of each row.

    Null text is an empty text without ids; null or repeated ids keep their rows; other columns are ignored.
    """
    return _over(docs, text, doc_id, path, pattern, False)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode_documents`` with digests in place of the long columns."""
    return _over(docs, text, doc_id, path, pattern, True)


def _over(docs, text, doc_id, path, pattern, digest):
    ship_package(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in slices(batch, text=1):
                got = encode_decode([t or "" for t in part.column(1).to_pylist()], path, pattern)
                if digest:
                    cols = [part.column(0), pa.array([s.count(" ") + 1 if s else 0 for s, _ in got], pa.int64()), pa.array([sha(s.encode()) for s, _ in got]), pa.array([sha(b) for _, b in got])]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in got], pa.string()), pa.array([b for _, b in got], pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids string, decoded binary")
