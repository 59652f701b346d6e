"""Token ids of whole texts by the tokenizers library, with a bounded memory of space-separated chunks.

Under the split pattern of the byte-level vocabularies a boundary lies before every single space that a
non-space character follows, so a text's ids are those of its chunks, one after another. Each new chunk is
encoded by the library; chunks seen before are looked up. The run of letters a chunk begins with is a match of
the pattern by itself, so the runs of new chunks are encoded once each, many in one string: a run's first token is the one
that begins with the space.

The library is called as it comes. Where a text holds the string of an added token, the whole text goes to the library.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections import deque

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 2
#: A space before white space or the end; a boundary there isn't certain. str.isspace covers Unicode's set.
_ODD = re.compile(r" (?:[\s᠎﻿]|\Z)")
_SPLIT = re.compile(r" (?=[^\s᠎﻿])")
#: letters of the Latin blocks that the end or an ASCII character other than a letter follows
_RUN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[\x00-@\[-`{-\x7f]|\Z)")
MEMORY = 800_000
RECENT = 6
LONGEST_KEPT = 64
JOINED = 64


class ChunkMemory:
    """chunk -> value, bounded; ``encode`` maps a list of strings to the list of their values."""

    def __init__(self, encode, memory: int = MEMORY):
        self.encode, self.memory, self.seen = encode, memory, {}
        self.recent: deque[set[str]] = deque(maxlen=RECENT)

    def _known(self, names: list[str], encode) -> list:
        """The values of different names: remembered, or by ``encode`` of the list of the others."""
        seen = self.seen
        if len(seen) > self.memory:  # what came up in two of the last calls stays
            once: set[str] = set()
            twice: set[str] = set()
            for some in self.recent:
                twice |= once & some
                once |= some
            self.seen = seen = {k: seen[k] for k in twice if k in seen}
        self.recent.append(set(names))
        got = list(map(seen.get, names))
        new = [k for k, v in zip(names, got) if v is None]
        fresh = dict(zip(new, encode(new)))
        seen.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST_KEPT)
        return [fresh[k] if v is None else v for k, v in zip(names, got)]

    def values(self, heads: list[str], names: list[str]) -> list:
        """Of different texts' first chunks, and of different other chunks."""
        return self.encode(heads) + self._known(names, lambda new: self.encode([" " + x for x in new]))

    def coded(self, texts: list[str]):
        """(values of the different chunks, which of them stands at each place, first and last place of each text).

        Splitting and finding the different chunks is array work."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = [_ODD.search(t) is not None for t in texts]
        plain = pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.string()), " ")
        hard = pa.array([_SPLIT.split(t) for t, o in zip(texts, odd) if o], pa.list_(pa.string()))
        chunks = pa.concat_arrays([plain, hard])
        begin = chunks.offsets.to_numpy()[:-1]
        found = chunks.flatten().dictionary_encode()
        at = found.indices.to_numpy().astype(np.int64)
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        first = [names[i] for i in at[begin].tolist()]
        heads = list(dict.fromkeys(first))
        place = {h: i for i, h in enumerate(heads)}
        at += len(heads)
        at[begin] = [place[h] for h in first]
        ends = np.append(begin[1:], len(at))
        order = np.empty(len(texts), np.int64)  # plain texts come first in the arrays
        order[np.argsort(odd, kind="stable")] = np.arange(len(texts))
        return self.values(heads, names), at, begin[order], ends[order]

    def lists(self, texts: list[str]) -> list[list]:
        """For each text the values of its chunks."""
        values, at, begin, ends = self.coded(texts)
        at = at.tolist()
        return [[values[i] for i in at[a:b]] for a, b in zip(begin.tolist(), ends.tolist())]

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text the values of its chunks, 32-bit numbers, put together."""
        values, at, begin, ends = self.coded(texts)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        source = np.frombuffer(b"".join(values), np.uint32)
        many = size[at]
        upto = np.concatenate([[0], np.cumsum(many)])
        kind = np.int32 if max(upto[-1], len(source)) < 2**31 else np.int64
        where = np.repeat(((np.cumsum(size) - size)[at] - upto[:-1]).astype(kind), many)
        where += np.arange(len(where), dtype=kind)
        data = source[where].tobytes()
        return [data[a:b] for a, b in zip((4 * upto[begin]).tolist(), (4 * upto[ends]).tolist())]


class Library(ChunkMemory):
    """The ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self._plain)
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of a space and the letters of each run."""
        out: list[bytes] = []
        joined = [" " + " ".join(runs[i : i + JOINED]) for i in range(0, len(runs), JOINED)]
        for raw, i in zip(self._plain(joined), range(0, len(runs), JOINED)):
            at = np.flatnonzero(self.begins[np.frombuffer(raw, np.uint32)]) * 4
            own = runs[i : i + JOINED]
            ends = [*at[1:].tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(at.tolist(), ends)] if len(at) == len(own) else self._plain([" " + r for r in own])
        return out

    def values(self, heads: list[str], names: list[str]) -> list[bytes]:
        return self._plain(heads) + self._known(names, self._chunks)

    def _chunks(self, names: list[str]) -> list[bytes]:
        """Ids of a space and each chunk: of its run of letters, and of the rest."""
        ends = [len(c) if c.isascii() and c.isalpha() else m.end() if (m := _RUN.match(c)) else 0 for c in names]
        runs = [c[:e] for c, e in zip(names, ends)]
        rest = [c[e:] if e else " " + c for c, e in zip(names, ends)]  # without a run the space is the rest's
        of_run, of_rest = dict.fromkeys(runs), dict.fromkeys(rest)
        of_run.pop("", None), of_rest.pop("", None)
        of_run.update(zip(of_run, self._runs(list(of_run))))
        of_rest.update(zip(of_rest, self._plain(list(of_rest))))
        of_run[""] = of_rest[""] = b""
        return [of_run[r] + of_rest[t] if t else of_run[r] for r, t in zip(runs, rest)]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        odd = [any(a in t for a in self.added) for t in texts]
        if not any(odd):
            return super().ids(texts)
        plain = [t for t, o in zip(texts, odd) if not o]
        rest = iter(super().ids(plain) if plain else [])
        return [self._plain([t])[0] if o else next(rest) for t, o in zip(texts, odd)]


_libraries: dict[str, Library] = {}


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, without an end id. Nothing here makes cycles, so
    their collector, which looks at all new lists again and again, waits."""
    if path not in _libraries:
        _libraries[path] = Library(path)
    waits = gc.isenabled()
    gc.disable()
    try:
        return _libraries[path].ids(texts)
    finally:
        if waits:
            gc.enable()


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
