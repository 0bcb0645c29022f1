"""Encoding by chunks that a public tokenizer provably treats one by one, with a bounded cache."""

from __future__ import annotations

import json
import os
import re

from cuebeam.llm.common import holds

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct chunks a worker remembers; beyond it the cache starts anew. Bounds memory, never results.
CACHE_ENTRIES = 600_000
#: Longest chunk (characters) that is remembered.
CACHE_CHARS = 64

#: White space to str.split() but not to the tokenizers' patterns, or the other way round.
_ODD_SPACE = re.compile("[\x1c-\x1f᠎​﻿]")

#: Letters and printable ASCII on which every notion of letter, digit and lower case agrees.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
_PLAIN = re.compile(f"[!-~{LETTERS}]+")
_WORD_MATCH = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, once for each process, with truncation and padding off."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def runs_of_texts(column, chars: int = 2_000_000):
    """(first row, texts) of an Arrow text column, some 2 MB at a time; nulls are empty texts."""
    first, size, texts = 0, 0, []
    for k, t in enumerate(column):
        texts.append(t := t.as_py() or "")
        size += len(t)
        if size >= chars:
            yield first, texts
            first, size, texts = k + 1, 0, []
    if texts:
        yield first, texts


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """BPE of many short matches at once: each round merges the pair of least rank in every word.

    Pairs are looked up in two hashed tables (the second holds what collides in the first). Words
    longer than `longest` bytes are left to the library.
    """

    NONE = 1 << 30

    def __init__(self, path: str, longest: int = 32):
        import numpy as np

        self.lib, self.longest = tokenizer(path), longest
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        char_of = {b: c for c, b in byte_of_char().items()}
        self.base = np.array([vocab[char_of[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char_of[b] + end] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        self.tables, at = [], rank
        for bits, factor in ((20, 0x9E3779B97F4A7C15), (16, 0xC2B2AE3D27D4EB4F), (12, 0x165667B19E3779F9)):
            slot = self._slot(key[at], bits, factor)
            first = np.unique(slot, return_index=True)[1]
            keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int64)
            keys[slot[first]], ranks[slot[first]] = key[at[first]], rank[at[first]]
            self.tables.append((bits, factor, keys, ranks))
            at = np.delete(at, first)
        assert not len(at), "pairs left over"
        self.made = np.append(made, -1)

    @staticmethod
    def _slot(key, bits: int, factor: int):
        import numpy as np

        return (key.astype(np.uint64) * np.uint64(factor) >> np.uint64(64 - bits)).astype(np.int64)

    def _rank(self, a, b):
        import numpy as np

        key, out = a << 20 | b, None
        for bits, factor, keys, ranks in self.tables:
            slot = self._slot(key, bits, factor)
            found = np.where(keys[slot] == key, ranks[slot], self.NONE)
            out = found if out is None else np.minimum(out, found)
        out[(a < 0) | (b < 0)] = self.NONE
        return out

    def __call__(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word, which must be one match of the pattern."""
        import numpy as np

        out: list[bytes] = [b""] * len(words)
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        for lo, hi in ((0, 6), (6, 12), (12, 20), (20, self.longest)):
            group = np.flatnonzero((size > lo) & (size <= hi))
            for at in np.array_split(group, max(1, len(group) // 20000)) if len(group) else []:
                for i, ids in zip(at.tolist(), self._merge([raw[i] for i in at.tolist()], size[at], hi), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > self.longest).tolist():
            out[i] = np.array(self.lib.encode(words[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _merge(self, raw: list[bytes], size, width: int) -> list[bytes]:
        import numpy as np

        n = len(raw)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(size) - size
        col = np.arange(len(flat)) - np.repeat(start, size)
        ids = np.full((n, width + 1), -1, np.int64)
        ids[np.repeat(np.arange(n), size), col] = self.base[flat]
        ids[np.arange(n), size - 1] = self.last[flat[start + size - 1]]
        rank = np.full((n, width), self.NONE, np.int64)
        rank[:, :] = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        done, row = np.empty((n, width), "<u4"), np.arange(n)
        count = size.copy()
        columns = np.arange(width)
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(at)), at]
            live = best < self.NONE
            if not live.all():
                gone = ~live
                done[row[gone]] = ids[gone][:, :width]
                ids, rank, row, at, best = ids[live], rank[live], row[live], at[live], best[live]
            if not len(row):
                break
            r = np.arange(len(row))
            count[row] -= 1
            right = columns > at[:, None]  # all past the merged pair move one place to the left
            ids[:, 1:width] = np.where(right[:, 1:], ids[:, 2:], ids[:, 1:width])
            ids[:, width] = -1
            rank[:, : width - 1] = np.where(columns[:-1] >= at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, width - 1] = self.NONE
            ids[r, at] = self.made[best]
            rank[r, at] = self._rank(ids[r, at], ids[r, at + 1])
            before = at > 0
            b = r[before]
            rank[b, at[before] - 1] = self._rank(ids[b, at[before] - 1], ids[b, at[before]])
        keep = np.arange(width) < count[:, None]
        stream, ends = done[keep].tobytes(), (4 * np.cumsum(count)).tolist()
        return [stream[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class WordIds:
    """Ids of the word-end tokenizer, as little-endian unsigned 32-bit bytes.

    Its patterns never cross white space, its normalizer works on single characters or on a
    character and its combining marks, and it drops white space: so a text's ids are those of its
    space-separated chunks, one after the other. Chunks of plain letters, digits and signs are taken
    apart here and merged many at a time, others go to the library; so do, whole, texts with a special
    token's string or with a character on which two notions of white space differ.
    """

    def __init__(self, path: str):
        self.lib, self.merge = tokenizer(path), Merger(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def _learn(self, chunks: set[str]) -> None:
        parts, new = {}, set()
        for c in chunks:
            if _PLAIN.fullmatch(c):
                parts[c] = found = _WORD_MATCH.findall(c.lower())
                new.update(found)
            else:
                self.known[c] = self.whole(c)
        words = list(new.difference(self.matches))
        self.matches.update(zip(words, self.merge(words), strict=True))
        get = self.matches.__getitem__
        for c, found in parts.items():
            self.known[c] = b"".join(map(get, found))

    def many(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        if len(self.matches) > CACHE_ENTRIES:
            self.matches.clear()
        split = [None if _ODD_SPACE.search(t) or any(s in t for s in self.special) else t.split() for t in texts]
        new = set().union(*(s for s in split if s)).difference(self.known)
        self._learn(new)
        get = self.known.__getitem__
        out = [self.whole(t) if s is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]
        for c in new:  # long chunks hardly come again
            if len(c) > CACHE_CHARS:
                self.matches.pop(c.lower(), None)
                del self.known[c]
        return out


_word_ids: dict[str, WordIds] = {}
holds("word ids", _word_ids.clear)


def word_ids(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]
