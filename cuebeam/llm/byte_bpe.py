"""Byte-level BPE encoding and decoding, exact to the library's, with tree concatenation of long unsplit text.

A text is cut where the pattern of the tokenizer must end a match: before white space that
follows anything else. What lies between is encoded once and remembered. A stretch without any such
place may be of any length; it is taken apart into the pattern's own matches, and a match longer
than LEAF_CHARS is encoded as a tree: leaves in parallel, then neighbours are joined by encoding
a growing window around the seam again, until the first and the last id of the window are those
the two sides had. In BPE, a sequence of ids is the encoding of its bytes if and only if each two
neighbouring ids are the encoding of theirs; one agreeing id on either side thus proves the whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuebeam.llm.common import claim, holds
from cuebeam.llm.tokens import CACHE_CHARS, CACHE_ENTRIES, tokenizer, tokenizer_path

#: A single match of the pattern beyond this many characters is encoded as a tree.
LEAF_CHARS = 2048
#: Ids on either side of a seam that are encoded again at first; doubled until both sides agree.
FIRST_WINDOW = 4
#: Threads of a task that encode the leaves of one match, while it lasts.
THREADS = 4

#: Unicode's White_Space, as the tokenizer's pattern has it.
_SPACE = "\t-\r \x85\xa0  -     　"
_DOUBLED = re.compile(f"[{_SPACE}][ \n]")
_STRETCH = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str, leaf: int = LEAF_CHARS):
        self.lib, self.leaf = tokenizer(path), leaf
        added = self.lib.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        stand_in = _byte_of_char()
        self.bytes_of = [b""] * self.lib.get_vocab_size(with_added_tokens=True)
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            own = [stand_in.get(c) for c in token]
            self.bytes_of[i] = token.encode() if None in own else bytes(own)
        self.known: dict[str, tuple[str, bytes, int]] = {}

    # encoding

    def _plain(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _match(self, text: str) -> list[int]:
        """Ids of a single match of the pattern, as a tree of halves if it is long."""
        if len(text) <= self.leaf:
            return self._plain(text)
        n = 1
        while len(text) / n > self.leaf:
            n *= 2
        cuts = [len(text) * k // n for k in range(n + 1)]
        leaves = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        # the library holds no interpreter lock while it encodes, so the parts go on at the same time
        parts = min(n, THREADS)
        with ThreadPoolExecutor(parts) as pool:
            encoded = pool.map(lambda k: self.lib.encode_batch(leaves[n * k // parts : n * (k + 1) // parts], add_special_tokens=False), range(parts))
            level = [e.ids for part in encoded for e in part]
        while len(level) > 1:
            level = [self._join(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        return level[0]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the text of both."""
        k = FIRST_WINDOW
        while True:
            a, b = left[-k:], right[:k]
            text = b"".join(map(self.bytes_of.__getitem__, a + b))
            try:
                again = self._plain(text.decode())
            except UnicodeDecodeError:  # the window's ends cut a character
                again = None
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if again and (whole_left or again[0] == a[0]) and (whole_right or again[-1] == b[-1]):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            k *= 2

    def _stretch(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if len(text) <= self.leaf:
            return self._plain(text)
        ids: list[int] = []
        short = 0  # start of what goes to the library as it is
        for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text):
            if b - a > self.leaf:
                ids += self._plain(text[short:a]) if short < a else []
                ids += self._match(text[a:b])
                short = b
        return ids + (self._plain(text[short:]) if short < len(text) else [])

    def _chunks(self, text: str) -> list[str]:
        if "\0" in text or _DOUBLED.search(text):
            return _STRETCH.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def _entry(self, chunk: str) -> tuple[str, bytes, int]:
        found = self.known.get(chunk)
        if found is None:
            ids = self._stretch(chunk) if chunk else []
            found = ",".join(map(str, ids)), self.decode_bytes(ids), len(ids)
            if len(chunk) <= CACHE_CHARS:
                if len(self.known) >= CACHE_ENTRIES:
                    self.known.clear()
                self.known[chunk] = found
        return found

    def _parts(self, text: str) -> Iterator[tuple[str, bytes, int]]:
        if self._specials and any(s in text for s in self.special):
            for k, part in enumerate(self._specials.split(text)):
                if k % 2:
                    i = self.special[part]
                    yield str(i), self.bytes_of[i], 1
                else:
                    yield from map(self._entry, filter(None, self._chunks(part)))
        else:
            yield from map(self._entry, filter(None, self._chunks(text)))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self._parts(text) for i in ids.split(",")]

    def digest(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, ids in decimal joined by commas, and the decoded text's bytes."""
        found = list(self._parts(text))
        if not found:
            return 0, "", b""
        ids, decoded, n = zip(*found, strict=True)
        return sum(n), ",".join(ids), b"".join(decoded)

    # decoding

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=8)
def byte_bpe(path: str, leaf: int = LEAF_CHARS) -> ByteBpe:
    return ByteBpe(path, leaf)


holds("byte bpe", byte_bpe.cache_clear)


def encode(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each text; null and empty texts have none."""
    path = tokenizer_file or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        claim("byte bpe")
        bpe = byte_bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.encode(t.as_py() or "") for t in b.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """doc_id and text of encode()'s rows; null ids give the empty text, invalid UTF-8 the replacement character."""
    path = tokenizer_file or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        claim("byte bpe")
        bpe = byte_bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    The digests are of the decimal ids joined by commas and of the decoded text in UTF-8. Null and
    empty texts have no ids, and digests of nothing. Repeated rows give repeated rows; an empty table
    none. Other columns play no part. Each row stands for itself: nothing is shuffled.
    """
    path = tokenizer_file or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        claim("byte bpe")
        bpe = byte_bpe(path)
        for b in batches:
            n, ids_of, decoded_of = [], [], []
            for t in b.column(1):
                count, ids, decoded = bpe.digest(t.as_py() or "")
                n.append(count)
                ids_of.append(sha256(ids.encode()).hexdigest())
                decoded_of.append(sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_of), pa.array(decoded_of)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
