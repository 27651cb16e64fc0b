"""Byte-level BPE by two-tier lookup.

A minimal perfect hash over the vocabulary (hash and displace: one displacement per bucket,
as many slots as tokens) names the only token a byte string can be; comparing its bytes decides. A pre-token that is
a token is done. Any other starts as a linked list of bytes; a heap of (rank, place) offers the merge of lowest
rank and then leftmost place, and entries whose neighbours have changed since are passed over. The
same hash finds the ranks of merges. Pre-tokens met before are remembered by each worker, up to a bound.

Defined results: a null text is an empty one, with no ids and the hashes of no bytes; each row stands for itself, repeated,
null-id and very long ones included; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from telemark.llm.rows import map_arrow

VOCABULARY = "byte_bpe_50k.tiktoken"
REMEMBERED = 800_000


def _slot(h: int, d: int, n: int) -> int:
    return ((h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) % n


class PerfectHash:
    """Distinct keys -> 0 .. len(keys) - 1, each slot once; other keys land anywhere."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for h in map(xxhash.xxh3_64_intdigest, keys):
            groups[h % self.buckets].append(h)
        self.shift = [0] * self.buckets
        taken = bytearray(n)
        free = iter(range(n))
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) == 1:  # a slot of its own, written as a negative number
                slot = next(s for s in free if not taken[s])
                taken[slot], self.shift[b] = 1, -slot - 1
                continue
            d = 0
            while group:
                slots = [_slot(h, d, n) for h in group]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    for s in slots:
                        taken[s] = 1
                    self.shift[b] = d
                    break
                d += 1

    def __getitem__(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else ((h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) % self.n


#: White space by Unicode; the engines here count four control characters more.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
#: The public pattern for texts of these letters, ASCII and nothing else, in the quicker engine.
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER = re.compile(rf"[^\x00-\x7f{_LETTERS}]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The matches of a pattern, one after the other."""
    exact = pattern.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\S", rf"[^{_SPACE}]").replace(r"\s", rf"[{_SPACE}]")
    general = regex.compile(exact).findall
    if pattern != public_tokenizers.PATTERN:
        return general
    plain, other = _PLAIN.findall, _OTHER.search
    return lambda text: general(text) if other(text) else plain(text)


class Encoder(dict):
    """Text to ids and back, for one file of ranks. As a dict: pre-token -> ids as little-endian bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line.strip())]
        self.tokens = {i: token for token, i in ranks}
        self.hash = PerfectHash([token for token, _ in ranks])
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(ranks)
        for token, i in ranks:
            self.slots[self.hash[token]] = (token, i)
        self.split = splitter(pattern)
        self.ranks: dict[bytes, int] = {}
        self.pairs = [self.rank(bytes((a, b))) for a in range(256) for b in range(256)]

    def rank(self, piece: bytes) -> int:
        """The id of a token, -1 of any other bytes."""
        token, i = self.slots[self.hash[piece]]
        return i if token == piece else -1

    def known(self, piece: bytes) -> int:
        """``rank`` of the short pieces that merges ask for again and again, remembered up to the same bound."""
        if (i := self.ranks.get(piece)) is None:
            i = self.rank(piece)
            if len(piece) <= 16:
                if len(self.ranks) >= REMEMBERED:
                    self.ranks.clear()
                self.ranks[piece] = i
        return i

    def merged(self, piece: bytes) -> list[int]:
        n, pairs, known, met = len(piece), self.pairs, self.known, self.ranks.get
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        # a heap entry is one number: rank, place of the left part, end of the right part
        wide = n.bit_length()
        low, high = (1 << wide) - 1, 2 * wide
        heap = [pairs[a << 8 | b] << high | i << wide | i + 2 for i, (a, b) in enumerate(pairwise(piece)) if pairs[a << 8 | b] >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, stop = entry >> wide & low, entry & low
            j = after[i]
            if j >= n or end[i] != j or end[j] != stop:
                continue  # one of the two has changed
            end[i], k = stop, after[j]
            end[j], after[i] = -1, k
            if k < n:
                before[k] = i
                part = piece[i : end[k]]
                if (r := met(part)) is None:
                    r = known(part)
                if r >= 0:
                    heappush(heap, r << high | i << wide | end[k])
            if (h := before[i]) >= 0:
                part = piece[h:stop]
                if (r := met(part)) is None:
                    r = known(part)
                if r >= 0:
                    heappush(heap, r << high | h << wide | stop)
        ids, i = [], 0
        while i < n:
            ids.append(known(piece[i : end[i]]))
            i = after[i]
        return ids

    def __missing__(self, word: str) -> bytes:
        piece = word.encode("utf-8", "surrogatepass")
        i = self.rank(piece)
        ids = [i] if i >= 0 else self.merged(piece)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, pattern)
    return _ENCODERS[key]


def _coded(path: str, pattern: str, digests: bool):
    kinds = ("n_tokens", pa.int64()), *((("ids_sha256", pa.string()), ("decoded_sha256", pa.string())) if digests else (("ids", pa.list_(pa.int64())), ("decoded", pa.binary())))
    schema = pa.schema([("doc_id", pa.int64()), *kinds])

    def work(docs, texts):
        code = encoder(path, pattern)
        n, a, b = [], [], []
        for text in texts:
            ids = code.ids(text or "")
            back = code.decoded(ids)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<u4"))
            b.append(hashlib.sha256(back).hexdigest() if digests else back)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((docs, n, a, b), schema, strict=True)], schema=schema)

    return work


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<long>, decoded binary) of every row, or the SHA-256 of either."""
    path = path or public_tokenizers.path(VOCABULARY)
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded binary"
    return map_arrow(docs.select("doc_id", "text"), _coded(path, pattern, digests), f"doc_id long, n_tokens long, {kinds}")
