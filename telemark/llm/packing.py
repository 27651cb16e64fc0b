"""Packing by shortest-pack-first over the length histogram.

Each document's ids end with one 0 and are cut every ``size`` ids; full pieces are sequences of their own. The
histogram of the other lengths (at most size - 1 bins, whatever the input) goes to the
driver, where lengths are placed longest first, each into the shortest packs it fits, many
copies of a pattern at a time. The patterns come back as slots: for every length, which
of its pieces by rank fall into which pattern and copy. A piece's rank within its length comes from row numbers
within slices of a length plus the slices' running counts, so a length that a third of all pieces share is no one task's work.

Ids are the untouched library's: an added token's string in a text is that token.

Defined results: a null text and an empty one are the single id 0; rows with equal ids are packed each
(their ranks are told apart by start and contents only, so equal rows are interchangeable); a null id is kept as null; an empty table
gives an empty result; extra columns are not read. The last sequence may be short, like any other.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemark.llm.bpe import splitter
from telemark.llm.rows import map_arrow
from telemark.session import settle

VOCABULARY = "byte_bpe_50k.json"
#: Pieces of one length that one task ranks together.
SLICE_ROWS = 200_000
#: Bytes of pre-tokens, ids and table entries that a worker remembers before it starts anew, and the longest pre-token it keeps.
REMEMBERED_BYTES, ENTRY_BYTES, LONGEST = 48 << 20, 200, 64

def _byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


BYTE_CHARACTERS = _byte_characters()
_ENCODERS: dict[str, _Encoder] = {}


class _Encoder(dict):
    """Pre-token -> its ids as bytes; the tokenizer is asked once for each pre-token met."""

    def __init__(self, path: str) -> None:
        library = Tokenizer.from_file(path)
        self.model, self.left = library.model, REMEMBERED_BYTES
        self.split = splitter(public_tokenizers.PATTERN)
        # added tokens come before the pattern, as in the untouched library
        self.added = {t.content: struct.pack("<I", i) for i, t in library.get_added_tokens_decoder().items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split if self.added else lambda text: [text]

    def __missing__(self, word: str) -> bytes:
        found = self.model.tokenize(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_CHARACTERS))
        ids = struct.pack(f"<{len(found)}I", *[token.id for token in found])
        if len(word) <= LONGEST:
            self.left -= ENTRY_BYTES + len(ids)
            if self.left < 0:
                self.clear()
                self.left = REMEMBERED_BYTES
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = self.parts(text)
        if len(parts) == 1:
            return b"".join(map(self.__getitem__, self.split(text)))
        return b"".join(self.added[p] if k % 2 else b"".join(map(self.__getitem__, self.split(p))) for k, p in enumerate(parts))


def encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _pieces(path: str, size: int):
    def work(ids, texts):
        encode = encoder(path).ids
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, text in zip(ids, texts, strict=True):
            raw = encode(text or "") + b"\0\0\0\0"
            n = len(raw) // 4
            for at in range(0, n, size):
                part = raw[4 * at : 4 * (at + size)]
                for column, value in zip(out, (i, at, len(part) // 4, zlib.crc32(part), n), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECE, strict=True)], schema=PIECE)

    return work


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(copies, lengths) of every packing pattern: lengths longest first, each into the shortest pack it fits."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # sum of lengths -> [copies, lengths]
    sums: list[int] = []
    for length in sorted(histogram, reverse=True):
        left, made = histogram[length], []
        while left:
            if sums and sums[0] + length <= size:
                shortest = sums[0]
                copies, lengths = open_packs[shortest].pop()
                if not open_packs[shortest]:
                    sums.pop(0)
                used = min(copies, left)
                if used < copies:
                    made.append((shortest, [copies - used, lengths]))
                made.append((shortest + length, [used, (*lengths, length)]))
            else:
                # as many of this length to a pack as fit; an odd rest makes one shorter pack
                each = min(size // length, left)
                used = left // each
                made.append((each * length, [used, (length,) * each]))
                used *= each
            left -= used
            for total, pack in made:
                if not open_packs[total]:
                    bisect.insort(sums, total)
                open_packs[total].append(pack)
            made = []
    return sorted((copies, lengths) for packs in open_packs.values() for copies, lengths in packs)


def _slots(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies, first sequence, offset) of each place in each pattern."""
    out, sequence, ranked = [], 0, defaultdict(int)
    for copies, lengths in patterns(histogram, size):
        offset = 0
        for length in lengths:
            out.append((length, ranked[length], copies, sequence, offset))
            ranked[length] += copies
            offset += length
        sequence += copies
    return out


def packed(docs: DataFrame, size: int = 1024, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    path = path or public_tokenizers.path(VOCABULARY)
    pieces = settle(
        map_arrow(docs.select("doc_id", "text"), _pieces(path, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces"
    )
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    slots = _slots(counts, size)
    slices = max(1, -(-max(counts.values(), default=1) // SLICE_ROWS))
    pieces = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slices)))
    counted = pieces.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("length", "_slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_row", F.row_number().over(within)).join(shifts, ["length", "_slice"]).withColumn("_rank", F.col("_row") - 1 + F.col("_shift"))
    # a length's slots as one sorted array; slots are bounded by the number of patterns, not by the input
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length long, first long, copies long, sequence long, offset long")
    table = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "copies", "sequence", "offset"))).alias("_slots"))
    slot = F.element_at(F.filter("_slots", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["first"] + s["copies"])), 1)
    return ranked.join(F.broadcast(table), "length").withColumn("_slot", slot).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_slot.sequence") + F.col("_rank") - F.col("_slot.first")).alias("sequence_id"),
        F.col("_slot.offset").alias("offset"),
    )
