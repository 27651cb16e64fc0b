"""Best-fit packing by best-two-fit over the length histogram.

Documents longer than ``size`` are cut into pieces of ``size`` ids and a last one; full pieces are sequences of their
own. The histogram of the other lengths (at most size - 1 bins, whatever the input) goes to the driver. A
bin is filled greedily, the longest length that fits next; then its smallest piece is taken out if two pieces not yet
packed fit the gap that this leaves more tightly, and again while that helps. As many copies of the bin are made as its
lengths allow, so the work grows with the number of lengths and not with the documents: each round uses up a length or
leaves fewer of it than one bin takes.

Back on Spark, a piece's rank among those of its length (row numbers within slices of a length, plus the running counts of the
slices) says which bin and place is its own; tasks look it up by bisection in the table of places.

Ids are the untouched library's, special tokens' strings included. A worker remembers words up to a number of bytes.

Defined results: a null text and an empty one are the single id 0; rows repeating one id and text are packed each; null ids are kept; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemark.llm.packing import BYTE_CHARACTERS
from telemark.llm.rows import map_arrow
from telemark.session import settle

VOCABULARY = "word_bpe_49k.json"
SIZE = 2048
#: Pieces of one length that one task ranks together.
SLICE_ROWS = 4096
#: Bytes of stretches, ids and table entries that a worker remembers, and the longest stretch it keeps.
REMEMBERED_BYTES, ENTRY_BYTES, LONGEST = 64 << 20, 200, 64
_ENCODERS: dict[str, _Encoder] = {}
#: The Latin letters that normal form C leaves alone, and the vocabulary's words in lower-cased texts of these and ASCII.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\t-\r {LETTERS}0-9]+").findall


class _Remembered(dict):
    """Words -> their ids as bytes, up to a number of bytes."""

    def __init__(self, ask: Callable[[str], list[int]]) -> None:
        self.ask, self.left = ask, REMEMBERED_BYTES

    def __missing__(self, word: str) -> bytes:
        found = self.ask(word)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONGEST:
            self.left -= ENTRY_BYTES + len(ids)
            if self.left < 0:
                self.clear()
                self.left = REMEMBERED_BYTES
            self[word] = ids
        return ids


def _written(word: str) -> str:
    """In the vocabulary's characters; those of printable ASCII are its own."""
    return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTE_CHARACTERS)


class _Encoder:
    """Ids of the untouched library. Texts of ASCII and Latin letters are lower-cased and split here, and the library's model is asked
    for each new word; other texts and those with a special token's string go to the library in stretches without white space."""

    def __init__(self, path: str) -> None:
        library = Tokenizer.from_file(path)
        model = library.model
        special = "|".join(re.escape(t.content) for t in library.get_added_tokens_decoder().values())
        self.other = re.compile(rf"[^\x00-\x7f{LETTERS}]" + (f"|{special}" if special else "")).search
        self.words = _Remembered(lambda word: [t.id for t in model.tokenize(_written(word))])
        self.stretches = _Remembered(lambda stretch: library.encode(stretch, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.other(text):
            # ASCII white space only: what else counts as white space is the library's to say
            return b"".join([self.stretches[x.decode("utf-8", "surrogatepass")] for x in text.encode("utf-8", "surrogatepass").split()])
        return b"".join(map(self.words.__getitem__, _WORDS(text.lower())))


def encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(path: str, size: int):
    def work(ids, texts):
        encode = encoder(path).ids
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, text in zip(ids, texts, strict=True):
            raw = encode(text) + b"\0\0\0\0"
            for k, at in enumerate(range(0, len(raw), 4 * size)):
                part = raw[at : at + 4 * size]
                for column, value in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECE, strict=True)], schema=PIECE)

    return work


def bins(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(copies, [(length, times)]) of each bin: filled greedily, its smallest piece changed for two that fit better."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    lengths, out = np.arange(size + 1), []

    def below() -> np.ndarray:
        """The longest length left that is at most each length; 0 if there is none."""
        return np.maximum.accumulate(np.where(counts > 0, lengths, 0))

    fits = below()
    while fits[size]:
        taken: dict[int, int] = {}
        gap = size

        def take(length: int, times: int) -> None:
            taken[length] = taken.get(length, 0) + times
            counts[length] -= times

        while gap and fits[gap]:
            length = int(fits[gap])
            times = int(min(gap // length, counts[length]))
            take(length, times)
            gap -= times * length
            fits = below()
        while gap:
            least = min(taken)
            room = gap + least
            first = lengths[1:room][counts[1:room] > 0]
            # two of one length need two of it; otherwise the other one is shorter
            second = fits[np.minimum(np.where(counts[first] > 1, first, first - 1), room - first)]
            both = np.where(second > 0, first + second, 0)
            if not len(both) or both.max() <= least:
                break
            best = int(both.argmax())
            taken[least] -= 1
            counts[least] += 1
            if not taken[least]:
                del taken[least]
            for length in (int(first[best]), int(second[best])):
                take(length, 1)
            gap = room - int(both[best])
            fits = below()
        more = min(int(counts[length]) // times for length, times in taken.items())
        for length, times in taken.items():
            counts[length] -= more * times
        out.append((1 + more, sorted(taken.items(), reverse=True)))
        fits = below()
    return out


def places(made: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted: the ranks of a length, each bin's in a row."""
    out, sequence, ranked = [], 0, {}
    for copies, content in made:
        offset = 0
        for length, times in content:
            first = ranked.get(length, 0)
            out.append((length, first, times, sequence, offset))
            ranked[length] = first + copies * times
            offset += length * times
        sequence += copies
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _placed(table: np.ndarray):
    """Rows of ``table`` are bounded by the bins of distinct content, not by the input."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    length, first, times, sequence, offset = table.T
    begin = {int(n): np.searchsorted(length, (n, n + 1)).tolist() for n in np.unique(length)}

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            size, rank = (columns[k].to_numpy() for k in (3, 5))
            at = np.zeros(len(size), np.int64)
            for n in np.unique(size):
                own = slice(*begin[int(n)])
                here = size == n
                at[here] = own.start + np.searchsorted(first[own], rank[here], side="right") - 1
            copy, nth = np.divmod(rank - first[at], times[at])
            columns[5:] = [pa.array(sequence[at] + copy), pa.array(offset[at] + nth * size)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:5], "sequence_id", "offset"])

    return run


def best_fit_packed(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    path = path or public_tokenizers.path(VOCABULARY)
    pieces = settle(
        map_arrow(docs.select("doc_id", "text"), _pieces(path, size), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces"
    )
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``size`` rows
    table = places(bins(histogram, size))
    slices = max(1, -(-max(histogram.values(), default=1) // SLICE_ROWS))
    pieces = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(slices)))
    counted = pieces.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("length", "_slice").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_row", F.row_number().over(within)).join(shifts, ["length", "_slice"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_row") - 1 + F.col("_shift")).cast("long").alias("rank"))
    return ranked.mapInArrow(_placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
