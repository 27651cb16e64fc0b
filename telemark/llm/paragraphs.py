"""Paragraph dedup: min-hash bands find paragraphs that look alike, exact Jaccard decides, components name the removals.

A paragraph is a line of at least ``min_words`` words (three shingle widths unless said otherwise).
Paragraphs with the same shingle set are one class. Classes that collide in a band are first compared with the
first ``LEADERS`` of the bucket in an order of the band's own: every pair of a small bucket, a few
stars over a large one. What the stars left of a large bucket in different components is cut into groups of some
``GROUP`` classes, and each two groups are compared exactly, so every pair that collides is compared or
already connected. The bands are tuned so that a pair at the threshold collides with
probability ``RECALL`` at least. In each component the first occurrence by (doc_id, text, place) stays.

Passages of at least ``PASSAGE`` words are found whatever the line breaks, in what the line stage leaves: every run of
``PASSAGE`` words that stands in an earlier place too is a repeat. Texts are winnowed first: of each ``PASSAGE`` words the
smallest hash of its runs of ``GRAM`` words is selected, and only windows whose selected hash occurs twice are
written out and compared, all of them, in buckets by that hash; a hash with more than ``HOT`` places is dealt to several buckets by
document, whose first places are found before. Windows in a row leave a bucket as one stretch with its first and last
word. Passages are equal word by word; likeness is for lines only.

Defined results: null and empty texts have no paragraphs, short lines only as parts of passages; a text that
goes on repeating itself within ``PASSAGE`` words is one place, not many; a passage does not reach across a line that is cut,
and the white space around a cut passage stays; rows with a null id keep
their text and take part in nothing; equal rows of one id are one document, rows of one id with
different texts are told apart by their text; a text may become empty but its row stays; an
empty table gives an empty result; extra columns are handed through unread.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemark.llm.components import components
from telemark.llm.rows import _FACTORS, _permutations, alike, give_back, map_arrow, mixed, only, words
from telemark.session import settle

WIDTH, PERCENT, MIN_WORDS = 5, 80, 15
RECALL, MOST_HASHES, LEADERS = 0.999, 48, 4
#: Classes of a bucket compared in one block, and shingles counted at once in it.
GROUP, SLAB = 128, 4096
#: Shingles whose min-hashes are taken at once.
BLOCK = 65_536
#: Words of a passage, and of the runs by which its windows are selected.
PASSAGE, GRAM = 51, 26
#: Windows of a bucket, and places from which a gram's windows are dealt to several.
BUCKET, HOT = 2_000_000, 4096
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def tuned(percent: int = PERCENT, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows per band): the most rows whose bands reach ``recall`` within ``most`` hashes."""
    at = percent / 100
    best = (math.ceil(math.log(1 - recall) / math.log(max(1e-9, 1 - at))), 1)
    for rows in range(2, 12):
        n = math.ceil(math.log(1 - recall) / math.log(1 - at**rows))
        if n * rows <= most:
            best = (n, rows)
    return best


class _Paragraphs:
    """The paragraphs of some texts: ``places`` (text, line, start, length), their sorted shingle sets in a row, and each set's name."""

    def __init__(self, texts: list[str | None], width: int, min_words: int) -> None:
        places, found, count = [], [], []
        for k, text in enumerate(texts):
            text = text or ""
            raw = text.encode("utf-8", "surrogatepass").lower().split(b"\n")
            start = 0
            for i, (part, n) in enumerate(zip(raw, map(len, raw if text.isascii() else text.split("\n")), strict=True)):
                if n >= 2 * min_words - 1:
                    split = part.split()
                    if len(split) >= min_words:
                        places.append((k, i, start, n))
                        found += split
                        count.append(len(split))
                start += n + 1
        self.places = np.array(places, np.int64).reshape(-1, 4)
        h, m = _hashed(found), np.array(count, np.int64)
        takes = np.minimum(m, width)
        sizes = m - takes + 1
        owner = np.repeat(np.arange(len(m)), sizes)
        at = np.arange(len(owner)) + np.repeat(np.cumsum(m) - m - np.cumsum(sizes) + sizes, sizes)
        take = takes[owner]
        s = take.astype(np.uint64)
        for j in range(width if len(h) else 0):
            s += np.where(j < take, h[np.minimum(at + j, len(h) - 1)] * _FACTORS[j], np.uint64(0))
        s = mixed(s)
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        keep = np.r_[True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])][: len(s)]
        self.s, owner = s[keep], owner[keep]
        self.begin = np.searchsorted(owner, np.arange(len(m)))
        self.end = np.r_[self.begin[1:], len(self.s)]
        sums = np.add.reduceat(mixed(self.s ^ _FACTORS[7]), self.begin) if len(m) else np.empty(0, np.uint64)
        self.names = mixed(sums + (self.end - self.begin).astype(np.uint64) * _FACTORS[8]).view(np.int64)

    def bands(self, hashes: int, rows: int) -> np.ndarray:
        """[paragraph, band] keys of ``rows`` min-hashes each; the band number is part of a key."""
        a, b = (x[:, 0] for x in _permutations(hashes, 11))
        low, at = np.empty((hashes, len(self.begin)), np.uint64), 0
        while at < len(self.begin):
            upto = max(at + 1, int(np.searchsorted(self.begin, self.begin[at] + BLOCK)))
            block, begin = self.s[self.begin[at] : self.end[upto - 1]], self.begin[at:upto] - self.begin[at]
            for j in range(hashes):
                x = block * a[j]
                x += b[j]
                x ^= x >> np.uint64(32)
                x *= np.uint64(0xD6E8FEB86659FD93)
                low[j, at:upto] = np.minimum.reduceat(x, begin)
            at = upto
        keys = np.empty((len(self.begin), hashes // rows), np.uint64)
        for k in range(hashes // rows):
            keys[:, k] = mixed(sum(low[k * rows + j] * _FACTORS[j] for j in range(rows)) + np.uint64(k + 1))
        return keys.view(np.int64)


def _found(width: int, min_words: int, rows: int, hashes: int):
    names = ["doc_id", "version", "line", "start", "length", "class", "bands"]

    def work(ids, versions, texts):
        found = _Paragraphs(texts, width, min_words)
        text, line, start, length = found.places.T
        keys = found.bands(hashes, rows)
        at = pa.array(np.arange(0, keys.size + 1, hashes // rows), pa.int32())
        columns = [np.array(ids, np.int64)[text], np.array(versions, np.int64)[text], line.astype(np.int32), start, length, found.names]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(at, pa.array(keys.ravel()))], names=names)

    return work


def _classes(width: int, min_words: int):
    def work(texts):
        found = _Paragraphs(texts, width, min_words)
        names, first = np.unique(found.names, return_index=True)
        sets = [found.s[a:b].tobytes() for a, b in zip(found.begin[first], found.end[first], strict=True)]
        yield pa.RecordBatch.from_pydict({"class": names, "s": sets}, pa.schema([("class", pa.int64()), ("s", pa.binary())]))

    return work


def _verified(percent: int):
    def work(a, b, x, y):
        ok = [alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"a": [v for v, k in zip(a, ok, strict=True) if k], "b": [v for v, k in zip(b, ok, strict=True) if k]}, LINKS
        )

    return work


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set of ``x`` shares with each of ``y``."""
    tokens = [np.concatenate(x), np.concatenate(y)]
    owners = [np.repeat(np.arange(len(z)), [len(s) for s in z]) for z in (x, y)]
    both = np.intersect1d(*tokens)
    out = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, len(both), SLAB):
        part, tables = both[at : at + SLAB], []
        for token, owner, z in zip(tokens, owners, (x, y), strict=True):
            place = np.searchsorted(part, token)
            place[place == len(part)] = 0
            hit = part[place] == token
            table = np.zeros((len(z), len(part)), np.float32)
            table[owner[hit], place[hit]] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def _compared(percent: int):
    """Links of every class of one group with every class of another (or its own), one for each two components."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, comps, raws, other_ids, other_comps, other_raws = (c[0].as_py() for c in batch.slice(at, 1).columns)
                x, y = ([np.frombuffer(s, np.uint64) for s in r] for r in (raws, other_raws))
                n, both = np.add.outer([len(s) for s in x], [len(s) for s in y]), _overlaps(x, y)
                c, d = np.array(comps), np.array(other_comps)
                i, j = np.nonzero((100 * both >= percent * (n - both)) & (c[:, None] != d))
                ends = np.stack([np.minimum(c[i], d[j]), np.maximum(c[i], d[j])], axis=1)
                first = np.unique(ends, axis=0, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[i[first]]), pa.array(np.array(other_ids)[j[first]])], schema=LINKS)

    return run


def _rest_links(banded: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside the buckets of more than ``LEADERS`` + 1 classes between what the stars left in different components."""
    placed = banded.join(components(linked).withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = (
        placed.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where((F.col("n") > LEADERS + 1) & (F.col("low") < F.col("high"))).select("band")
    )
    placed = settle(placed.join(mixed, "band").select("band", "class", "component"), "placed")
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > GROUP)
    rest = sizes.where(F.col("size") <= GROUP).groupBy("band").agg(F.sum("size").alias("rest"))
    # large components in groups of their own, what is left of a bucket in common ones
    alone = F.xxhash64("band", "component", F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / GROUP)))
    common = F.xxhash64("band", F.lit("rest"), F.pmod(F.xxhash64("component"), F.ceil(F.col("rest") / GROUP)))
    groups = placed.join(large, ["band", "component"], "left").join(rest, "band", "left").select(
        "band", "class", "component", F.when(F.col("size").isNotNull(), alone).otherwise(common).alias("grp")
    )
    unions = groups.join(sets, "class").groupBy("band", "grp").agg(F.collect_list(F.struct("class", "component", "s")).alias("m"))
    unions = settle(unions.select("band", "grp", F.col("m.class").alias("ids"), F.col("m.component").alias("comps"), F.col("m.s").alias("sets")), "unions")
    blocks = unions.select("band", "grp", F.array_min("comps").alias("low"), F.array_max("comps").alias("high"))
    other = blocks.select("band", F.col("grp").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = blocks.join(other, "band").where("grp <= other and not (low = high and low2 = high2 and low = low2)").select("band", "grp", "other")
    second = unions.select("band", F.col("grp").alias("other"), F.col("ids").alias("ids2"), F.col("comps").alias("comps2"), F.col("sets").alias("sets2"))
    rows = pairs.join(unions, ["band", "grp"]).join(second, ["band", "other"]).select("ids", "comps", "sets", "ids2", "comps2", "sets2")
    return settle(rows.mapInArrow(_compared(percent), "a long, b long"), "links")


def _lines(texts: DataFrame, width: int, percent: int, min_words: int) -> DataFrame:
    n, rows = tuned(percent)
    found = settle(
        map_arrow(texts, _found(width, min_words, rows, n * rows), "doc_id long, version long, line int, start long, length long, class long, bands array<long>"),
        "paragraphs",
    )
    places = found.select("doc_id", "version", "line", "start", "length", "class").distinct()
    classes = found.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    banded = classes.select("class", F.explode("bands").alias("band"))
    sized = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    banded = settle(banded.join(sized, "band"), "banded")
    order = Window.partitionBy("band").orderBy(F.xxhash64("class", "band"), "class")
    leaders = banded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS).select("band", F.col("class").alias("leader"))
    pairs = settle(
        banded.join(leaders, "band").where("class <> leader")
        .select(F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct(),
        "pairs",
    )
    asked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    asked = settle(classes.join(asked, "class").select("class", "doc_id"), "asked")
    need = settle(asked.select("doc_id").distinct(), "need")
    sets = map_arrow(only(texts, need).select("text"), _classes(width, min_words), "class long, s binary")
    sets = settle(sets.join(asked.select("class"), "class", "left_semi").dropDuplicates(["class"]), "sets")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("s").alias("x")), "a").join(
        sets.select(F.col("class").alias("b"), F.col("s").alias("y")), "b"
    ).select("a", "b", "x", "y")
    linked = settle(map_arrow(both, _verified(percent), "a long, b long"), "links")
    joined = components(linked.unionByName(_rest_links(banded, linked, sets, percent)))
    placed = places.join(joined.withColumnRenamed("id", "class"), "class", "left").withColumn("cluster", F.coalesce("component", "class"))
    first = placed.groupBy("cluster").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "version", "line")).alias("first")).where("copies > 1")
    return placed.join(first, "cluster").select(
        "doc_id", "version", "line", "start", "length", "cluster", "copies",
        (F.struct("doc_id", "version", "line") == F.col("first")).alias("kept"),
    )


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hashed(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in a row, from prefix sums of a polynomial."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)]
    return mixed((sums[size:] - sums[:-size]) * _powers(pow(_BASE, -1, 2**64), len(h) - size + 1))


def _slid(x: np.ndarray, n: int, of: Callable) -> np.ndarray:
    """The least or greatest of every ``n`` values in a row."""
    have = 1
    while 2 * have <= n:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[: len(x) - n + have], x[n - have :])


def _selected(grams: np.ndarray) -> np.ndarray:
    """The smallest gram of every window of ``PASSAGE`` words."""
    return _slid(grams, PASSAGE - GRAM + 1, np.minimum)


def _winnowed(ids, versions, texts):
    """The grams that windows of a text select, each once a text with the number ``n`` of its places there: a text that goes
    on repeating a few words selects one gram at every turn."""
    found, sizes, which = [], [], []
    for k, text in enumerate(texts):
        split = words(text)
        if len(split) >= PASSAGE:
            found += split
            sizes.append(len(split))
            which.append(k)
    if not which:
        return
    text = np.repeat(which, sizes)
    grams = _windows(_hashed(found), GRAM)
    chosen = np.where(text[: 1 - PASSAGE] == text[PASSAGE - 1 :], _selected(grams), np.uint64(0))
    room = np.zeros(PASSAGE - GRAM, np.uint64)
    at = np.flatnonzero(_slid(np.r_[room, chosen, room], PASSAGE - GRAM + 1, np.maximum) == grams)
    text, gram = text[at], grams[at]
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    first = np.flatnonzero(_changes(text, gram))
    n = np.diff(np.r_[first, len(text)]).astype(np.int32)
    text = text[first]
    columns = [np.array(ids, np.int64)[text], np.array(versions, np.int64)[text], gram[first].view(np.int64), n]
    yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["doc_id", "version", "gram", "n"])


class _Stream:
    """The words of some texts in a row, without those of lines that are cut; ``stretch`` differs where a text or a cut line lies between."""

    def __init__(self, texts: list[str], cuts: list[list[int] | None]) -> None:
        whole = "\n".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = (code == 32) | ((code >= 9) & (code <= 13))
        self.start = np.flatnonzero(~space & np.r_[True, space[:-1]][: len(code)])
        self.end = np.flatnonzero(~space & np.r_[space[1:], True][: len(code)]) + 1
        feeds = np.flatnonzero(code == 10)
        found = np.array(whole.encode("utf-8", "surrogatepass").lower().split(), object)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        first = np.searchsorted(feeds, begin)  # each text's first line, of all
        self.text = np.searchsorted(begin, self.start, side="right") - 1
        line = np.searchsorted(feeds, self.start)
        gone = np.array(sorted(int(first[k]) + c for k, cut in enumerate(cuts) for c in cut or ()), np.int64)
        keep = ~np.isin(line, gone)
        self.start, self.end, self.text, line = (x[keep] for x in (self.start, self.end, self.text, line))
        self.h = _hashed(found[keep].tolist())
        before = np.searchsorted(gone, line)
        self.stretch = before + self.text
        self.line = line - first[self.text]
        # words are counted within a text, with room between stretches
        own = np.searchsorted(self.text, self.text)
        self.at = np.arange(len(self.h)) - own + (PASSAGE + 1) * (before - np.searchsorted(gone, first[self.text]))
        self.start, self.end = self.start - begin[self.text], self.end - begin[self.text]


def _part(gram: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(gram + part.astype(np.uint64) * _FACTORS[3]) >> np.uint64(11)).astype(np.int64) % buckets


#: Windows of a batch that go to one bucket: two columns a text met there, the others a window.
_PACKED = ("doc_id", "version", "count", "h", "gram", "parts", "run", "at", "line", "start", "end")
_TYPES = dict(zip(_PACKED, (np.int64, np.int64, np.int32, np.uint64, np.uint64, np.int32, *[np.int32] * 5), strict=True))


def _placed_windows(buckets: int):
    """Windows whose selected gram is shared, by bucket; ``run`` is the first place of equal windows that overlap in a row.

    A gram's windows are in one bucket, or in ``parts`` of them by text if it stands in many places."""

    def work(ids, versions, texts, cuts, grams, hot):
        words = _Stream(texts, cuts)
        if len(words.h) < PASSAGE:
            return
        chosen = _selected(_windows(words.h, GRAM))
        shared = np.unique(np.concatenate([np.array(g, np.int64) for g in grams])).view(np.uint64)
        k = np.flatnonzero((words.stretch[: 1 - PASSAGE] == words.stretch[PASSAGE - 1 :]) & np.isin(chosen, shared))
        if not len(k):
            return
        h, gram, text, at = _windows(words.h, PASSAGE)[k], chosen[k], words.text[k], words.at[k]
        order = np.lexsort((at, h, text))
        same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1]) & (np.diff(at[order]) < PASSAGE)
        begun = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))
        run = np.empty(len(order), np.int64)
        run[order] = at[order][begun]
        many = sorted({(np.int64(x["gram"]).view(np.uint64), x["parts"]) for some in hot for x in some or ()})
        parts = np.ones(len(k), np.int64)
        if many:
            often = np.array([g for g, _ in many], np.uint64)
            place = np.minimum(np.searchsorted(often, gram), len(often) - 1)
            parts = np.where(often[place] == gram, np.array([n for _, n in many])[place], 1)
        ids, versions = np.array(ids, np.int64)[text], np.array(versions, np.int64)[text]
        to = _part(gram, (mixed(ids.view(np.uint64) ^ versions.view(np.uint64)) >> np.uint64(8)).astype(np.int64) % parts, buckets)
        values = {
            "doc_id": ids, "version": versions, "h": h, "gram": gram, "parts": parts, "run": run, "at": at,
            "line": words.line[k], "start": words.start[k], "end": words.end[k + PASSAGE - 1],
        }
        order = np.lexsort((at, text, parts > 1, to))
        values = {c: v[order].astype(_TYPES[c]) for c, v in values.items()}
        to, text, often = to[order], text[order], (parts > 1)[order]
        new_row = np.r_[True, (to[1:] != to[:-1]) | (often[1:] != often[:-1])]
        new_text = new_row | np.r_[True, text[1:] != text[:-1]]
        firsts = np.flatnonzero(new_text)
        values["count"] = np.diff(np.r_[firsts, len(to)]).astype(np.int32)
        for c in ("doc_id", "version"):
            values[c] = values[c][firsts]
        cut = np.r_[np.flatnonzero(new_row), len(to)]
        texts_cut = np.searchsorted(firsts, cut)
        out = {"bucket": to[cut[:-1]], "hot": often[cut[:-1]]}
        for c in _PACKED:
            ends = texts_cut if c in ("doc_id", "version", "count") else cut
            out[c] = [b"" if c in ("gram", "parts") and not f else values[c][a:b].tobytes() for a, b, f in zip(ends[:-1], ends[1:], out["hot"], strict=True)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, out.values())], names=list(out))

    return work


def _unpacked(rows: dict[str, list[bytes]]) -> dict[str, np.ndarray]:
    out = {c: np.frombuffer(b"".join(rows[c]), _TYPES[c]) for c in _PACKED}
    for c in ("doc_id", "version"):
        out[c] = np.repeat(out[c], out["count"])
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _hot_firsts(*columns):
    """The first place of each window of the hot grams in these rows, and the number of its places."""
    x = _unpacked(dict(zip(_PACKED, columns, strict=True)))
    order = np.lexsort((x["run"], x["version"], x["doc_id"], x["h"]))
    x = {c: x[c][order] for c in ("h", "gram", "parts", "doc_id", "version", "run")}
    new = _changes(x["h"], x["doc_id"], x["version"], x["run"])
    first = np.flatnonzero(_changes(x["h"]))
    out = [x[c][first] for c in ("h", "gram", "parts", "doc_id", "version", "run")]
    out = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64) for c in out]
    yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(np.add.reduceat(new.astype(np.int64), first))], names=["h", "gram", "parts", "doc_id", "version", "run", "places"])


def _to_parts(buckets: int):
    """One row for each bucket that may hold windows of a hot gram."""

    def work(h, gram, parts, doc_id, version, run):
        n = np.array(parts, np.int64)
        row = np.repeat(np.arange(len(n)), n)
        part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        to = _part(np.array(gram, np.int64).view(np.uint64)[row], part, buckets)
        columns = [to, *(np.array(c, np.int64)[row] for c in (h, doc_id, version, run))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["bucket", "h", "doc_id", "version", "run"])

    return work


SPAN_DDL = "doc_id long, version long, kept boolean, first int, last int, line int, start int, end int, nodes array<long>"


def _spans(left: pa.Table, right: pa.Table) -> pa.Table:
    """Stretches of repeated windows in one bucket, those of first places apart: equal windows share a ``node``, by which
    a repeat is linked with its first place."""
    packed = {c: left.column(c).to_pylist() for c in _PACKED}
    x = _unpacked(packed)
    flags = np.repeat(np.array(left.column("hot").to_pylist(), bool), np.array([len(h) // 8 for h in packed["h"]], np.int64))
    del x["gram"], x["parts"], x["count"]
    place = ("doc_id", "version", "run")
    # windows of one bucket only: the first of the equal ones by place
    order = np.lexsort((x["run"], x["version"], x["doc_id"], x["h"]))
    order = order[~flags[order]]
    first = np.flatnonzero(_changes(x["h"][order]))
    ends = np.r_[first[1:], len(order)][: len(first)] - 1
    size = ends - first + 1
    repeated = np.zeros(len(size), bool)
    for c in place:
        repeated |= x[c][order[first]] != x[c][order[ends]]
    low = {c: np.repeat(x[c][order[first]], size) for c in place}
    own = np.repeat(repeated, size)
    rows, low = order[own], {c: v[own] for c, v in low.items()}
    # windows of hot grams: by the places found over all buckets
    hot = np.flatnonzero(flags)
    if len(hot) and right.num_rows:
        h = right.column("h").to_numpy().view(np.uint64)
        by = np.argsort(h)
        at = np.minimum(np.searchsorted(h[by], x["h"][hot]), len(h) - 1)
        known = h[by][at] == x["h"][hot]
        hot, at = hot[known], by[at[known]]
        rows, low = np.r_[rows, hot], {c: np.r_[low[c], right.column(c).to_numpy()[at]] for c in place}
    kept = np.ones(len(rows), bool)
    for c in place:
        kept &= x[c][rows] == low[c]
    order = np.lexsort((x["at"][rows], kept, x["version"][rows], x["doc_id"][rows]))
    rows, kept, low = rows[order], kept[order], {c: v[order] for c, v in low.items()}
    x = {c: v[rows] for c, v in x.items()}
    flags = flags[rows]
    shift = np.where(kept, 0, low["run"] - x["at"])
    new = _changes(x["doc_id"], x["version"], kept, x["at"] - np.arange(len(rows)), shift, *(np.where(kept, 0, low[c]) for c in ("doc_id", "version")))
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(rows)][: len(first)] - 1
    asked = np.zeros(len(rows), bool)
    asked[first] = True
    asked &= ~kept
    asked |= kept & (flags | np.isin(x["h"], x["h"][asked]))
    nodes = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(np.add.reduceat(asked.astype(np.int32), first))] if len(first) else [0], pa.int32()), pa.array(x["h"][asked].view(np.int64))
    )
    columns = [
        x["doc_id"][first], x["version"][first], kept[first], x["at"][first], x["at"][last], x["line"][first], x["start"][first], x["end"][last],
    ]
    return pa.Table.from_arrays([*map(pa.array, columns), nodes], names=["doc_id", "version", "kept", "first", "last", "line", "start", "end", "nodes"])


def _spans_of(left: pa.Table, right: pa.Table) -> pa.Table:
    out = _spans(left, right)
    give_back()
    return out


def _passages(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row per passage that stands in two places or more, outside the lines of ``cuts`` (doc_id, version, lines)."""
    key = ["doc_id", "version"]
    grams = settle(map_arrow(texts, _winnowed, "doc_id long, version long, gram long, n int"), "grams")
    shared = settle(grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1"), "shared")
    hot = F.when(F.col("n") > HOT, F.struct("gram", F.ceil(F.col("n") / HOT).alias("parts")))
    asked = settle(
        grams.drop("n").join(shared, "gram").groupBy(*key).agg(F.collect_set("gram").alias("grams"), F.collect_set(hot).alias("hot")).join(cuts, key, "left"), "asked"
    )
    need = settle(asked.select("doc_id").distinct(), "need")
    rows = only(texts, need).join(asked, key).select(*key, "text", "lines", "grams", "hot")
    # a place of a gram is selected by 26 windows at most
    most = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (PASSAGE - GRAM + 1)
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // BUCKET))
    packed = "bucket long, hot boolean, " + ", ".join(f"{c} binary" for c in _PACKED)
    windows = settle(map_arrow(rows, _placed_windows(buckets), packed), "windows")
    found = "h long, gram long, parts long, doc_id long, version long, run long"
    firsts = map_arrow(windows.where("hot").select(*_PACKED), _hot_firsts, found + ", places long")
    firsts = firsts.groupBy("h").agg(
        F.min("gram").alias("gram"), F.min("parts").alias("parts"), F.min(F.struct("doc_id", "version", "run")).alias("first"), F.sum("places").alias("places")
    ).where("places > 1").select("h", "gram", "parts", "first.*")
    firsts = map_arrow(firsts, _to_parts(buckets), "bucket long, h long, doc_id long, version long, run long")
    spans = settle(windows.groupBy("bucket").cogroup(firsts.groupBy("bucket")).applyInArrow(_spans_of, SPAN_DDL), "spans")
    order = Window.partitionBy(*key, "kept").orderBy("first")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = F.when(F.col("first") - reached <= PASSAGE, None).otherwise(F.col("first"))
    found = spans.withColumn("begun", begun).withColumn("begun", F.last("begun", True).over(order))
    found = settle(found.withColumn("id", F.xxhash64(*key, "kept", "begun")), "repeats")
    clusters = components(found.select(F.col("id").alias("a"), F.explode("nodes").alias("b")).distinct())
    whole = found.groupBy("id", *key, "kept").agg(
        F.min("line").alias("line"), F.min("start").cast("long").alias("start"), (F.max("end") - F.min("start")).cast("long").alias("length")
    )
    whole = whole.join(clusters.withColumnRenamed("component", "cluster"), "id")
    sizes = whole.groupBy("cluster").agg(F.count("*").alias("copies"))
    return whole.join(sizes, "cluster").select(*key, "line", "start", "length", "cluster", "copies", "kept")


def _repeats(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``repeated_paragraphs``, and whether each is a ``whole`` line."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")
    lines = settle(_lines(texts, width, percent, min_words), "lines")
    cuts = lines.where("not kept").groupBy("doc_id", "version").agg(F.collect_set("line").alias("lines"))
    passages = _passages(texts, cuts)
    return lines.withColumn("whole", F.lit(True)).unionByName(passages.withColumn("whole", F.lit(False)))


def repeated_paragraphs(docs: DataFrame, **options) -> DataFrame:
    """One row per line that has a like and per passage that repeats: (doc_id, version, line, start, length, cluster, copies, kept).

    ``start`` and ``length`` count code points; ``version`` is the xxhash64 of the text; ``line`` is the one in which
    it starts; ``copies`` is the number of rows in the cluster and ``kept`` marks the first place: one line of a
    cluster, and each passage that others repeat."""
    return _repeats(docs, **options).drop("whole")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all but the first of like lines and equal passages cut from the texts; ``n_chars`` follows where it exists."""
    span = F.when(~F.col("whole"), F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length")))
    cuts = (
        _repeats(docs, **options).where("not kept").groupBy("doc_id", "version")
        .agg(F.collect_set(F.when(F.col("whole"), F.col("line"))).alias("_cut_lines"), F.sort_array(F.collect_set(span)).alias("_cut_spans"))
        .withColumnsRenamed({"doc_id": "_cut_id", "version": "_cut_version"})
    )
    joined = docs.join(cuts, (docs["doc_id"] == F.col("_cut_id")) & (F.xxhash64(docs["text"]) == F.col("_cut_version")), "left")

    def piece(start, n):
        return F.substring(docs["text"], start + 1, n)

    def shorter(so_far, cut):
        gone = F.regexp_replace(piece(cut["start"], cut["length"]), r"[^\n]+", "")  # line numbers stay
        return F.struct((cut["start"] + cut["length"]).alias("at"), F.concat(so_far["text"], piece(so_far["at"], cut["start"] - so_far["at"]), gone).alias("text"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    short = F.aggregate("_cut_spans", begin, shorter, lambda x: F.concat(x["text"], piece(x["at"], F.length(docs["text"]))))
    lines, before = F.split(short, "\n", -1), F.split(docs["text"], "\n", -1)
    blank = lambda x: F.trim(x) == ""
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_cut_lines"), i) & (~blank(x) | blank(before[i]))), "\n")
    text = F.when(F.col("_cut_lines").isNull(), docs["text"]).otherwise(left)
    columns = [
        text.alias(c) if c == "text" else F.when(F.col("_cut_lines").isNull(), docs[c]).otherwise(F.length(left)).cast(t).alias(c) if c == "n_chars" else docs[c]
        for c, t in docs.dtypes
    ]
    return joined.select(*columns)
