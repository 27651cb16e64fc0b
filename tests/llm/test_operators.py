"""Each operator on small tables: against brute force, and on nulls, empty texts, ties, repeats and empty tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemark.llm import ann, bpe, chat, html, jaccard_join, lm, packing, paragraphs, quality, spotsigs
from telemark.llm.components import components

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "a text without an id"), (4, "one"), (5, "one"), (5, "one"), (6, "word " * 30_000), (7, "é日😀 <|endoftext|> 's")]


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width=5):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def smallest(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def alike(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40, 70)] + [(5, x) for x in range(100, 160)] + [(9, 9), (None, 3), (3, 2), (2, 3), (160, 70)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    clean = [x for x in links if None not in x]
    want = smallest({i for x in clean for i in x}, clean)
    assert got == {i: c for i, c in want.items() if i != 9}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_few_jobs(spark):
    """A job is a thread and a plan update on the driver: a star that is one already takes no second round."""
    links = spark.createDataFrame([(7, x) for x in range(100, 500)], "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("stars", "components of stars")
    try:
        found = components(links)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(context.statusTracker().getJobIdsForGroup("stars")) <= 8
    assert {(r.id, r.component) for r in found.collect()} == {(7, 7), *((x, 7) for x in range(100, 500))}


def near(rng, text, share):
    w = text.split(" ")
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def made(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def test_join_is_exact(spark, documents):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10_000 + i if i is not None else None, t) for i, t in ODD]
    passage = made(rng, 60)
    for g in range(12):
        base = made(rng, rng.choice([4, 6, 12, 60, 300]))
        rows += [(20_000 + 100 * g + k, near(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))) for k in range(rng.choice([2, 5, 25]))]
    rows += [(30_000 + k, made(rng, 150) + " " + passage) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(table(spark, rows)).collect()}
    sets = {}
    for i, t in rows:
        if i is not None:
            sets[i] = shingle_set(t)
    want = smallest(sets, [(a, b) for a, b in combinations(sorted(sets), 2) if alike(sets[a], sets[b])])
    assert {i: v for i, v in got.items() if i is not None} == {i: (len(s), want[i]) for i, s in sets.items()}
    assert got[None][1] is None and len(set(want.values())) < len(want)


def test_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(table(spark, [])).count() == 0
    one = jaccard_join.jaccard_components(table(spark, [(3, "a b c")])).collect()
    assert [tuple(r) for r in one] == [(3, 1, 3)]


def test_paragraphs_that_repeat(spark):
    rng = random.Random(4)
    passage, other = made(rng, 55), made(rng, 80)
    rows = [(k, "\n".join([made(rng, 40), passage if k % 2 else near(rng, passage, 0.02), made(rng, 30)])) for k in range(1, 9)]
    rows += [(20, f"{other}\nshort line\n{other}"), (21, "short line\n" + made(rng, 50)), (22, None), (23, ""), (None, passage), (24, passage), (25, made(rng, 16) + "\n" + "x y " * 20_000)]
    docs = table(spark, rows).withColumn("line", F.lit("clash")).withColumn("class", F.lit(1))
    found = paragraphs.repeated_paragraphs(docs).collect()
    assert {r.doc_id for r in found} == {*range(1, 9), 20, 24}
    text = dict(rows)
    for r in found:
        assert text[r.doc_id].split("\n")[r.line] == text[r.doc_id][r.start : r.start + r.length]
    kept = {r.doc_id for r in found if r.kept}
    assert kept == {1, 20} and len({r.cluster for r in found}) == 2
    left = {r.doc_id: r for r in paragraphs.without_repeats(docs).collect()}
    assert paragraphs.without_repeats(docs).columns == docs.columns and len(left) == len(rows)
    assert left[1].text == text[1] and left[21].text == text[21] and left[25].text == text[25] and left[None].text == passage and left[22].text is None
    assert left[24].text == "" and left[24].n_chars == 0
    assert left[20].text == f"{other}\nshort line" and passage not in left[3].text and left[3].n_chars == len(left[3].text)
    assert paragraphs.repeated_paragraphs(table(spark, [])).count() == 0


def test_large_bucket_is_compared_beyond_its_leaders(spark):
    rng = random.Random(11)
    form, rows, links = made(rng, 64), [], []
    for k in range(0, 1600, 2):
        # 60 shingles of the form and 10 of its own: 0.75 to the others, 0.84 to its pair
        own = [f"p{k}x{i}" for i in range(4)]
        for d in (k, k + 1):
            rows.append((d, " ".join([form, *own, *(f"d{d}x{i}" for i in range(6))])))
        links.append((k, k + 1))
    sets = {i: shingle_set(t) for i, t in rows}
    assert all(alike(sets[a], sets[b]) for a, b in links) and not alike(sets[0], sets[2])
    clusters, passages = {}, {}
    for r in paragraphs._repeats(table(spark, rows)).collect():
        (clusters if r.whole else passages).setdefault(r.cluster, set()).add(r.doc_id)
    found = {tuple(sorted(c)) for c in clusters.values()}
    assert found <= set(links) and len(found) >= 0.995 * len(links)
    # the form itself is a passage of 64 words in what the line stage leaves: one cluster of the lines kept
    assert len(passages) == 1 and {a for a, _ in links} <= set().union(*passages.values())


def passages(rows, cut):
    """Windows of 51 words in every stretch between cut lines; equal ones in two places or more, the first place apart."""
    places = {}
    for i, text in rows:
        at, streams = 0, [[]]
        for k, line in enumerate(text.split("\n")):
            if (i, k) in cut:
                streams.append([])
            else:
                streams[-1] += [(w, m.start() + at, m.end() + at) for m in re.finditer("[^ \t-\r]+", line) for w in (m[0].encode().lower(),)]
            at += len(line) + 1
        base, seen = 0, {}
        for s in streams:
            for k in range(len(s) - 50):
                w = tuple(x[0] for x in s[k : k + 51])
                last, run = seen.get(w, (-51, base + k))
                run = run if base + k - last < 51 else base + k
                seen[w] = (base + k, run)
                places.setdefault(w, []).append((i, run, base + k, s[k][1], s[k + 50][2]))
            base += len(s) + 52
    spans = {}
    for found in places.values():
        first = min(p[:2] for p in found)
        if any(p[:2] != first for p in found):
            for i, run, at, start, end in found:
                spans.setdefault((i, (i, run) == first), []).append((at, start, end))
    out = set()
    for (i, kept), found in spans.items():
        found.sort()
        open_one = None
        for at, start, end in found:
            if open_one is None or at - open_one[0] > 51:
                if open_one:
                    out.add((i, kept, open_one[1], open_one[2] - open_one[1]))
                open_one = [at, start, end]
            else:
                open_one = [at, min(open_one[1], start), max(open_one[2], end)]
        out.add((i, kept, open_one[1], open_one[2] - open_one[1]))
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_lines_and_passages_against_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(paragraphs, "HOT", hot)
    monkeypatch.setattr(paragraphs, "BUCKET", 500)
    rng = random.Random(8)
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    shared = [made(rng, 70) for _ in range(3)]
    for k in range(40):
        parts = rng.choice(shared).split(" ")
        begin = rng.randrange(0, 15)
        rows.append((5000 + k, f"{made(rng, rng.randrange(0, 30))} é {' '.join(parts[begin:])} {made(rng, rng.randrange(0, 30))}".replace(" ", "\n" if k % 7 == 0 else " ")))
    rows += [(6000, "one two " * 200), (6001, "x " + "one two " * 100), (6002, shared[0] + " gap " * 60 + shared[0])]
    got = paragraphs._repeats(table(spark, rows)).collect()
    # lines: every pair of like ones
    sets = {(i, k): shingle_set(line) for i, t in rows for k, line in enumerate(t.split("\n")) if len(words(line)) >= 15}
    by, links = {}, []
    for place, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(place)
    for pair in {p for found in by.values() for p in combinations(sorted(found), 2)}:
        if alike(sets[pair[0]], sets[pair[1]]):
            links.append(pair)
    root = smallest(sets, links)
    clusters = {}
    for place, r in root.items():
        clusters.setdefault(r, set()).add(place)
    want = {frozenset(c) for c in clusters.values() if len(c) > 1}
    mine = {}
    for r in got:
        if r.whole:
            mine.setdefault(r.cluster, set()).add((r.doc_id, r.line))
    assert {frozenset(c) for c in mine.values()} == want and len(want) > 5
    cut = {p for c in want for p in c if p != min(c)}
    assert {(r.doc_id, r.kept, r.start, r.length) for r in got if not r.whole} == passages(rows, cut)


def test_passages_whatever_the_line_breaks(spark):
    rng = random.Random(12)
    passage, verse, short, common = made(rng, 52), made(rng, 80).split(), made(rng, 50), made(rng, 60)
    wrapped = lambda n: "\n".join(" ".join(verse[k : k + n]) for k in range(0, len(verse), n))
    rows = [
        (1, f"{made(rng, 90)} {passage} {made(rng, 90)}"), (2, f"{made(rng, 5)} {passage} é {made(rng, 140)}\nlast line"),
        (3, "first\n" + wrapped(12)), (4, wrapped(9) + "\nlast"), (5, f"{made(rng, 60)} {short}"), (6, f"{short} {made(rng, 60)}"),
        (7, f"{made(rng, 200)} {common} {made(rng, 200)} {common} end"), (8, "x y " * 300),
    ]
    rows += [(k, f"{made(rng, 200)} {common} {made(rng, 150)}") for k in range(10, 40)]
    docs, text = table(spark, rows), dict(rows)
    found = paragraphs.repeated_paragraphs(docs).collect()
    got = {(r.doc_id, " ".join(text[r.doc_id][r.start : r.start + r.length].split()), r.kept) for r in found}
    verse = " ".join(verse)
    assert got == {(1, passage, True), (2, passage, False), (3, verse, True), (4, verse, False), (7, common, True), (7, common, False), *((k, common, False) for k in range(10, 40))}
    assert {c: n for c, n in Counter(r.cluster for r in found).items()} == {r.cluster: r.copies for r in found} and len({r.cluster for r in found}) == 3
    left = {r.doc_id: r for r in paragraphs.without_repeats(docs).collect()}
    assert all(left[k].text == text[k] for k in (1, 3, 5, 6, 8)) and left[4].text == "last"
    assert left[2].text == text[2].replace(passage, "") and left[2].n_chars == len(left[2].text)
    assert left[7].text.count(common) == 1 and not any(common in left[k].text for k in range(10, 40))


def test_a_gram_is_written_once_a_document(spark, monkeypatch):
    rng = random.Random(13)
    common, size = made(rng, 60), paragraphs.PASSAGE - paragraphs.GRAM + 1
    rows = [(k, f"{made(rng, 5)} " + "x y " * 300 + made(rng, 5)) for k in range(20)]
    rows += [(20, "x y " * 40), (21, f"{common} {made(rng, 90)} {common}"), (22, f"{made(rng, 30)} {common}"), (23, made(rng, 80)), (24, "x y"), (25, "")]
    places = {}
    for i, text in rows:
        grams = paragraphs._windows(paragraphs._hashed(words(text)), paragraphs.GRAM).view(np.int64)
        unsigned = grams.view(np.uint64)
        least = [unsigned[k : k + size].min() for k in range(len(grams) - size + 1)]
        for k, g in enumerate(unsigned):
            if g in least[max(0, k - size + 1) : k + 1]:
                places[i, int(grams[k])] = places.get((i, int(grams[k])), 0) + 1
    written, settle = {}, paragraphs.settle
    monkeypatch.setattr(paragraphs, "settle", lambda df, label="settled": written.setdefault(label, settle(df, label)))
    cuts = spark.createDataFrame([], "doc_id long, version long, lines array<int>")
    found = paragraphs._passages(table(spark, rows).select("doc_id", F.xxhash64("text").alias("version"), "text"), cuts).collect()
    assert {(r.doc_id, r.kept, r.start, r.length) for r in found} == passages(rows, set())
    # the join with the shared grams makes a row for each of these at most
    assert sorted((r.doc_id, r.gram) for r in written["grams"].collect()) == sorted(places) and sum(places.values()) > 20 * len(places)
    total = {}
    for (_, gram), n in places.items():
        total[gram] = total.get(gram, 0) + n
    assert {r.gram: r.n for r in written["shared"].collect()} == {g: n for g, n in total.items() if n > 1}


def test_overlaps_across_slabs():
    rng = np.random.default_rng(3)
    x, y = ([np.unique(rng.integers(0, 20_000, n).astype(np.uint64)) for n in sizes] for sizes in ((5, 9_000, 300), (12_000, 40)))
    assert paragraphs._overlaps(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_bands_reach_the_recall():
    n, rows = paragraphs.tuned(80, 0.999, 48)
    assert n * rows <= 48 and 1 - (1 - 0.8**rows) ** n >= 0.999


def test_patterns_hold_the_histogram():
    rng = random.Random(1)
    for _ in range(60):
        want = {rng.randrange(1, 64): rng.randrange(1, 40) for _ in range(rng.randrange(1, 50))}
        back = Counter()
        for copies, lengths in packing.patterns(want, 64):
            assert sum(lengths) <= 64 and copies > 0
            for x in lengths:
                back[x] += copies
        assert back == want
    assert packing.patterns({}, 64) == []


def test_packing_is_whole(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10_000 + (i or 0), t) for i, t in ODD if i != 5]
    rows += [(20_000, "<|endoftext|>"), (20_001, " a <|endoftext|>\n\n <|endoftext|><|endoftext|>b  "), (20_002, "<|endoftext| >")]
    got = packing.packed(table(spark, rows).withColumns({c: F.lit("clash") for c in ("length", "start", "_slice")}), 1024).toPandas()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == i].sort_values("start")
        assert set(mine.doc_tokens) == {len(ids)} and mine.length.sum() == len(ids)
        for s, n, c in zip(mine.start, mine.length, mine.ids_crc32, strict=True):
            assert zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert list(x.offset) == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() <= 1024
    n = got.sequence_id.nunique()
    assert sorted(got.sequence_id.unique()) == list(range(n)) and got.length.sum() > 0.97 * 1024 * n
    assert packing.packed(table(spark, [])).count() == 0


def test_packing_of_null_and_equal_ids(spark):
    rows = [(None, "one two"), (None, "one two"), (7, "three"), (7, "three"), (7, "four five six"), (None, None)]
    got = [tuple(r) for r in packing.packed(table(spark, rows), 1024).select("doc_id", "start", "length", "ids_crc32").collect()]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, 0, len(ids), zlib.crc32(ids.tobytes())))
    assert Counter(got) == Counter(want)


def test_encoding_is_the_librarys(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [((i or 0) + 10_000, t) for i, t in ODD if i != 5] + [(99_999, "x" * 5000)]
    got = {r.doc_id: r for r in bpe.encoded(table(spark, rows), digests=True).collect()}
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    one = bpe.encoded(table(spark, [(1, "the word")])).first()
    assert bytes(one.decoded) == b"the word" and one.ids == lib.encode_ordinary("the word")
    assert bpe.encoded(table(spark, [])).count() == 0


def test_the_hash_is_perfect():
    keys = [f"k{i}".encode() for i in range(3000)]
    found = bpe.PerfectHash(keys)
    assert sorted(found[k] for k in keys) == list(range(3000))


def test_loss_difference(spark):
    rng = random.Random(3)
    rows = [(i, made(rng, rng.randrange(0, 60), 30)) for i in range(120)] + [(i + 200, t) for i, t in ODD if i]
    # counts of over 254 in one document, of words rare enough to be sent
    rows += [(300, "rare tail " * 700), (301, "rare tail again"), (303, " ".join(f"u{k}" for k in range(60_000)))]
    target = {i for i in range(0, 120, 3)} | {204, 300}
    got = {}
    for r in lm.cross_entropy_difference(table(spark, rows), spark.createDataFrame([(i,) for i in [*target, None, 204]], "doc_id long")).collect():
        got.setdefault(r.doc_id, r)
    contexts, pairs, t_contexts, t_pairs = Counter(), Counter(), Counter(), Counter()
    chains = [(i, ["<s>", *words(t)]) for i, t in rows]
    for i, w in chains:
        for c, p, on in ((contexts, pairs, True), (t_contexts, t_pairs, i in target)):
            if on:
                c.update(w[:-1])
                p.update(zip(w, w[1:], strict=False))
    n, scale = sum(contexts.values()), sum(t_contexts.values()) / sum(contexts.values())
    for i, w in chains:
        own_c, own_p, on = Counter(w[:-1]), Counter(zip(w, w[1:], strict=False)), i in target
        loss = 0.0
        for x in zip(w, w[1:], strict=False):
            c, p = scale * (contexts[x[0]] - own_c[x[0]]), scale * (pairs[x] - own_p[x])
            tc, tp = t_contexts[x[0]] - on * own_c[x[0]], t_pairs[x] - on * own_p[x]
            low = (contexts[x[1]] + 1) / (n + len(contexts))
            loss += lm.MIX * (math.log((p + low) / (c + 1)) - math.log((tp + low) / (tc + 1)))
            loss += (1 - lm.MIX) * (math.log(c + 1) - math.log(tc + 1))
        assert got[i].n_words == len(w) - 1 and got[i].score == pytest.approx(loss / max(1, len(w) - 1), abs=1e-9)
    empty = spark.createDataFrame([], "doc_id long")
    assert lm.cross_entropy_difference(table(spark, []), empty).count() == 0
    assert lm.cross_entropy_difference(table(spark, [(None, "a b")]), empty).first().doc_id is None


def test_a_target_document_is_scored_as_if_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = sorted(i for i, q in labels.items() if q == 1)
    inside = set(good[::2])
    target = spark.createDataFrame([(i,) for i in inside], "doc_id long")
    score = {r.doc_id: r.score for r in lm.cross_entropy_difference(docs, target).collect()}
    held_in, held_out = ([score[i] for i in good if (i in inside) == on] for on in (True, False))
    bad = [score[i] for i, q in labels.items() if q == 0]
    assert abs(np.median(held_in) - np.median(held_out)) < 0.1 * np.std(held_in + held_out) + 0.05
    auc = lambda low, high: np.mean([(a < b) + (a == b) / 2 for a in low for b in high])
    print("AUC held in", auc(held_in, bad), "held out", auc(held_out, bad), "medians", np.median(held_in), np.median(held_out), np.median(bad))
    assert abs(auc(held_in, bad) - auc(held_out, bad)) < 0.05 and auc(held_out, bad) > 0.75


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 5, 4])
    u, pairs = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    got, expected = quality._marginals(u, lengths, pairs, True)
    want, counts, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, good, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for k in range(2**n):
            y = [(k >> j) & 1 for j in range(n)]
            w = math.exp(sum(u[at + j] * y[j] for j in range(n)) + sum(pairs[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                two[a, b] += w
        want += list(good / total)
        counts += two / total
        at += n
    assert np.allclose(got, want) and np.allclose(expected, counts)


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.crf_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) for i, held in zip(got.doc_id, got.held_out, strict=True))


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, ODD).withColumn("quality", F.lit(3)).withColumn("score", F.lit("x"))
    rows = quality.crf_quality(docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.crf_quality(table(spark, []), labels).count() == 0
    assert quality.good_only(docs, labels).columns == docs.columns


def test_pages(spark):
    body = "Words of the text that is long enough to be taken as the main part of it all."
    pages = [
        (1, "u", f"<html><body><nav><a>Home</a></nav><article><h1>Title</h1><p>{body}<br>and&nbsp;more &amp; more</p><div class='ad'>Buy</div><p>{body}</article><footer>f</footer>"),
        (2, "u", f"<body><div id=cookie-notice><p>{body}</p></div><div class=post><h2>Head</h2><p>{body}</p><ul><li>item one of the list</li></ul></div><div class='comments'><p>{body}</p></div><form><p>{body}</p></form>"),
        (3, "u", None), (4, None, ""), (5, "u", "<nav><a>a</a> <a>b</a></nav>"), (None, "u", f"<p>{body}</p>"), (6, "u", f"<p>{body}</p><script>var x='<p>no</p>'</script><!-- <p>no</p> --><p>{body} <b>bold</b>ly &#233;</p><p cut"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extracted(df).collect()}
    assert got[1].text == f"Title\n\n{body} and more & more\n\n{body}" and got[1].n_chars == len(got[1].text)
    assert got[2].text == f"Head\n\n{body}\n\nitem one of the list"
    assert [got[i].text for i in (3, 4, 5)] == ["", "", ""] and got[None].text == body
    assert got[6].text == f"{body}\n\n{body} boldly é"
    assert html.extracted(df.limit(0)).count() == 0


def test_text_is_bounded_by_the_run_and_not_by_an_article():
    body = "Words of the text that is long enough to be taken as the main part of it all."
    text = ["Lead", *[f"{body} {body}"] * 20, body]
    inner = f"<h1>Lead</h1>{''.join(f'<p>{t}</p>' for t in text[1:-1])}"
    page = f"<body><nav><a>Home</a></nav><div>{inner}</div><article><p>{body}</p></article><footer>foot</footer>"
    weights = html.scores({})
    assert html.main_text(page, weights) == "\n\n".join(text)
    assert html.main_text(page.replace("article", "div"), weights) == "\n\n".join(text)


def test_headings_and_sections_stay_whatever_they_are_called():
    body = "Words of the text that is long enough to be taken as the main part of it all."
    snippets = [
        "<h2 id='search'>How they search</h2>", "<h2 id='comments-on-the-law'>Comments on the law</h2>", f"<p class='form'>{body}</p>",
        f"<section id='related-work'><p>{body}</p></section>", f"<div class='notice-period'><p>{body}</p></div>", f"<p>{body} <math><mi>x</mi></math></p>",
    ]
    gone = [
        "<div class='ad'>Buy it now.</div>", "<div class='cookie-banner'><p>Buy it now.</p></div>", "<div id='site-menu'>Buy it now.</div>", "<ul class='comment-list'><li><p>Buy it now.</p></li></ul>",
        "<section class='comments'><p>Buy it now.</p></section>", "<div class='NewsletterBox'>Buy it now.</div>", "<div role='complementary'>Buy it now.</div>", "<aside>Buy it now.</aside>",
    ]
    page = f"<body><nav><a>Home</a></nav><article><h1>Title</h1><p>{body}</p>{''.join(a + b for a, b in zip(snippets, gone, strict=False))}{''.join(gone[6:])}<p>{body}</p></article><footer>foot</footer>"
    # without marked pages, and with weights of many pages like it
    for weights in (html.scores({}), html.scores({k: (300 * a, 300 * b) for k, a, b in html._tallied([page])})):
        want = ["Title", body, "How they search", "Comments on the law", body, body, body, f"{body} x", body]
        assert html.main_text(page, weights).split("\n\n") == want


def test_region_is_the_best_run():
    rng = random.Random(5)
    for _ in range(100):
        x = [rng.randrange(-5, 6) for _ in range(rng.randrange(0, 25))]
        a, b = html.region(x)
        best = max([sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)] + [0])
        assert sum(x[a:b]) == max(0, best)


def test_preference_pairs(spark):
    t = lambda *x: [{"turn": i, "role": r, "text": w} for i, (r, w) in enumerate(x)]
    ask, yes, no = ("user", "q"), ("assistant", "yes"), ("assistant", "no")
    pairs = spark.createDataFrame(
        [(1, t(ask, yes), t(ask, no)), (2, t(ask), t(ask)), (3, t(ask), t(ask, yes, ask)), (4, t(yes), t(no)), (5, [], t(no))],
        "pair_id long, chosen array<struct<turn:long,role:string,text:string>>, rejected array<struct<turn:long,role:string,text:string>>",
    )
    got = {r.pair_id: r for r in chat.preference_pairs(pairs).collect()}
    assert [got[i].n_prompt_turns for i in range(1, 6)] == [1, 1, 1, 0, 0]
    assert got[1].prompt == "<|user|>\nq\n" and got[1].chosen_completion == "<|assistant|>\nyes\n" and got[1].rejected_mask == [0, 1]
    assert got[2].chosen_completion == got[2].rejected_completion == "" and got[3].rejected_mask == [0, 1, 0] and got[5].prompt == ""


def test_neighbours(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, None, None), (3, 0, "user", "c"), (3, 1, "assistant", "d"), (3, 2, "user", "e"), (None, 0, "user", "x"), (4, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit(0))
    got = {r.pair_id: r for r in chat.preference_pairs(chat.neighbour_pairs(df)).collect()}
    assert set(got) == {1, 3} and got[1].rejected_completion == "<|assistant|>\nd\n" and got[3].chosen_completion == "<|assistant|>\nd\n<|user|>\ne\n"
    assert got[3].chosen_mask == [0, 1, 0]
    assert chat.preference_pairs(chat.neighbour_pairs(df.limit(0))).count() == 0


def test_spots(spark):
    rows = [(9, "The red fox and the grey wolf ran. " * 3 + "A fox, of the wood?"), (7, "The red fox and the grey wolf ran. " * 3 + "A fox, of the wood?"), (5, "zz " * 9000), (4, None), (3, ""), (1, "of the of the"), (None, "the lone row")]
    got = {r.doc_id: r for r in spotsigs.edited_likeness(table(spark, rows)).collect()}
    assert got[9].fingerprint == got[7].fingerprint != "" and got[9].near_next == 1.0
    ids, text = sorted((i for i, _ in rows if i), reverse=True), {i: t or "" for i, t in rows}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, k = text[a], len(text[a]) // 3
        assert got[a].edited_sha256 == hashlib.sha256((t[: len(t) - k] + text[b][:k]).encode()).hexdigest() and got[a].n_chars == len(t)
    assert got[4].fingerprint == "" and got[4].near_next == 1.0 and got[5].near_next == 0.0 and got[1].fingerprint == ""
    assert spotsigs.edited_likeness(table(spark, [])).count() == 0


def test_spot_signatures_against_a_plain_reading(spark, documents):
    def plain(text):
        import re

        found = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        marked = [(w, w in spotsigs.COMMON, w not in spotsigs.COMMON and zlib.crc32(w.encode()) % spotsigs.ONE_IN == 0) for w in found]
        if not any(c or h for _, c, h in marked):
            marked = [(w, False, True) for w in found]
        out = set()
        for i, (w, common, anchor) in enumerate(marked):
            if common or anchor:
                tail = ([w] if anchor else []) + [x for x, c, _ in marked[i + 1 :] if not c]
                if tail:
                    out.add((w, *tail[: spotsigs.CHAIN]))
        return out

    rows = documents.where("lang = 'en'").select("doc_id", "text", spotsigs.fingerprint(F.col("text")).alias("p")).limit(60).collect()
    for r in rows:
        assert len(r.p.split()) == len(plain(r.text)), r.doc_id


def test_near_pairs_of_fingerprints(spark, documents):
    rows = documents.select("doc_id", spotsigs.fingerprint(F.col("text")).alias("p")).collect()
    first = {}
    for r in sorted(rows):
        if r.p:
            first.setdefault(frozenset(r.p.split()), r.doc_id)
    want = {tuple(sorted((i, j))) for (a, i), (b, j) in combinations(first.items(), 2) if len(a & b) >= 0.8 * len(a | b)}
    assert {(r.a, r.b) for r in spotsigs.near_pairs(documents).collect()} == want


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0] * 7), (None, [1.0] * 24), (904, [None] * 24), (905, [float("inf")] * 24)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).toPandas()
    d = np.sqrt(((x[:, None].astype(float) - x.astype(float)) ** 2).sum(axis=2))
    hits = 0
    for q in range(0, 600, 20):
        near = [j for j in np.lexsort((np.arange(600), d[q])) if j != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.allclose(mine.score, d[q][mine.vec_id], atol=1e-12)
        hits += len(set(near) & set(mine.vec_id))
    assert hits >= 0.9 * 300 and set(got.query_id) == set(range(0, 600, 20))
    assert list(got[got.query_id == 100].sort_values("rank").vec_id) == list(range(101, 111))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.nearest(few, few).count() == 6 and ann.nearest(few.limit(0), few.limit(0)).count() == 0


def test_recall_beside_a_crowd_of_copies(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(1000, 32))
    x = (np.repeat(centres, 4, axis=0) + 0.05 * rng.normal(size=(4000, 32))).astype(np.float32)
    copy = rng.normal(size=32).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, copy.tolist()) for i in range(16_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("query", F.lit(1))
    got = ann.nearest(df, df.where("vec_id % 100 = 0 and vec_id < 4000")).toPandas()
    every, ids = np.vstack([x, np.repeat(copy[None], 11, axis=0)]).astype(float), np.r_[np.arange(4000), 10_000 + np.arange(11)]
    hits = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((every - every[q]) ** 2).sum(axis=1))
        near = [int(ids[j]) for j in np.lexsort((ids, d)) if j != q][:10]
        mine = got[got.query_id == q]
        assert sorted(mine["rank"]) == list(range(1, 11))
        hits += len(set(near) & set(mine.vec_id))
    assert hits >= 0.9 * 400


def test_a_query_with_few_candidates_near_goes_on(spark):
    # lone vectors in cells of their own, which hold fewer than k
    rng = np.random.default_rng(13)
    crowd = rng.normal(size=(3000, 8)) * 0.01
    lone = np.eye(8)[:, None] * np.array([50.0, 51.0])[None, :, None]
    rows = [(i + 1, v.tolist()) for i, v in enumerate(crowd)] + [(5000 + 100 * i, v.tolist()) for i, v in enumerate(lone.reshape(-1, 8))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id >= 5000")).groupBy("query_id").count().collect()
    assert len(got) == 16 and all(r["count"] == 10 for r in got)


def test_error_bounds_hold_the_distances():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(2000, 48)), rng.normal(size=(20, 48))
    index = ann.fit(x)
    signs, length, factor = index.codes(x, np.zeros(len(x), int))
    lower, upper = ann._estimates(signs, length, factor, q, index.centroids[0], index.rotation)
    exact = ((q[:, None] - x) ** 2).sum(axis=2)
    assert ((lower <= exact) & (exact <= upper)).mean() > 0.97
