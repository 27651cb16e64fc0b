"""Best-fit packing, the filter audit and hard negatives against brute force, and on nulls, empties, ties, repeats and odd columns."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemark.llm import best_fit, filter_audit, negatives

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (None, "a text without an id"), (None, "a text without an id"), (4, "one"), (5, "one"), (5, "one"),
    (6, "word " * 30_000), (7, "é日😀 <|endoftext|>a<|startoftext|> 'S ΌΣΟΣ ΌΣ. İx\x1cy\x85z áb\xa0c d"), (8, "x" * 9000), (2**40, "far id"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s[0] if s else "s", None) for i, t, *s in rows], SCHEMA)


# -- best-fit packing


def test_bins_hold_the_histogram_and_are_full():
    rng = random.Random(1)
    for size in (1, 2, 7, 64):
        for _ in range(40):
            want = Counter({rng.randrange(1, size + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 50))})
            made, back = best_fit.bins(want, size), Counter()
            for copies, content in made:
                assert copies > 0 and sum(n * times for n, times in content) <= size
                for n, times in content:
                    back[n] += copies * times
            assert back == want
    assert best_fit.bins({}, 64) == []
    rng = np.random.default_rng(2)
    many = Counter(np.minimum(2048, rng.lognormal(5.5, 1.2, 200_000).astype(int) + 1).tolist())
    need = -(-sum(n * c for n, c in many.items()) // 2048)
    assert sum(copies for copies, _ in best_fit.bins(many, 2048)) <= 1.002 * need


def test_two_replace_the_smallest_piece():
    # greedily 6 + 3 leaves 1 of 10 open; 6 + 2 + 2 is full
    assert best_fit.bins({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])
    # one piece of a length is no pair of it
    assert sum(c for c, _ in best_fit.bins({6: 1, 3: 1, 2: 1}, 10)) == 2


def test_best_fit_is_whole_and_ids_are_the_librarys(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id + 100, r.text) for r in docs.collect()] + ODD
    got = best_fit.best_fit_packed(table(spark, rows).withColumns({"length": F.lit("clash"), "rank": F.lit(1), "_slice": F.lit(2)})).toPandas()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(-1 if i is None else i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype("int64").itertuples(index=False, name=None)) == want
    for _, x in got.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert list(x.offset) == [0, *np.cumsum(x.length)[:-1]] and x.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.01 * -(-got.length.sum() // 2048) + 1
    assert best_fit.best_fit_packed(table(spark, [])).count() == 0


def test_a_hot_length_is_ranked_in_slices(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "SLICE_ROWS", 16)
    got = best_fit.best_fit_packed(table(spark, [(i, "one two three") for i in range(500)]), size=10).toPandas()
    assert len(got) == 500 and got.sequence_id.nunique() == 250
    assert Counter(zip(got.sequence_id, got.offset, strict=True)).most_common(1)[0][1] == 1


# -- filter audit


def audited(rows, labels):
    first, marks = {}, defaultdict(lambda: [0, 0])
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], q == 1), max(marks[i][1], x == 1)]
    parts = defaultdict(list)
    for i, t, *s in rows:
        t = t or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t],
        }
        parts[(s[0] if s else "s") or ""].append(({f for f in fails if fails[f]}, *(marks[i] if i in marks else (0, 0))))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                out[part, "".join(order), step] = [
                    len(left), len(lost), sum(f in d[0] for d in gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in lost), sum(d[2] for d in lost),
                ]
                shapley[f] += len(lost)
                gone += lost
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def test_audit_against_every_order(spark):
    rng = random.Random(4)
    pieces = ["Aa", "b", "c$", "D", "ee", "é|", "\x0b", "G　h"]
    rows = [(rng.choice([None, *range(60)]), " ".join(rng.choices(pieces, k=rng.choice([0, 1, 3, 49, 50, 70]))), rng.choice([None, "", "x", "y"])) for _ in range(300)]
    rows += [(i, "a hot text", "x") for i in range(200, 260)] + [(250, "a hot text", "y"), (200, "a hot text", "y")]
    rows += [(i, " ".join(f"w{k}" for k in range(60)), "x") for i in (70, 71)] + [(i, t, "z") for i, t in ODD]
    labels = [(rng.choice([None, *range(60), *range(200, 230)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(90)]
    docs = table(spark, rows).withColumns({c: F.lit("clash") for c in ("mask", "part", "good", "high", "n")})
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    got = filter_audit.filter_audit(docs, marked)
    assert got.columns == [f.name for f in filter_audit.AUDIT]
    want = audited(rows, labels)
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == want and {p for p, _, _ in want} == {"", "x", "y", "z"}
    assert filter_audit.filter_audit(table(spark, []), marked).count() == 0


def test_intervals_cover_every_order_once():
    for mask in range(32):
        seen = Counter()
        for m, step, begin, end in filter_audit.intervals():
            if m == mask:
                for rank in range(begin, end):
                    order = filter_audit.ORDERS[rank]
                    assert next(s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1) == step
                    seen[rank] += 1
        assert seen == (Counter(range(120)) if mask else Counter())


# -- hard negatives


def mined(rows):
    usable = set()
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        usable.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(v) for v in np.floor(256 * np.array(x, float)))))
    out = Counter()
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    for anchor in usable:
        if anchor[0] % 100:
            continue
        others = [(dot(anchor[2], r[2]), r) for r in usable if r != anchor and len(r[2]) == len(anchor[2])]
        best = sorted((-s, r[0], r) for s, r in others if r[1] == anchor[1])[:5]
        for p, positive, _ in ((-s, i, r) for s, i, r in best):
            hard = sorted((-s, r[0], r) for s, r in others if r[1] != anchor[1] and 30 * p <= 100 * s <= 90 * p)[:10]
            for rank, (s, i, _) in enumerate(hard, 1):
                out[anchor[0], positive, rank, i, p, -s] += 1
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, label) for i, x, label in rows], "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("blocks", [False, True])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(negatives, "FEWEST", 2)
        monkeypatch.setattr(negatives, "BLOCKS", 3)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 20))
    rows = [(i, (centres[i % 4] + rng.normal(size=20) * rng.choice([0.3, 1.5])).tolist(), int(rng.integers(0, 3))) for i in range(0, 900)]
    rows += [(i, rows[0][1], 0) for i in range(2000, 2400)]  # a hot vector, with anchors in it
    rows += [(i, [0.5, 0.25], 1 + i % 2) for i in range(3000, 3040)]  # ties, another length
    rows += [(4000, [0.0] * 20, 1), (4100, None, 1), (4200, [None] * 20, 1), (4300, [float("nan")] * 20, 1), (None, [1.0] * 20, 1), (4400, [1.0] * 20, None)]
    rows += [(4500, [], 1), (4501, [], 1), (4502, [], 2), (100, rows[100][1], rows[100][2]), (4600, [float("inf")] + [0.0] * 19, 1)]
    got = negatives.hard_negatives(vectors(spark, rows).withColumns({c: F.lit("clash") for c in ("high", "block", "score", "x", "rank")}))
    assert Counter(tuple(r) for r in got.collect()) == mined(rows)


def test_negatives_of_empty_and_lone_tables(spark):
    assert negatives.hard_negatives(vectors(spark, [])).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(100, [1.0], 1)])).count() == 0
    assert negatives.hard_negatives(vectors(spark, [(101, [1.0], 1), (102, [1.0], 2)])).count() == 0
    huge = [(100, [1e300], 1), (101, [1e300], 1), (102, [9e299], 2)]
    assert negatives.hard_negatives(vectors(spark, huge)).count() == 0


def test_search_leaves_out_what_bounds_cover():
    rng = np.random.default_rng(8)
    rows = np.floor(256 * rng.normal(size=(500, 24)) * np.linspace(3, 0.05, 24))
    anchors = rows[:7]
    scores = anchors @ rows.T
    for q in (0.5, 0.9, 0.99):
        least = np.quantile(scores, q, axis=1)
        norm = np.sqrt((anchors**2).sum(axis=1))
        index = negatives.Index(rows, float((least / norm).min()))
        a, r = index.search(anchors, least)
        want = {(i, j) for i, j in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
        assert want <= set(zip(a.tolist(), r.tolist(), strict=True))
    assert (index.indexed < len(index.cuts) - 1).any()
