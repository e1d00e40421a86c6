"""Vector codes, clusters and decontamination against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import codes, vantage, winnowing

VECTORS = "vec_id long, embedding array<float>, label int, code string, cluster int, other string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", -1, "x") for i, v, label in rows], VECTORS)


def sample(n, dim, seed, scale=1.0):
    """Vectors with many ties and copies: few distinct values, a third of the rows equal."""
    rng = random.Random(seed)
    hot = [rng.choice([-1.0, 0.0, 0.5]) * scale for _ in range(dim)]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) * scale for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]
    return rows + [(7, rows[1][1], 1), (7, rows[1][1], 1), (None, rows[2][1], None)]


BAD = [(900, None, 1), (901, [], 1), (902, [0.0] * 63 + [None], 1), (903, [math.nan] * 64, 2), (904, [math.inf] + [0.0] * 63, 2), (905, [1.0] * 5, 2), (906, [3e38] * 64, 1)]


def whole(rows, dim, limit):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) and abs(x) < limit for x in r[1])]


def plain_round(vectors, centres):
    near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres)) for v in vectors]
    groups = defaultdict(list)
    for v, (_, k) in zip(vectors, near, strict=True):
        groups[k].append(v)
    moved = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if groups[k] else c for k, c in enumerate(centres)]
    return near, moved


@pytest.mark.parametrize(("n", "scale"), [(150, 1.0), (9, 1.0), (60, 9000.0)])
def test_codes_against_a_plain_quantiser(spark, n, scale):
    rows = sample(n, 64, n, scale) + BAD
    got, book = codes.compress(frame(spark, rows).repartition(5))
    kept = whole(rows, 64, codes.LIMIT)
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    out, error = [""] * len(kept), [0] * len(kept)
    for p in range(8):
        part = [v[8 * p : 8 * p + 8] for v in ints]
        centres = part[:16]
        for _ in range(6):
            centres = plain_round(part, centres)[1]
        near, _ = plain_round(part, centres)
        assert book[p].tolist() == centres
        out = [o + f"{k:02x}" for o, (_, k) in zip(out, near, strict=True)]
        error = [e + d for e, (d, _) in zip(error, near, strict=True)]
    sums = defaultdict(int)
    for (_, _, label), e in zip(kept, error, strict=True):
        sums[label] += e
    want = [(i, label, o, e, sums[label]) for (i, _, label), o, e in zip(kept, out, error, strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(4)
    most = 2**27 - 1
    x, c = rng.integers(-most, most, (40, 64)), rng.integers(-most, most, (9, 64))
    x[0], c[0], c[1] = most, -most, most
    assert (codes.exact_dot(x, c) == np.array([[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in c] for r in x])).all()
    best, d = codes.nearest(np.zeros((2, 8), np.int64), np.ones((4, 8), np.int64))
    assert best.tolist() == [0, 0] and d.tolist() == [8, 8]


@pytest.mark.parametrize(("n", "scale"), [(150, 1.0), (9, 1.0), (60, 1e6)])
def test_clusters_against_a_plain_version(spark, n, scale):
    import hashlib

    rows = sample(n, 64, n + 1, scale) + BAD
    got, place = vantage.cluster(frame(spark, rows).repartition(5))
    kept = whole(rows, 64, vantage.LIMIT)
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    ints = [[math.floor(64 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    centres = ints[:16]
    for _ in range(3):
        centres = plain_round(ints, centres)[1]
    near, _ = plain_round(ints, centres)
    assert place.tolist() == centres
    by, total = defaultdict(int), sum(d for d, _ in near)
    for d, k in near:
        by[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    want = [(i, k, d, by[k], digest[k], total) for (i, _, _), (d, k) in zip(kept, near, strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("k", "dim"), [(1, 4), (2, 4), (3, 1), (50, 2), (200, 3)])
def test_tree_search_finds_the_first_nearest(k, dim, monkeypatch):
    rng = np.random.default_rng(k)
    monkeypatch.setattr(vantage, "CELLS", 700)  # several steps
    centroids, x = rng.integers(-6, 7, (k, dim)), rng.integers(-9, 10, (300, dim))  # with equal centroids and equal distances
    number, d = vantage.Tree(centroids).search(x)
    far = ((x[:, None] - centroids) ** 2).sum(2)
    assert (number == far.argmin(1)).all() and (d == far.min(1)).all()


def test_tree_search_leaves_most_centroids_unopened(monkeypatch):
    rng = np.random.default_rng(1)
    centroids = rng.integers(0, 10**6, (500, 2))
    seen, squares = [0], vantage.squares
    tree = vantage.Tree(centroids)
    monkeypatch.setattr(vantage, "squares", lambda x, c: (seen.__setitem__(0, seen[0] + len(x)), squares(x, c))[1])
    tree.search(rng.integers(0, 10**6, (200, 2)))
    assert seen[0] < 200 * 500 / 5


def test_no_vectors(spark):
    for rows in ([], BAD[:4]):
        assert codes.compress(frame(spark, rows))[0].count() == 0
        assert vantage.cluster(frame(spark, rows))[0].count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_contamination(docs, items):
    cut = defaultdict(set)
    for i, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        t = min(10, len(w))
        for p in range(len(w) - t + 1 if w else 0):
            cut[tuple(w[p : p + t])].add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w = WORDS.findall((text or "").translate(LOWER))
        hit, shown = set(), set()
        for t in {len(c) for c in cut}:
            for p in range(len(w) - t + 1):
                if found := cut.get(tuple(w[p : p + t])):
                    hit |= set(range(p, p + t))
                    shown |= found
        out.append((i, len(w), sorted(hit), sorted(shown)))
    return sorted(out, key=str)


def contaminated(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, row string, id string").repartition(3)
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, words string")
    rows = winnowing.contamination(d, b).collect()
    return sorted(((r["doc_id"], r["n_words"], [p for a, b in r["hits"] for p in range(a, b)], r["items"]) for r in rows), key=str)


def test_contamination_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["ab", "Cd", "é", "x1", "漢字", "E"])
    sep = lambda: rng.choice([" ", "\n", "--", "'", "\x00", "_"])
    text = lambda n: "".join(word() + sep() for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 7, 9, 10, 11, 30, 60]))) for i in range(25)] + [(None, text(12)), (3, text(15)), (4, None), (77, "zz")]
    docs = [(i, text(rng.randint(0, 80))) for i in range(40)]
    docs += [(100 + i, text(5) + (t or "")[rng.randint(0, 5) :] + text(9)) for i, (_, t) in enumerate(items)]
    docs += [(100, docs[0][1]), (100, docs[0][1]), (None, items[-2][1]), (None, None), (200, ""), (201, "ab " * 500), (202, "ZZ"), (203, "q " * 20_000 + items[7][1])]
    assert contaminated(spark, docs, items) == plain_contamination(docs, items)


def test_every_window_shares_its_fingerprint(spark):
    """Planted spans of ten words are found whatever surrounds them, and nine words are not."""
    rng = random.Random(3)
    item = [f"w{i}" for i in range(40)]
    docs = []
    for p in range(31):
        docs.append((p, " ".join([f"a{rng.randrange(10**6)}" for _ in range(rng.randint(0, 12))] + item[p : p + 10] + [f"b{rng.randrange(10**6)}" for _ in range(5)])))
        docs.append((100 + p, " ".join(["x", *item[p : p + 9], "y"])))
    got = contaminated(spark, docs, [(1, " ".join(item))])
    assert all((len(hit) == 10) == (i < 100) and (hit == []) == (i >= 100) for i, _, hit, _ in got)


def test_nothing_to_find(spark):
    docs = [(1, "some words"), (2, None)]
    assert contaminated(spark, docs, []) == [(1, 2, [], []), (2, 0, [], [])]
    assert contaminated(spark, [], [(1, "some words")]) == []


def test_the_bitmap_only_lets_more_through(spark, monkeypatch):
    items, docs = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(12))) for i in range(20)], [(i, " ".join(f"w{(i * 3 + j) % 50}" for j in range(30))) for i in range(20)]
    want = contaminated(spark, docs, items)
    monkeypatch.setattr(winnowing, "BITS", 7)
    assert contaminated(spark, docs, items) == want == plain_contamination(docs, items)
