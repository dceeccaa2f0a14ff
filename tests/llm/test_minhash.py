import random

import numpy as np
import pytest

from tessella.llm import minhash
from tessella.llm.components import components

from .helpers import documents, odd_rows, with_clashes


def plain(rows, percent=85):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["new"], [words[k], "extra"], [words[k] + "q"]])
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 7, 12, 80, 200]))
        for edits in [0, 0, 1, 1, 2, 3, 5]:
            rows.append((n, edited(rng, base, edits if len(base) > 10 else 0) + (" " + passage if rng.random() < 0.3 else "")))
            n += 1
    rows += [(n, "a b c d e f"), (n + 1, "A B C D E F"), (n + 2, "a b c d e f g"), (n + 3, "one two"), (n + 4, "one  two"), (n + 5, None), (n + 6, " ")]
    rng.shuffle(rows)
    got = minhash.link(with_clashes(documents(spark, rows), "digest", "v", "n", "bucket", "component")).drop("digest").collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))] + [(i, edited(rng, base, rng.choice([1, 2, 3, 4]))) for i in range(1, 250)]
    got = minhash.link(documents(spark, rows)).drop("digest").collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def templated(rng, pairs):
    """Strangers with one template, just under the threshold; each has one near copy just above it."""
    template = [f"t{i}" for i in range(204)]
    rows = []
    for pair in range(pairs):
        both = [f"b{pair}x{k}" for k in range(rng.randint(4, 6))]
        rows += [" ".join(template + both + [f"o{pair}x{side}x{k}" for k in range(16)]) for side in range(2)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("pairs, block", [(60, 8), (200, 256), (600, 256)])
def test_exact_pass_finds_what_stars_miss(spark, monkeypatch, pairs, block):
    """They share most buckets, and no lucky centre helps the copies among them. The rounds are few at any size."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rounds = []
    monkeypatch.setattr(minhash, "components", lambda e: rounds.append(1) or components(e))
    rows = templated(random.Random(pairs), pairs)
    got = sorted(tuple(r) for r in minhash.link(documents(spark, rows)).drop("digest").collect())
    key = {}
    for i, t in rows:
        key.setdefault(t.split()[204], []).append(i)
    assert all(len(x) == 2 for x in key.values()) and len(key) == pairs
    want = {i: min(x) for x in key.values() for i in x}
    assert [(i, c, k) for i, _, c, k in got] == [(i, c, c == i) for i, c in sorted(want.items())]
    if pairs <= 200:
        assert got == plain(rows)
    assert len(rounds) <= 10


def test_odd_rows(spark):
    got = minhash.link(documents(spark, odd_rows())).drop("digest").collect()
    assert len(got) == len(odd_rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(tuple(r))
    assert by[1] == [(1, 0, 1, True)] and by[3] == [(3, 0, 3, True)] and by[5] == [(5, 1, 5, True)] * 2
    assert by[None][0][2:] == (None, True)
    assert minhash.link(documents(spark, [])).collect() == []


def test_repeated_ids(spark):
    """Two texts of one id are two vertices; of a component, and of equal rows, one row stays."""
    base = [f"w{i}" for i in range(60)]
    other = [f"x{i}" for i in range(60)]
    a, b, c = " ".join(base), " ".join([*base, "more"]), " ".join(other)
    rows = [(1, a), (1, c), (2, b), (3, c + " end"), (4, "own words of this one only"), (4, "own words of this one only"), (4, None), (4, None), (None, a), (5, "alone here with some words")]
    got = sorted((tuple(r)[:4] for r in minhash.link(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 2, 4, True), (4, 2, 4, True), (4, 0, 4, True), (4, 0, 4, True), (None, 56, None, True), (5, 1, 5, True)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in minhash.keep_one(with_clashes(documents(spark, rows), "digest", "kept", "v")).collect()), key=str)
    assert kept == sorted([(1, a), (1, c), (4, "own words of this one only"), (4, None), (4, None), (None, a), (5, "alone here with some words")], key=str)
    plain_rows = rows[:1] + rows[2:5]
    assert sorted(r["doc_id"] for r in minhash.keep_one(documents(spark, plain_rows)).collect()) == [1, 3, 4]
    assert minhash.keep_one(documents(spark, [])).collect() == []


def test_bands_collide_as_similarity_says():
    rng = np.random.default_rng(1)
    s = minhash.Signer()
    hits = 0
    for _ in range(200):
        a = rng.integers(0, 2**63, 100, dtype=np.uint64)
        b = np.concatenate([a[:90], rng.integers(0, 2**63, 6, dtype=np.uint64)])
        x, y = s.bands(np.unique(a)), s.bands(np.unique(b))
        hits += (x == y).mean()
    assert abs(hits / 200 - (90 / 106) ** 5) < 0.05
    for n in (1, 2, 7):
        assert len(s.minima(np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)))) == s.bins


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 9), (9, 8), (20, 20), (7, 5)] + [(100, i) for i in range(101, 140)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 7: 1, 9: 8, 10: 8} | {i: 100 for i in range(101, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
