import math
import random
import re

import numpy as np
import pytest

from tessella.llm import search_index

from .helpers import documents, odd_rows, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return [t.translate(UPPER) for t in TERM.findall(text or "")]


def plain(docs, items, top=10):
    """(item_id, rank, doc_id, score) by scoring every document."""
    docs = [(i, t) for i, t in ((i, split(t)) for i, t in docs) if t]
    n, long = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in docs:
            m = 100 - 90 + 90 * len(t) * n // long
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in set(split(text)) if x in t)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(str(item), k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_terms():
    for text in ["Ab-C d_e", "ÀÉ x　y", "\x00\x01a\x7fb", "1２3½", "😀 z", ""]:
        assert [t.decode() for t in search_index.terms_of(text.encode())] == split(text)
    assert search_index.terms_of(None) == []


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()] + [(20 + k, "one and the same text") for k in range(15)] + [(None, "one and the same text"), (20, "one and the same text")]
    docs = with_clashes(documents(spark, rows), "shard", "term", "row", "leaf", "df", "q", "rank", "score")
    items = [(1, "the same word5x5 text"), (1, "a null A"), (None, "À ß"), (3, None), (4, ""), (5, "nothingofthis"), (6, "the same word5x5 text")]
    got = search_index.search(search_index.build(docs), with_clashes(items_of(spark, items), "q", "term", "w", "score"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got) == plain(rows, items)
    none = search_index.build(docs.limit(0))
    assert found(search_index.search(none, items_of(spark, items))) == [] and found(search_index.search(search_index.build(docs), items_of(spark, []))) == []


@pytest.mark.parametrize("shard_docs, fewest, wave", [(4096, 512, 4), (7, 1, 1), (40, 1, 2)])
def test_as_scoring_all(spark, shard_docs, fewest, wave):
    """Topics, a third of the rows copies of one text, ties, one very long text; shards of any size, waves of any width."""
    rng = random.Random(shard_docs)
    topic = lambda k: [f"t{k}x{int(rng.paretovariate(0.7)) % 60}" for _ in range(25)] + [f"c{int(rng.paretovariate(0.9)) % 40}" for _ in range(10)]
    rows = [(i, " ".join(topic(i % 8))) for i in range(400)] + [(1000 + i, "t1x3 t1x4 copies of c1 C2") for i in range(200)] + [(5, "t1x3 " * 9000 + "t2x1")]
    rng.shuffle(rows)
    items = [(i, " ".join(topic(i % 8)[:8])) for i in range(24)] + [(90, "copies of t1x3"), (91, "c1")]
    docs = documents(spark, rows).repartition(6)
    visits = []
    got = search_index.search(search_index.build(docs, shard_docs=shard_docs, fewest=fewest), items_of(spark, items), first_wave=wave, visits=visits)
    assert found(got) == plain(rows, items)
    if shard_docs == 7:
        assert sum(visits[:-1]) < 0.8 * visits[-1]


def test_bisection_puts_like_documents_together():
    """Of four shuffled topics each leaf of the first two levels holds mostly one; copies share a leaf."""
    rng = random.Random(3)
    texts = [[f"t{i % 4}x{x}".encode() for x in rng.sample(range(40), 15)] for i in range(400)]
    order = list(range(400))
    rng.shuffle(order)
    tree = search_index.bisect([texts[i] for i in order], 2)
    leaves = np.array([tree.leaf(t) for t in texts])
    assert tree.leaves == 4 and all(max(np.bincount(leaves[k::4], minlength=4)) >= 70 for k in range(4))
    assert search_index.bisect([], 5).leaves == 1 and search_index.bisect([[b"a"]] * 100, 3).leaf([b"a"]) == search_index.bisect([[b"a"]] * 100, 3).leaf([b"a"])
