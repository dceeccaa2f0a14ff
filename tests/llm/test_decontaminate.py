import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import decontaminate as dc

from .helpers import documents, odd_rows, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(rows, items):
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            v = words(x)
            m = min(10, len(v))
            wins = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)} if m else set()
            for j in range(len(w) - m + 1):
                if m and tuple(w[j : j + m]) in wins:
                    hit.update(range(j, j + m))
                    ids.add(str(k))
        out.append((str(i), len(w), len(hit), sorted(ids), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_as_brute_force(spark, limit):
    rng = random.Random(limit)
    voc = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(12)]
    items = [(k, " ".join(rng.choices(voc, k=rng.choice([1, 2, 4, 6, 9, 10, 11, 14, 30])))) for k in range(40)] + [(90, None), (91, "..."), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (92, "É é E e")]
    rows = []
    for n in range(80):
        text = rng.choices(voc, k=rng.choice([0, 1, 5, 9, 10, 40, 120]))
        if rng.random() < 0.5:
            v = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(v) + 1)
            text[len(text) // 2 : len(text) // 2] = v[a : a + rng.randint(5, 20)]
        rows.append((n, rng.choice([" ", "-", "\n. "]).join(text).upper() if rng.random() < 0.3 else " ".join(text)))
    rows += [(i + 200 if i is not None else None, t) for i, t in odd_rows() if i != 5] + [(300, "é É e")]
    docs = with_clashes(documents(spark, rows), "m", "p", "h", "item_id", "n")
    bench = with_clashes(spark.createDataFrame(items, "item_id long, text string"), "doc_id", "f", "ih")
    got = dc.decontaminate(docs, bench, broadcast_rows=limit).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == plain(rows, items)


def test_rows_that_share_an_id_stay_apart(spark):
    """One contaminated and one clean text for no id and for id 5, and the contaminated one twice."""
    span = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    rows = [(None, f"a {span} b"), (None, "clean words"), (5, "x y"), (5, f"{span} c"), (5, f"{span} c"), (7, "fine"), (None, None)]
    got = dc.decontaminate(documents(spark, rows), spark.createDataFrame([(1, span)], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == plain(rows, [(1, span)])


def test_long_items_only(spark):
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(6)]
    items = [(k, " ".join(rng.choices(voc, k=rng.randint(10, 40)))) for k in range(15)]
    rows = [(n, " ".join(rng.choices(voc, k=200) + items[n % 15][1].split()[2:14])) for n in range(30)]
    got = dc.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got) == plain(rows, items)


def test_winnowing_keeps_one_in_every_window(spark):
    g = [5, 3, 3, 9, 1, 7, 7, 2, 8, 8, 8, 4]
    kept = spark.createDataFrame([(g,)], "g array<bigint>").select(dc._winnowed(F.col("g"), 4).alias("k")).first()["k"]
    at = {x["p"] for x in kept}
    assert all(at & set(range(i, i + 4)) for i in range(len(g) - 3)) and len(at) < len(g)


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in dc.decontaminate(documents(spark, [(1, "a b")]), bench).collect()] == [(1, 2, 0, [], False)]
    assert dc.decontaminate(documents(spark, []), bench).collect() == []
