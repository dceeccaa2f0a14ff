import random
from collections import Counter

import pytest

from tessella.llm import line_dedup as d

from .helpers import documents, odd_rows, with_clashes


def near(a, b, edits=1):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1] <= edits


def plain(rows, least=30, edits=1):
    """Lines of fewer than ``least`` characters are compared as they are."""
    lines = [(i, p, x.strip(" \t\r\x0b\x0c")) for i, t in rows for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")]
    first = {}
    for i, p, x in lines:
        first[x] = min(first.get(x, (i, p)), (i, p))
    links, long = {x: [] for x in first}, sorted((x for x in first if len(x) >= least), key=len)
    by = {x: Counter(x) for x in long}
    for k, x in enumerate(long):
        for y in long[k + 1 :]:
            if len(y) - len(x) > edits:
                break
            if (by[x] - by[y]).total() <= edits and near(x, y, edits):
                links[x].append(y)
                links[y].append(x)
    out = []
    for i, _ in rows:
        own = [(p, x) for k, p, x in lines if k == i]
        gone = [p for p, x in own if (i, p) > min([first[x], *(first[y] for y in links[x])])]
        out.append((i, len(own), sum(len(links[x]) for _, x in own), sorted(gone)))
    return sorted(out)


def edit(rng, x):
    k = rng.randrange(len(x))
    return rng.choice([x[:k] + x[k + 1 :], x[:k] + "Q" + x[k + 1 :], x[:k] + "é" + x[k:]])


@pytest.mark.parametrize("edits, group, block", [(1, 16, 64), (1, 3, 2), (2, 16, 8), (3, 16, 8)])
def test_as_brute_force(spark, monkeypatch, edits, group, block):
    monkeypatch.setattr(d, "BLOCK", block)
    rng = random.Random(group)
    base = ["".join(rng.choices("abcdef ", k=rng.randint(29, 90))).strip() + "x" for _ in range(25)]
    rows = []
    for n in range(60):
        own = [rng.choice([b, edit(rng, b), edit(rng, edit(rng, b)), edit(rng, edit(rng, edit(rng, b)))]) for b in rng.choices(base, k=rng.randint(0, 6))]
        rows.append((n, rng.choice(["\n", " \n\t", "\n\n"]).join(own)))
    source = "one passage that very many documents share with small edits of their own"
    rows += [(100 + i, edit(rng, source)) for i in range(60)] + [(99, source)]
    rng.shuffle(rows)
    got = d.line_report(with_clashes(documents(spark, rows), "rid", "i", "j", "line", "len"), edits=edits, group=group).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_links"], r["removed"]) for r in got) == plain(rows, edits=edits)


def test_dedup_lines(spark):
    line = "a line that is long enough to be compared at all"
    rows = [(1, f"{line}\nshort\nend"), (2, f"another\n  {line}x \nkept as it is, with blanks  \nanother"), (3, line), (4, None), (5, "short")]
    got = {r["doc_id"]: r for r in d.dedup_lines(with_clashes(documents(spark, rows), "pos", "removed")).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "another\nkept as it is, with blanks  " and got[3]["text"] == "" and got[4]["text"] is None and got[5]["text"] == ""
    assert got[1]["removed"] == "x" and got[1]["lang"] == "en"


def test_odd_rows(spark):
    got = d.line_report(documents(spark, odd_rows())).collect()
    assert len(got) == len(odd_rows()) and not any(r["removed"] for r in got)
    assert {r["doc_id"]: r["n_lines"] for r in got if r["doc_id"]} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 7: 2, 8: 1}
    twice = d.line_report(documents(spark, [(1, "w" * 40), (1, "w" * 40), (2, "w" * 40)])).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["removed"]) for r in twice) == [(1, 1, []), (1, 1, []), (2, 1, [0])]
    assert d.line_report(documents(spark, [])).collect() == []


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_within(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        x = "".join(rng.choices("abé😀", k=rng.randint(1, 14)))
        y = x
        for _ in range(rng.randint(0, 4)):
            y = edit(rng, y or "z")
        pairs.append((x, y or "z"))
    rows = spark.createDataFrame(pairs, "x string, y string")
    from pyspark.sql import functions as F

    for x, y, got in rows.select("x", "y", d.within(F.col("x"), F.col("y"), edits)).collect():
        assert got == near(x, y, edits), (x, y)


@pytest.mark.parametrize("edits", [1, 2])
def test_profiles_lose_no_pair(spark, edits):
    """The counts turn away strangers and no pair within the edits, at counts beyond a byte too."""
    from pyspark.sql import functions as F

    rng = random.Random(edits)
    pairs = []
    for size in [31, 40, 255 * 3, 256 * 7, 3000] * 30:
        x = y = "".join(rng.choices(rng.choice(["a", "ae io", "abcdefghijklmnopqrstuvwxyz 0123456789é😀"]), k=size))
        for _ in range(edits):
            y = edit(rng, y)
        pairs += [(x, y, True), (x, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=size)), False)]
    rows = spark.createDataFrame(pairs, "x string, y string, near boolean")
    got = rows.select("near", d._alike(d.profile(F.col("x")), d.profile(F.col("y")), edits).alias("alike")).collect()
    assert all(r["alike"] for r in got if r["near"]) and sum(r["alike"] for r in got) < len(pairs) * 0.6
