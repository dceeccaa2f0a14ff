import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid

from .helpers import documents, odd_rows, with_clashes


@pytest.fixture(scope="module")
def pieces():
    return langid.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def all_segmentations(model, w, lang):
    """The sum over every way to cut the word into pieces or unknown characters."""
    if not w:
        return 1.0
    total = 0.0
    for k in range(1, len(w) + 1):
        row = model.row.get(w[:k], int(k == 1))
        if row:
            total += model.prob[row, lang] * all_segmentations(model, w[k:], lang)
    return total


def plain_score(model, w):
    """The same sum for long words, in logarithms and by strings."""
    w, past = "▁" + w, [np.zeros(len(model.langs))]
    for e in range(1, len(w) + 1):
        ways = [past[k] + np.log(model.prob[model.row[w[k:e]] if w[k:e] in model.row else 1]) for k in range(max(0, e - model.longest), e) if w[k:e] in model.row or e - k == 1]
        past.append(np.logaddexp.reduce(ways))
    return past[-1]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    m = langid.Model(["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "é"], ["x", "y"])
    m.prob[2:] = rng.random((9, 2)) / 9
    for w in ["", "a", "ab", "abab", "ccb", "éab", "😀a", "ababbaaba"]:
        want = [math.log(all_segmentations(m, "▁" + w, j)) for j in range(2)]
        assert m.score([w])[0] == pytest.approx(want, rel=1e-9)
        assert m._scaled(["▁" + w, "▁a"])[0] == pytest.approx(want, rel=1e-9)
    words = ["abba" * 100, "a", "ab" * 30, "ccb" * 9, "b" * 23, "b" * 24]
    for w, got in zip(words, m.score(words), strict=True):
        assert got == pytest.approx(plain_score(m, w))


def test_em_raises_the_likelihood(pieces):
    counts = {"x": {"hello": 5_000_000, "help": 3_000_000, "hell": 2_000_000, "world": 4_000_000}}
    words, n = list(counts["x"]), np.array(list(counts["x"].values()))
    last = -math.inf
    for steps in (0, 1, 2, 4):
        now = float((langid.Model(pieces, ["x"]).fit(counts, steps).score(words)[:, 0] * n).sum())
        assert now > last - 1
        last = now


def test_long_words_teach_whole():
    """Expected pieces in logarithms, of words of mixed lengths, are those of the plain recursion; a piece across any place of a long word counts."""
    rng = np.random.default_rng(2)
    m = langid.Model(["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab"], ["x"])
    p = np.concatenate([[0, langid.UNKNOWN], rng.random(8) / 8])
    words, c = ["▁abab", "▁ab", "▁cabbac", "▁abaabaab"], np.array([1.0, 3, 2, 5])
    plain = sum(m._expected_short([w], np.array([n]), p) for w, n in zip(words, c, strict=True))
    assert m._expected_long(words, c, p) == pytest.approx(plain, rel=1e-9)
    seen = langid.Model(["▁", "a", "b", "aba"], ["x"]).fit({"x": {"b" * (langid.UNIT - 2) + "aba" + "b" * 500: 1}}).prob
    assert seen[5, 0] > seen[3, 0] * 10  # "aba", not "a"


def sample(rng, lang):
    stems = {"en": ["the", "ing", "and", "tion"], "de": ["sch", "ung", "der", "und"], "fr": ["eau", "ment", "les", "que"]}[lang]
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(12))


def test_held_out_accuracy_and_odd_rows(spark, pieces):
    import zlib

    rng = random.Random(2)
    rows = [(i, sample(rng, lang), lang) for i, lang in ((i, rng.choice(["en", "de", "fr"])) for i in range(400))]
    docs = documents(spark, rows + [(1000 + k, t, None) for k, (_, t) in enumerate(odd_rows())] + [(None, "the and ing", "zz")])
    out = langid.identify(with_clashes(docs, "lang_pred", "score", "held_out"), pieces, texts_per_lang=100).collect()
    assert len(out) == docs.count()
    truth = {i: x for i, _, x in rows}
    held = [r for r in out if r["doc_id"] in truth and r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    by = {r["doc_id"]: r for r in out}
    for k, (_, t) in enumerate(odd_rows()):
        blank = not any(c.isalpha() for c in t or "")
        assert (by[1000 + k]["lang_pred"] == "und") == blank
    assert all(0 <= r["score"] <= 1 for r in out) and "zz" not in {r["lang_pred"] for r in out}


def test_scripts_without_spaces(spark, pieces):
    """Sentences that are one long word each: both languages teach, and are told apart on held-out rows."""
    rng = random.Random(4)
    letters = {"han": [chr(0x4E00 + 7 * k) for k in range(300)], "kana": [chr(0x3041 + k) for k in range(80)]}
    rows = [(i, "".join(rng.choices(letters[lang], k=40)), lang) for i, lang in enumerate(["han", "kana"] * 300)]
    rows += [(10_000 + i, "the ing and tion that " * 30, "en") for i in range(40)]
    out = langid.identify(documents(spark, rows), pieces).collect()
    truth = {i: x for i, _, x in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] < 10_000]
    assert len(held) > 100 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_small_languages_are_not_crowded_out(spark, pieces):
    rng = random.Random(8)
    rows = [(i, sample(rng, "en"), "en") for i in range(600)] + [(1000 + i, sample(rng, "fr"), "fr") for i in range(40)]
    out = langid.identify(documents(spark, rows), pieces).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] >= 1000]
    assert held and all(r["lang_pred"] == "fr" for r in held)


def test_as_brute_force(spark, pieces):
    """Every prediction over a whole table against the sum by strings."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()).select("text", "lang"), pieces)
    texts, known = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    for r in langid.identify(docs, pieces).collect():
        words = (texts[r["doc_id"]] or "").lower().split()
        for w in words:
            if w not in known:
                known[w] = plain_score(model, w)
        total = sum((known[w] for w in words), np.zeros(len(model.langs)))
        if not any(c.isalpha() for c in texts[r["doc_id"]] or ""):
            assert r["lang_pred"] == "und"
        else:
            assert r["lang_pred"] == model.langs[int(total.argmax())] and r["score"] == pytest.approx(1 / np.exp(total - total.max()).sum())


def test_own_columns_stay(spark, pieces):
    df = documents(spark, [(1, "these are plain words", "en"), (3, "and some more words", "en")]).withColumns({"score": F.lit(-7.5), "lang_pred": F.lit("mine")})
    out = langid.label(df, pieces)
    assert out.columns == [*df.columns, "_lang_pred", "_score"]
    assert {(r["score"], r["lang_pred"], r["_lang_pred"]) for r in out.collect()} == {(-7.5, "mine", "en")}


def test_nothing_to_learn_from(spark, pieces):
    assert [tuple(r)[2:] for r in langid.identify(documents(spark, [(1, "abc", None)]), pieces).collect()] == [("und", 0.0)]
    assert langid.identify(documents(spark, []), pieces).collect() == []
