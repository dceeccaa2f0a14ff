import duckdb
import pytest

import __spark_entry__ as e
import corpus_pipeline
from tessella.llm import bpe, langid, queries

SF = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_as_sql(spark, name):
    df = e.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(e.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns) and got == rows_of(columns, cur.fetchall())


def certain(model, text):
    """Whether the text has a letter and a best language with a posterior of at least a half, by the plain sum."""
    import numpy as np

    from .test_langid import plain_score

    if not any(c.isalpha() for c in text or ""):
        return False
    total = sum(plain_score(model, w) for w in text.lower().split())
    return 1 / np.exp(total - total.max()).sum() >= 0.5


def test_pipeline(spark):
    """Each stage against a brute-force version of it on what it was given."""
    import public_tokenizers
    import tiktoken

    from .test_decontaminate import plain as contaminated
    from .test_line_dedup import plain as lines
    from .test_minhash import plain as groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        kept = {r["doc_id"]: r for r in out.collect()}
        rows = [(i, r["text"]) for i, r in given.items()]
        if name == "language_id":
            pieces = langid.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
            model = langid.learn(docs.where(~langid.held_out()).select("text", "lang"), pieces)
            assert set(kept) == {i for i, t in rows if certain(model, t)} and len(kept) > 0.97 * len(given)
        elif name == "line_dedup":
            gone = {i: set(x) for i, _, _, x in lines(rows)}
            left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in rows}
            assert {i: r["text"] for i, r in kept.items()} == {i: t for i, t in left.items() if t.strip()}
            assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
        elif name == "near_dedup":
            assert set(kept) == {i for i, _, _, k in groups(rows) if k}
        else:
            assert {str(i) for i in kept} == {i for i, *_, hit in contaminated(rows, items) if not hit}
        docs, given = spark.createDataFrame(list(kept.values()), docs.schema), kept
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(r["text"]) for i, r in given.items()}
    assert {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == want
    assert {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, empty tables, in every stage."""
    from .helpers import documents, odd_rows, with_clashes

    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "these are twelve plain words of a text that is told here twice"
    rows = [*odd_rows(), (20, text), (20, text), (21, text), (22, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (None, None), (None, "with a hit w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (20, "again w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    names = ("hit_text", "text_hash", "hit_id", "hit_hash", "rid", "_d", "_id", "_rid", "_lines", "digest", "kept", "v", "line", "pos", "lang_pred", "score", "hit", "s", "e", "w", "block", "part")
    docs = with_clashes(documents(spark, rows), *names)
    stages = dict(corpus_pipeline.STAGES)
    out = {n: stages[n](spark, docs, str(tmp_path)) for n in list(stages)[:-1]}
    for n, df in out.items():
        assert df.columns == docs.columns, n
        assert stages[n](spark, docs.limit(0), str(tmp_path)).collect() == [], n
        assert all(r[c] == "x" for r in df.collect() for c in names), n
    ids = {n: sorted((str(r["doc_id"]) for r in df.collect())) for n, df in out.items()}
    assert ids["language_id"] == sorted(str(i) for i, t in rows if any(c.isalpha() for c in t or ""))
    assert ids["line_dedup"] == sorted(["4", "5", "5", "None", "None", "7", "8", "20", "20", "20", "22"])
    assert ids["near_dedup"].count("5") == 1 and ids["near_dedup"].count("20") == 2 and "21" not in ids["near_dedup"] and ids["near_dedup"].count("None") == 3
    assert ids["decontaminate"] == sorted(str(i) for i, t in rows if "w9 w10" not in (t or "") or "word" in t)
    last = stages["byte_bpe"](spark, docs, str(tmp_path)).collect()
    assert len(last) == len(rows) and stages["byte_bpe"](spark, docs.limit(0), str(tmp_path)).collect() == []
