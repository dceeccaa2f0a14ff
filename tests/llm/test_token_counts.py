import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import queries, token_counts

from .helpers import documents, odd_rows, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source():
    return token_counts.load_tokenizer(PATH)


def plain(texts, path=PATH):
    own = Tokenizer.from_file(path)
    return [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]


def rows(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect())


def wanted(given, limit=token_counts.LIMIT, path=PATH):
    return sorted((str(i), len((t or "").encode()), n, n > limit) for (i, t), n in zip(given, plain([t for _, t in given], path), strict=True))


def test_query_as_library(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = rows(queries.op12_token_counts(spark, SF))
    assert got == wanted(given) and any(r[3] for r in got)


ODD = [
    "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "İstanbul ΣΑΣ ẞ T̈x ẗ", "é  x　y\x1cz w\x85v\x0bu", "it's WE'LL don't 's", "１２ 12 ½ ²", "́ ́a á̧",
    "😀👩‍👩‍👧 ﬁ Å Å", "\r\n\t", "日本語テキスト 한국어", "x" * 5000, "1" * 3000, "\x00 a\x00b", "가가 ก็",
]


def test_odd_rows_and_blocks(spark, source):
    """Special strings, composing letters, white space beyond ASCII, repeated and null rows; blocks of any size give the same."""
    given = [r[:2] for r in odd_rows()] + [(100 + k, t) for k, t in enumerate(ODD)] + [(100, ODD[0])]
    docs = with_clashes(documents(spark, given), "block", "part", "numbers", "n_bytes", "n_tokens", "of")
    assert rows(token_counts.count_tokens(docs, source)) == wanted(given)
    assert rows(token_counts.count_tokens(docs, source, limit=3, block_words=4, block_distinct=2)) == wanted(given, 3)
    assert rows(token_counts.count_tokens(docs.limit(0), source)) == []
    text_ids = docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert rows(token_counts.count_tokens(text_ids, source)) == sorted((f"d{i}" if i != "None" else i, *r) for i, *r in wanted(given))


def test_other_tokenizer_with_spaces(spark):
    """One whose tokens hold the space before a word isn't cut at white space."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    source = token_counts.load_tokenizer(path)
    assert not token_counts.drops_white_space(source) and token_counts.drops_white_space(token_counts.load_tokenizer(PATH))
    given = [(k, t) for k, t in enumerate([*ODD, "two  spaces and <|endoftext|> here"])]
    assert rows(token_counts.count_tokens(documents(spark, given), source)) == wanted(given, path=path)
