import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe

from .helpers import documents, odd_rows, with_clashes


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def merged(piece, ranks):
    """BPE by its definition: join the neighbours of least rank until none has one."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 10**9))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_split_and_merge_as_the_library(ranks, library, text):
    pieces = bpe.split_pattern(public_tokenizers.PATTERN).findall(text)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in merged(p.encode(), ranks)] == library.encode_ordinary(text)


def test_white_space_as_the_library(library):
    rng = random.Random(3)
    find = bpe.split_pattern(public_tokenizers.PATTERN).findall
    for _ in range(2000):
        text = "".join(rng.choice(" \t\n\r\x0b\x1c\x1d\x1f\x85\xa0  's1a!") for _ in range(rng.randint(0, 9)))
        assert [i for p in find(text) for i in library._encode_single_piece(p)] == library.encode_ordinary(text)


@pytest.mark.parametrize("block", [{}, {"block_tokens": 7, "block_words": 5}])
def test_round_trip(spark, ranks, library, block):
    rows = [*odd_rows(), (9, "It's  123 déjà-vu\n\n  end"), (10, "It's It's <|endoftext|>")]
    docs = with_clashes(documents(spark, rows), "block", "part", "words", "token_ids", "positions")
    got = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, **block), ranks).collect()
    assert sorted((str(r["doc_id"]), r["token_ids"]) for r in got) == sorted((str(i), library.encode_ordinary(t or "")) for i, t in rows)
    by = {r["doc_id"]: bytes(r["decoded"]) for r in got}
    assert all(by[i] == (t or "").encode() for i, t in rows)


def test_empty(spark, ranks):
    assert bpe.digests(bpe.decode(bpe.encode(documents(spark, []), ranks, public_tokenizers.PATTERN), ranks)).collect() == []
    only = bpe.digests(bpe.decode(bpe.encode(documents(spark, [(1, None)]), ranks, public_tokenizers.PATTERN), ranks)).first()
    assert only["n_tokens"] == 0 and only["ids_sha256"].startswith("e3b0c442") and only["decoded_sha256"].startswith("e3b0c442")
