import json

from tessella import cli
from tessella.operators import evaluate
from tessella.operators.postings import PostingIndex
from tessella.sources import dataset, providers
from tessella.sources.store import Store

TREES = "Binary search trees keep keys in order. " * 3 + "A balanced tree answers lookups in logarithmic time."
WAVES = "Sound waves travel through air and water. Their speed depends on the medium."


def lectures(tmp_path):
    (tmp_path / "a.txt").write_text(TREES)
    (tmp_path / "b.txt").write_text(WAVES)
    data = {"lectures": [
        {"id": "trees", "file": "a.txt", "source": "s", "questions": [{"question": "What do binary search trees keep in order?", "expected_answer": "Binary search trees keep keys in order.", "expected_keywords": ["keys", "trees"]}]},
        {"id": "waves", "file": "b.txt", "source": "s", "questions": [{"question": "Speed of sound waves in water?", "expected_answer": "The speed depends on the medium.", "expected_keywords": ["waves"]}, {"question": "zzz qqq?", "expected_answer": "nothing", "expected_keywords": ["none"]}]},
    ]}
    (tmp_path / "set.json").write_text(json.dumps(data))
    return str(tmp_path / "set.json"), str(tmp_path)


def test_run(spark, tmp_path):
    rows = dataset.load(spark, *lectures(tmp_path))
    store, embedder, generator = Store(spark, str(tmp_path / "store")), providers.HashEmbedder(2048), providers.EchoGenerator(lambda p: "context" if "Excerpt" in p else providers.first_passage(p))
    index = PostingIndex(spark, str(tmp_path / "postings"))
    for search_type, rerank in (("hybrid", False), ("cosine", False), ("hybrid", True)):
        got = {(r["lecture_id"], r["question"][:4]): r for r in evaluate.run(store, rows, embedder, generator, search_type, rerank, str(tmp_path / "report"), index=index).collect()}
        assert len(got) == 3 and store.documents().count() == 2 and store.in_progress() == 0
        assert got["trees", "What"]["passed"] and got["waves", "Spee"]["keyword_recall"] == 1.0 and got["waves", "zzz "]["n_sources"] == 0
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert "RAG EVALUATION REPORT" in text and "  Total questions:        3" in text and "[waves]" in text and "   Sources: 0 chunks" in text and index.size() == store.chunks().count()


def test_command(spark, tmp_path, capsys):
    path, folder = lectures(tmp_path)
    env = {"STORE": str(tmp_path / "s"), "REPORTS": str(tmp_path / "r")}
    assert cli.main(["run", path, folder], env) == 0 and list((tmp_path / "r").glob("evaluation-*/part-*"))
    assert cli.main(["lecture", "waves", path, folder], env | {"SEARCH_TYPE": "cosine", "RERANK": "true"}) == 0
    assert cli.main(["lecture", "none", path, folder], env) == 1 and cli.main(["list", path, folder], env) == 0
    assert "2 questions" in capsys.readouterr().out
