import hashlib
import io
import random

import pytest
import zstandard

from tessella.llm import warc

from .helpers import with_clashes


def plain(rows):
    out = []
    for page, _, html in rows:
        p = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == p and i is not None]
        first = min(same, default=None) if len(p) >= 100 else page
        refers = first if first is not None and first != page else None
        out.append((str(page), len(p), hashlib.sha256(p).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def archive(spark, tmp_path, rows, name="w"):
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"), "payload", "digest", "first", "size")
    warc.write_archives(pages, f"file://{tmp_path}/{name}")
    return warc.read_archives(spark, f"file://{tmp_path}/{name}")


def test_round_trip(spark, tmp_path):
    big = "<p>" + "text " * 50
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (2, "http://a/ 2\r\nX: y", big + "é😀"), (4, "u", "short"), (5, "u", "short"), (6, None, None), (7, "u", ""), (8, "u", "x" * 300_000), (1, "http://a/1", big), (None, "u", big)]
    rows += [(100 + i, f"http://b/{i}", f"<html><body>{i} " + "boilerplate words " * 40) for i in range(200)]
    got = archive(spark, tmp_path, rows).drop("url").collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == plain(rows)


def test_format(spark, tmp_path):
    rows = [(i, f"http://b/{i}", f"<html><body>{i} " + "boilerplate words " * 60) for i in range(400)]
    archive(spark, tmp_path, rows)
    files = sorted((tmp_path / "w").glob("*.warc.zst"))
    seen = 0
    for f in files:
        data = f.read_bytes()
        assert data[:4] == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        with zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True) as r:
            text = r.read()
        assert text.count(b"WARC/1.1\r\n") == 1 + text.count(b"WARC-Type: response")
        seen += text.count(b"WARC-Type: response")
        if text.count(b"WARC-Type: response") > 60:
            assert words.dict_id()  # trained
    assert seen == 400


def test_archives_are_bounded(spark, tmp_path):
    """By frames and by bytes: each file has a dictionary of its own, and nothing is lost at the seams."""
    rng = random.Random(1)
    rows = [(i, f"http://b/{i}", f"{i} " + rng.randbytes(400 if i % 50 else 60_000).hex()) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w", archive_frames=40, archive_bytes=50_000)
    files = list((tmp_path / "w").glob("*.warc.zst"))
    assert len(files) >= 300 / 38 and all(f.read_bytes()[:4] == warc.DICTIONARY_MAGIC for f in files)
    got = warc.read_archives(spark, f"file://{tmp_path}/w").drop("url").collect()
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == plain(rows)
    for frames, most in ((3, 10**9), (5, 1), (400, 10**9)):
        made = list(warc.archives(iter([b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx"] * 10), "d", frames, most))
        for lo in range(0, len(made), frames):
            assert made[lo][:4] == warc.DICTIONARY_MAGIC
        assert len(list(warc.records(b"".join(made)))) == 10 + -(-len(made) // frames)


def test_unnamed_archives_are_refused(spark, tmp_path):
    """A driver that is lost before all files have their names leaves no result that could be taken for whole."""
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([(i, "u", f"payload {i}") for i in range(50)], "page_id long, url string, html string").repartition(3), path)
    one = next((tmp_path / "w").glob("*.warc.zst"))
    one.rename(one.with_name(one.name.removesuffix(".warc.zst") + ".txt"))
    with pytest.raises(ValueError, match="names"):
        warc.read_archives(spark, path)
    for _ in range(2):
        warc.name_archives(spark, path)
        assert warc.read_archives(spark, path).count() == 50


def test_empty(spark, tmp_path):
    assert archive(spark, tmp_path, []).collect() == []


def test_frames():
    z = zstandard.ZstdCompressor(write_checksum=True)
    parts = [z.compress(b""), b"P*M\x18\0\0\0\0", z.compress(b"a" * 400_000), z.compress(bytes(range(256)) * 900)]
    data, at, ends = memoryview(b"".join(parts)), 0, []
    while at < len(data):
        at = warc.frame_end(data, at)
        ends.append(at)
    assert [b - a for a, b in zip([0, *ends], ends, strict=False)] == list(map(len, parts))
