import pytest
from pyspark.sql import functions as F

from tessella.llm import licenses
from tessella.llm.license_texts import KNOWN

from .helpers import documents, odd_rows, with_clashes

MIT = KNOWN[0][1]


def test_scan(spark):
    rows = [
        (1, MIT), (2, "Copyright (c) 2020 Someone\n\n" + MIT.upper()), (3, MIT.replace("Software", "Programme")), (4, MIT.replace(" ", "\n   ").replace('"', "“")), (5, MIT[:-20]),
        (6, "Some text\nReleased under the MIT Licence!\nmore\nLicensed under CC BY-NC 4.0"), (7, "released under the mit license"), (8, "© X\nAll rights reserved.\nLicenced under the Apache licence, version 2.0."),
    ]
    docs = with_clashes(documents(spark, rows + [(100 + k, t) for k, (_, t) in enumerate(odd_rows())]), "digest", "license")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [got[i]["license"] for i in range(1, 9)] == ["MIT", "MIT", None, "MIT", None, None, "MIT", "Apache-2.0"]
    assert got[6]["line_licenses"] == ["CC-BY-NC-4.0", "MIT"] and got[7]["line_licenses"] == ["MIT"]
    assert got[100]["digest"] is None and got[101]["digest"] is None and got[102]["digest"] is None and got[108]["digest"] is None and got[104]["digest"]
    assert licenses.scan(docs.limit(0)).collect() == []


@pytest.mark.parametrize("limits", [{}, {"most_known": 3}, {"most_known": 3, "most_lines": 2}, {"most_lines": 2}])
def test_every_known_text_is_found(spark, limits):
    """Whole licences, with other spacing and copyright lines of their own too, whichever way the known ones are joined."""
    docs = documents(spark, [(i, t) for i, (_, t) in enumerate(KNOWN)])
    lined = documents(spark, [(i, "Copyright 2021 Some One\n" + t.replace("\n", "\r\n  ")) for i, (_, t) in enumerate(KNOWN)])
    assert {r["license"] for r in licenses.scan(lined, **limits).collect()} == {n for n, _ in KNOWN}
    assert {"GPL-3", "GPL-2", "LGPL-2.1", "Apache-2.0", "MPL-2.0", "CC0-1.0"} <= {n for n, _ in KNOWN}
    known = spark.createDataFrame(KNOWN, "license string, known_text string")
    got = licenses.scan(docs, known if limits else KNOWN, **limits).collect()
    assert sorted(licenses.scan(docs).collect(), key=str) == sorted(got, key=str)
    assert {r["doc_id"]: r["license"] for r in got} == {i: n for i, (n, _) in enumerate(KNOWN)}


def test_canonical(spark):
    df = spark.createDataFrame([("Favour  the ORGANISATION's sub-licence.\ncopyright 2020 x\n  # (C) y\nend",)], "t string")
    assert df.select(licenses.canonical(F.col("t")).alias("c")).first()["c"] == "favor the organisations sublicense end"
