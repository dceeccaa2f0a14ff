import datetime as dt

from tessella.llm import url_filters as u

from .helpers import with_clashes

ENTRIES = [
    ("bad.com", "spam", "add", "2024-01-10"), ("bad.com", "spam", "remove", "2024-02-10"), ("bad.com", "spam", "add", "2024-03-10"), ("BAD.com/", "ads", "add", "2024-01-01"),
    ("ok.org/a/b", "path", "add", "2024-01-01"), ("bad.com", "spam", "add", "2024-03-20"), ("tie.net", "t", "add", "2024-01-05"), ("tie.net", "t", "remove", "2024-01-05"),
    (None, "x", "add", "2024-01-01"), ("n.com", "x", "add", None), ("bad.com", "x", "add", "no date"), ("odd.com", "x", "other", "2024-01-01"),
]
CAPTURES = [
    (1, "http://www.Bad.com/x", "2024-01-09"), (2, "http://www.bad.com", "2024-01-10"), (3, "http://bad.com/", "2024-02-10"), (4, "https://u:p@bad.com:80/q", "2024-04-01"), (5, "http://notbad.com/", "2024-01-20"),
    (6, "http://ok.org/a/b/c?x#y", "2024-05-01"), (7, "http://ok.org/a", "2024-05-01"), (8, "http://ok.org/A/b", "2024-05-01"), (9, "http://tie.net/", "2024-02-01"), (10, None, "2024-01-01"), (11, "", "2024-01-01"),
    (12, "http://bad.com/", None), (None, "http://bad.com/", "2024-01-20"), (2, "http://www.bad.com", "2024-01-10"), (13, "mailto:a@bad.com", "2024-01-20"), (14, "//bad.com/x", "2024-01-20"), (15, "www.bad.com:80/x", "2024-01-20"), (16, "ok.org/a/b", "2024-01-20"), (17, "/bad.com/x", "2024-01-20"), (18, "x.bad.com", "2024-01-20"),
    (19, "http://bad.com/" + "a/" * 300 + "?" + "q" * 50_000, "2024-01-20"),
]


def brute(url, day):
    if not url or not day:
        return []
    if "//" in url.split("?")[0]:
        rest = url.split("//", 1)[1]
    elif "." in url.split("/")[0] and "@" not in url:
        rest = url
    else:
        return []
    authority = rest.split("/")[0].split("?")[0].split("#")[0]
    host = authority.rsplit("@", 1)[-1].split(":")[0].lower()
    path = rest[len(authority) :].split("?")[0].split("#")[0].strip("/").lower()
    full, out = f"{host}/{path}/", set()
    for key, name in {(e.lower().rstrip("/"), n) for e, n, a, d in ENTRIES if e and d and d[0] == "2"}:
        hit = full.startswith(key + "/") if "/" in key else host == key or host.endswith("." + key)
        log = sorted((d, a == "remove") for e, n, a, d in ENTRIES if e and d and d[0] == "2" and e.lower().rstrip("/") == key and n == name and a in ("add", "remove") and d <= day)
        if hit and log and not log[-1][1]:
            out.add(name)
    return sorted(out)


def test_as_brute_force(spark):
    rows = [(i, x, dt.datetime.fromisoformat(d) if d else None) for i, x, d in CAPTURES]
    captures = with_clashes(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp"), "key", "since", "host", "lists", "u")
    entries = with_clashes(spark.createDataFrame(ENTRIES, "entry string, list string, action string, dated string"), "until", "key")
    want = sorted((str(i), str(x), str(brute(x, d))) for i, x, d in CAPTURES)
    for limit in (1000, 0):
        got = u.filter_urls(captures, entries, broadcast_rows=limit).collect()
        assert sorted((str(r["page_id"]), str(r["url"]), str(r["lists"])) for r in got) == want
        assert all(r["blocked"] == bool(r["lists"]) for r in got)
    assert u.filter_urls(captures.limit(0), entries).collect() == []
    assert not any(r["blocked"] for r in u.filter_urls(captures, entries.limit(0)).collect())
