import hashlib
import random

from helpers import rows_of
from litsieve.llm import warc
from litsieve.session import read_table


def test_loser_tree_merges():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((rng.choice("abc"), str(rng.randint(0, 9)), rng.choice([None, 1, 2, 3]), None, "", 0, "", None, f"r{j}", i, 0)
                        for i in range(rng.randint(0, 20))), key=warc._order) for j in range(k)]
        got = list(warc.LoserTree([iter(r) for r in runs]))
        assert got == sorted((x for r in runs for x in r), key=warc._order)


def test_url_key():
    assert warc.url_key("https://www.Example.com:80/a/b/?q=1#top") == "com,example)/a/b/?q=1"
    assert warc.url_key("http://a.b.org") == "org,b,a)/" and warc.url_key(None) == ")/"


def plain(pages):
    first = {}
    for p in pages:
        body = (p["html"] or "").encode()
        if len(body) >= 100 and p["page_id"] is not None:
            first[body] = min(first.get(body, p["page_id"]), p["page_id"])
    out = []
    for p in pages:
        body = (p["html"] or "").encode()
        low = first.get(body) if p["page_id"] is not None else None
        again = low is not None and p["page_id"] > low
        out.append((p["page_id"], len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=str)


def check(pages, rows):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == plain(pages)
    by_url = lambda x: sorted(((p["page_id"], p["url"]) for p in x), key=str)
    assert by_url(rows) == by_url(pages)
    rows.sort(key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows)))
    key = lambda r: (r["url_key"], r["timestamp"], r["page_id"] is not None, r["page_id"] or 0)
    assert [key(r) for r in rows] == sorted(key(r) for r in rows)


def test_pages_round_trip(spark):
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    check(rows_of(pages), rows_of(warc.archive_and_index(pages)))


def test_odd_pages(spark, tmp_path):
    body = "<p>é WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "x" * 100
    rows = [(i, "http://hot.example/x", body) for i in range(30, 60)] + [
        (1, None, None), (2, "http://a/\r\nb%0A", ""), (3, "u", "short"), (4, "u", "short"), (None, "n", body), (None, None, None),
        (9, "", body + "é" * 70_000), (29, "http://hot.example/x", body), (29, "http://hot.example/x", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "'x' as value")
    folder = str(tmp_path / "archives")
    check(rows_of(pages), rows_of(warc.archive_and_index(pages, folder)))
    captured = warc.read_archives(spark, folder)
    check(rows_of(pages), rows_of(warc.merge_index(captured, 5)))
    assert warc.archive_and_index(pages.where("page_id < 0")).count() == 0
