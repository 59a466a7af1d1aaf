import hashlib
import random

import pytest

from driftwalk.llm import warc
from driftwalk.staging import new_path, stage

PAGES = "page_id long, url string, html string"


def round_trip(spark, pages, **options):
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path, **options)
    return stage(warc.read_captures(spark, path))


def brute(pages):
    sizes = [(i, (h or "").encode()) for i, _, h in pages]
    first = {}
    for i, p in sizes:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in sizes:
        shared = len(p) >= 100 and sum(x == p for _, x in sizes) > 1
        refers = first.get(p) if shared and first.get(p) != i else None
        kind = "response" if refers is None else "revisit"
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), kind, refers))
    return sorted(out, key=repr)


def contract(captures):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in captures.collect()), key=repr)


def test_round_trip(spark, rows):
    page = "<p>é</p>" * 30
    trap = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 5
    pages = [
        (3, "http://a.example/x", page), (1, "http://a.example/y?b=2&a=1", page), (2, None, page),
        (4, "not a url", trap), (5, "http://b.example/\r\nX: 1", trap), (6, "http://[bad", None),
        (7, "", ""), (8, "u", "short"), (9, "u", "short"), (1, "again", page), (None, "n", page),
        (10, "u", "y" * 400_000), (11, "u", "é" * 50), (12, "u", "é" * 50), (13, "u", "z" * 99),
        (14, "u", "z" * 99),
    ]
    table = rows(pages, PAGES).selectExpr("*", "1 AS digest", "2 AS value", "3 AS bytes")
    assert contract(round_trip(spark, table)) == brute(pages)
    assert contract(round_trip(spark, table, records_per_file=2)) == brute(pages)


def test_empty_table(spark, rows):
    captures = round_trip(spark, rows([(1, "u", "x")], PAGES).limit(0))
    assert captures.count() == 0 and warc.merge_captures(captures).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_are_utc_in_every_zone(spark, rows, zone):
    pages = rows([(1, "u", "x", 1_710_037_800), (2, "v", "y", 1_730_611_800), (3, "w", "z", None)],
                 f"{PAGES}, at long").selectExpr("*", "timestamp_seconds(at) AS time")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = round_trip(spark, pages, captured="time").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    first = f"{warc.FIRST_CAPTURE[:10]}T00:00:03Z"
    assert {r.page_id: r.captured for r in found} == {
        1: "2024-03-10T02:30:00Z", 2: "2024-11-03T05:30:00Z", 3: first,
    }


def test_histories_are_in_global_order(spark, rows):
    rolls = random.Random(1)
    pages = [(i, f"http://h{rolls.randrange(9)}.example/{rolls.randrange(4)}", f"p{i}") for i in range(500)]
    captures = round_trip(spark, rows(pages, PAGES), records_per_file=40)
    merged = warc.merge_captures(captures).orderBy("range_no", "position").collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in merged]
    assert keys == sorted(keys) and len(keys) == 500


def test_loser_tree():
    rolls = random.Random(2)
    for runs in range(9):
        made = [sorted(rolls.choices(range(50), k=rolls.randrange(20))) for _ in range(runs)]
        assert list(warc.LoserTree(made, lambda x: x)) == sorted(sum(made, []))


def test_url_keys_and_damage():
    assert warc.url_key("HTTPS://www.Shop.Example.com:443/A/?b=2&a=1#f") == "com,example,shop)/a?a=1&b=2"
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse_archive(b"nonsense\r\n", "f"))
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\n"
    head += b"WARC-Target-URI: u\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 3\r\n\r\n"
    with pytest.raises(ValueError, match="another digest"):
        list(warc.parse_archive(head + b"abc\r\n\r\n", "f"))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_archive(head + b"ab", "f"))
