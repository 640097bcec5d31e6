import base64
import gzip
import hashlib

import pytest

from pyspark.sql import functions as F

from tessella.llm import warc

ROWS = [
    (9, "http://a/9", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"), (5, "http://a/5", None), (4, "http://a/4", ""), (7, "http://a/é\r\n7", "ünï 日本 \r\n\r\n WARC/1.1\r\n"),
    (8, None, "x" * 300_000), (10, "http://b", "<p>same</p>"), (11, "http://c", "ab" * 100_000),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)


def test_round_trip(pages):
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(ROWS)
    for i, _, html in ROWS:
        data = (html or "").encode()
        first = min(j for j, _, h in ROWS if (h or "") == (html or ""))
        r = got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))


def test_payloads_filters_and_sizes(spark, pages, tmp_path, monkeypatch):
    path = "file://" + str(tmp_path / "w")
    warc.write_pages(pages, path)
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert {k: r.payload for k, r in got.items() if r.record_type == "response"} == {f"urn:page:{i}": h or "" for i, _, h in ROWS if i in (3, 4, 7, 8, 11)}
    some = warc.read(spark, path, payload=False).where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert sorted(r.record_id for r in some.collect()) == ["urn:page:5", "urn:page:9"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "record_type" in plan
    assert warc.read(spark, path).where(F.col("record_id").isin("urn:page:7", "urn:page:8")).count() == 2


def test_rejected_payloads_stay_compressed(tmp_path, monkeypatch):
    path = tmp_path / "one.warc.gz"
    big = bytes(range(256)) * 20_000
    path.write_bytes(b"".join(warc.member(warc.record("response", f"urn:page:{k}", "u", big, warc.digest_of(big))) for k in range(4)))
    reader = warc.WarcReader(str(path), True, False)
    assert [*reader.pushFilters([warc.EqualTo(("record_id",), "urn:page:2"), warc.EqualTo(("payload",), "x")])] == [warc.EqualTo(("payload",), "x")]
    inflated = []
    more = warc.Member._more
    monkeypatch.setattr(warc.Member, "_more", lambda self, n: (inflated.append(n), more(self, n))[1])
    rows = [*reader.read(warc.Part([("", 0, None)]))]
    assert len(rows) == 1 and rows[0][8] == big.decode("utf-8", "replace")
    assert sum(n for n in inflated if n == 2048) <= 4 * 2048 + 4096  # one look at each header


def test_members_are_gzip_and_foreign_files(tmp_path):
    records = [warc.record("response", f"urn:page:{k}", "u", b"abc" * k, warc.digest_of(b"abc" * k)) for k in range(5)]
    assert gzip.decompress(b"".join(map(warc.member, records))) == b"".join(records)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))  # no skip lengths
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    reader = warc.WarcReader(str(tmp_path), True, True)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(r[8] for r in rows) == sorted(2 * ["abc" * k for k in range(5)])


def test_wrong_digest_is_told(tmp_path):
    (tmp_path / "a.warc").write_bytes(warc.record("response", "urn:page:1", "u", b"abc", warc.digest_of(b"abd")))
    reader = warc.WarcReader(str(tmp_path), False, True)
    with pytest.raises(ValueError):
        [*reader.read(reader.partitions()[0])]


def test_empty_table(spark, pages):
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0


def test_repeated_rows(spark):
    same = spark.createDataFrame([(1, "u", "x")] * 3 + [(2, "u", "x")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.round_trip(same).collect()) == [(1, "response")] * 3 + [(2, "revisit")]


def test_least_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "long"), (4, "u", "long")], "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "w")
    warc.write_pages(pages, path, least_bytes=2)
    assert sorted((r.record_id[-1], r.record_type) for r in warc.read(spark, path).collect()) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def test_all_other_filters_go_back_to_spark(spark, pages, tmp_path):
    path = "file://" + str(tmp_path / "w")
    warc.write_pages(pages, path)
    rows = {r.record_id: r.asDict() for r in warc.read(spark, path).collect()}
    for test, want in {
        "NOT record_type = 'response'": lambda r: r["record_type"] != "response",
        "record_type <> 'revisit' AND payload_bytes > 10": lambda r: r["record_type"] != "revisit" and r["payload_bytes"] > 10,
        "refers_to IS NULL": lambda r: r["refers_to"] is None,
        "refers_to IS NOT NULL": lambda r: r["refers_to"] is not None,
        "record_type = 'response' OR target_uri = 'http://a/9'": lambda r: r["record_type"] == "response" or r["target_uri"] == "http://a/9",
        "NOT (record_type IN ('response', 'x'))": lambda r: r["record_type"] != "response",
        "NOT refers_to <=> 'urn:page:3'": lambda r: r["refers_to"] != "urn:page:3",
        "record_id >= 'urn:page:5' AND record_type LIKE 're%' AND payload_digest IN ('x', 'y')": lambda r: False,
        "record_type LIKE '%visit' AND contains(target_uri, 'a')": lambda r: r["record_type"] == "revisit" and "a" in r["target_uri"],
        "headers['warc-type'] = 'revisit'": lambda r: r["record_type"] == "revisit",
    }.items():
        got = warc.read(spark, path, payload=False).where(test)
        assert {r.record_id for r in got.collect()} == {k for k, r in rows.items() if want(r)}, test


def test_push_filters_takes_what_it_can():
    from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, IsNull, Not, StringStartsWith

    taken = [EqualTo(("record_type",), "response"), In(("record_id",), ("a", "b")), StringStartsWith(("target_uri",), "http")]
    left = [Not(EqualTo(("record_type",), "x")), IsNull(("refers_to",)), GreaterThan(("payload_bytes",), 3), EqualNullSafe(("record_type",), "x"), EqualTo(("headers", "x"), "y"), EqualTo(("payload_bytes",), 3), In(("record_id",), ("a", None))]
    reader = warc.WarcReader("x", False, False)
    assert [*reader.pushFilters([*taken, *left])] == left and len(reader.tests) == 3
