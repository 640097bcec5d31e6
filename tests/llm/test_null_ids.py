import hashlib

from tessella.llm import suffix, warc


def test_suffix(make_docs):
    passage = " ".join(f"word{k}" for k in range(40))
    rows = [(None, passage, "s"), (1, passage, "s"), (2, passage, "s"), (None, "x" + passage, "s"), (None, None, "s"), (None, passage, "s")]
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.digests(suffix.repeated(make_docs(rows))).collect()))
    n, sha = len(passage), lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(0, n, 0, sha(passage)), (1, n, 0, sha(passage)), (2, n, n, sha("")), (0, n + 1, 0, sha("x" + passage)), (0, 0, 0, sha("")), (0, n, 0, sha(passage))])


def test_warc(spark):
    rows = [(None, "u", "<p>one</p>"), (None, None, "<p>alone</p>"), (3, "u", "<p>one</p>"), (2, "u", "<p>one</p>"), (None, "u", None), (None, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_digest is not None) for r in warc.round_trip(pages).collect())
    assert got == sorted([(0, "revisit", 2, True), (0, "response", 0, True), (3, "revisit", 2, True), (2, "response", 0, True), (0, "response", 0, True), (0, "response", 0, True)])
