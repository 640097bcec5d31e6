import hashlib
import re
from collections import Counter, defaultdict

import duckdb

from pyspark.sql import functions as F

from tessella.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def model_targets(sizes, cap=3):
    """The excess reshared round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: float(cap * sizes[s]) for s in over}


def rows_of(n=400):
    import random

    r = random.Random(3)
    out = [(i, " ".join("w%d" % r.randrange(50) for _ in range(r.randrange(0, 30))), r.choice(["hot"] * 6 + ["a", "b", "ç", "z", None])) for i in range(n)]
    return out + [(n, None, "a"), (n + 1, "", None), (n + 2, "tiny", "only"), (n + 3, "x\x85y z\x0bq", "b")]


def test_mix_against_model(make_docs):
    rows = rows_of()
    got = mixing.mix(make_docs(rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, src = model_targets(dict(sizes)), {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5001 for s in sizes)
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)
    assert sorted(got) == sorted(mixing.mix(make_docs(rows, 7)).collect())


def test_mix_sql(make_docs):
    docs = make_docs(rows_of())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(mixing.MIX_SQL).fetchall()
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_mix_edges(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix(make_docs([(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    same = make_docs([(1, "a b c", "s")] * 5 + [(2, "d", "t")]).withColumn("target", F.lit("x"))
    got = mixing.mix(same).collect()
    assert len(got) == 6 and sum(r.taken for r in got) == 16


def test_given_weights(make_docs):
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(200)]
    got = mixing.mix(make_docs(rows), weights={"a": 9, "b": 1}).collect()
    assert sum(r.taken for r in got if r.doc_id % 2) == 1800 and sum(r.taken for r in got) == 2000


def test_materialize(make_docs):
    rows = rows_of()
    docs = make_docs(rows)
    mixed = mixing.mix(docs)
    out = mixing.materialize(docs, mixed)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == {r.doc_id: r.taken for r in mixed.collect() if r.taken}


def model_shards(rows, shards):
    key = lambda i: hashlib.md5(f"{sharding.SEED}:{i}".encode()).hexdigest()
    by = defaultdict(list)
    for i, _, s in rows:
        by[(s is None, s or "")].append(i)
    order = sorted(((k + 0.5) / len(ids), s, k, i) for s, ids in by.items() for k, i in enumerate(sorted(ids, key=lambda i: (key(i), i))))
    out, counts = {}, Counter()
    for p, (*_, i) in enumerate(order):
        s = p * shards // len(order)
        out[i] = (s, counts[s])
        counts[s] += 1
    return out


def test_shards_against_model(make_docs):
    rows = rows_of()
    got = sharding.shard(make_docs(rows)).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == model_shards(rows, 40)
    import zlib

    text = {i: (t or "").encode() for i, t, _ in rows}
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 40
    hot = Counter(r.shard for r in got if rows[r.doc_id][2] == "hot")
    assert max(hot.values()) - min(hot.values()) <= 2


def test_shard_edges(make_docs):
    assert sharding.shard(make_docs([])).count() == 0
    got = sharding.shard(make_docs([(1, None, None)] * 3).withColumn("shard", F.lit("x"))).collect()
    assert len({r.shard for r in got}) == 3 and all(r.slot == 0 for r in got)
