import itertools
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import mixing
from tests.llm.test_mixing import WORD, model_targets
from tests.llm.test_shingles import jaccard
from tests.llm.test_toxicity import text as toxic_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage made of its predecessor's result."""
    base = str(tmp_path_factory.mktemp("stages"))
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(("documents", docs))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append((name, docs))
    return {name: (df.columns, df.collect()) for name, df in out}


pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_columns(stages):
    want = stages["documents"][0]
    assert all(stages[n][0] == want for n in ("toxicity", "simhash", "suffix_dedup", "mixing"))


def test_toxicity(spark, stages):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, all_ids = {r.doc_id for r in stages["toxicity"][1]}, {r.doc_id for r in stages["documents"][1]}
    clean = {i for i, y in toxic.items() if not y}
    assert kept <= all_ids and len(clean - kept) <= 0.1 * len(clean)


def test_toxic_documents_leave(spark, make_docs, tmp_path):
    """With a hundred toxic labels and more to learn from; the stage above has nine."""
    r = random.Random(6)
    rows = [(i, toxic_text(r, i % 4 == 0), "s") for i in range(600)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = make_docs([*rows, (None, "plain text", "s"), (7000, None, "s"), (7001, "", None)])
    out = corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))
    kept = {x.doc_id for x in out.collect()}
    assert out.columns == docs.columns and {None, 7000, 7001} <= kept
    bad = {i for i, *_ in rows if i % 4 == 0}
    assert len(bad & kept) <= 0.03 * len(bad) and len({i for i, *_ in rows} - bad - kept) <= 0.02 * len(rows)


def test_simhash(stages):
    """Components of five-word shingle similarity of 0.8 or more, by comparing all pairs."""
    texts = {r.doc_id: r.text or "" for r in stages["toxicity"][1]}
    root, ids = {i: i for i in texts}, sorted(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in itertools.combinations(ids, 2):
        if jaccard(texts[x], texts[y]) >= 0.8:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    assert {r.doc_id for r in stages["simhash"][1]} == {find(i) for i in ids}


def without_earlier(texts, length=100):
    """The characters of which a byte at least stays, document by document."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        data = t.encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            if data[a : a + length] in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(data[a : a + length])
        at, kept = 0, []
        for c in t:
            n = len(c.encode())
            kept += [] if all(gone[at : at + n]) else [c]
            at += n
        out[i] = "".join(kept)
    return out


def test_suffix(stages):
    before, after = {r.doc_id: r.text for r in stages["simhash"][1]}, {r.doc_id: r for r in stages["suffix_dedup"][1]}
    want = without_earlier(before)
    assert {i: r.text for i, r in after.items()} == want and want != before
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_clashing_columns(spark):
    """Further columns keep their values, whatever their names."""
    extra = ["size", "taken", "_copy", "_key", "_row", "_id", "_kept", "_null", "fp", "rep", "bucket", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.count() and docs.where(" OR ".join(f"`{c}` <> concat('{c}', doc_id)" for c in extra)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_mixing(stages):
    before = stages["suffix_dedup"][1]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in stages["mixing"][1]:
        taken[r.source] += len(WORD.findall(r.text or ""))
    want = model_targets(dict(sizes), mixing.MAX_EPOCHS)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_packing(stages):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = Counter()
    for r in stages["mixing"][1]:
        texts[r.doc_id] += len(model.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for p in stages["packing"][1]:
        assert p.length == len(np.frombuffer(p.ids, "<u4"))
        got[p.doc_id] += p.length
    assert got == texts


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length, r.ids) for r in got.collect()) == sorted((r.doc_id, r.start, r.length, r.ids) for r in stages["packing"][1])
