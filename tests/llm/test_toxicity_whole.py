import random

from tessella.llm import toxicity


def test_words_after_the_first_twenty_thousand_characters(spark, make_docs):
    r = random.Random(2)
    plain = [f"plain{k}" for k in range(400)]
    rows, labels = [], []
    for k in range(90):
        words = r.choices(plain, k=4000)
        if k % 3 == 0:  # beyond character 20,000
            words[3000:3200] = r.choices(["vile", "nasty", "hateful", "awful"], k=200)
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(k % 3 == 0)))
    assert all("vile" not in t[:20_000] for _, t, _ in rows)
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.scores(docs, marks).collect()}
    assert sum((got[k] >= 0.5) == bool(y) for k, y in labels) >= 87


def test_ordinary_windows_come_from_all_texts(monkeypatch):
    texts = [" ".join(f"t{k}w{j}" for j in range(320)) for k in range(50)]
    assert toxicity.ordinary_windows(texts) == [w for t in texts for w in toxicity.windows(toxicity.words_of(t), 32)]
    monkeypatch.setattr(toxicity, "ORDINARY_WINDOWS", 100)
    got = toxicity.ordinary_windows(texts)
    assert len(got) == 100 and all(sum(f" t{k}w".encode() in w for w in got) == 2 for k in range(50))
    assert toxicity.ordinary_windows([]) == [] == toxicity.ordinary_windows([""])
