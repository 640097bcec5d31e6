"""Toxicity by compression distance.

One zstandard dictionary is trained on ordinary text, another on what makes
toxic text toxic: the words of toxic documents that they, or whose beginnings,
toxic documents have significantly more often.  A window of twelve words is
compressed with the ordinary dictionary and with the toxic one laid before it
(so that what both find in the ordinary one costs the same); the bytes that
toxic words save mark it.  A logistic model of the windows' savings, fitted on
labelled documents that the dictionaries have not seen (fold by fold), is the
calibration that gives the score.

Two dictionaries trained on whole toxic and whole ordinary text, and compared
apart, did not tell the two from each other: a toxic document is ordinary text
but for a word in forty, and what two samples of ordinary text happen to hold
differs by more bytes than such a word saves.  The README has the figures.

The fit uses a bounded, hash-drawn sample of labelled rows (``SAMPLE``), each
with its whole text; every text is scored whole.  Near copies in the sample
count once in its word statistics, by a min-hash of their shingles.

Cases: a null or empty text has no windows and gets the score of no savings;
without labels of both kinds every score is the share of toxic labels (0 if
there are none); an id that has both labels counts as toxic, and of the texts
of a repeated id the least is learned from; a null id is not held out and
teaches nothing; repeated rows are scored each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices

#: Labelled rows of each kind that the fit draws.
SAMPLE = {1: 1500, 0: 4000}
WINDOW = 12
LEVEL = 12
ORDINARY_BYTES, TOXIC_BYTES = 131_072, 32_768
#: Windows that the ordinary dictionary is trained on.
ORDINARY_WINDOWS = 20_000
#: How many ordinary rows a toxic one counts for in the calibration: to miss one is worse than to take one.
TOXIC_WEIGHT = 3.0
#: Folds of the fit: dictionaries of the others give each fold's savings to the logistic model.
FOLDS = 3
#: Beginnings of words that are counted besides whole words.
PREFIXES = (5, 7, 9)
#: Evidence that a toxic word needs beyond chance.
MARGIN = 6.0
EDGES = b".,;:!?()[]\"'"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def windows(words: list[bytes], size: int = WINDOW):
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


def signature(words: list[bytes]) -> list[int]:
    """The four smallest hashes of a text's shingles; near copies share one at least, nearly always."""
    import xxhash

    return sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))})[:4]


def evidence(a: int, b: int, na: int, nb: int) -> float:
    """Log-likelihood ratio of a word in a of na against b of nb documents; 0 where it is not more frequent in the first."""
    if a * nb <= b * na:
        return 0.0
    share = (a + b) / (na + nb)
    return 2 * (a * math.log(a / (na * share)) + (b * math.log(b / (nb * share)) if b else 0.0))


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; the samples' distinct words where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(sorted({w for s in samples for w in s.split()}))[-size:] + b" "


class Savings:
    """Bytes that the toxic dictionary saves in each window."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int = LEVEL):
        import zstandard

        def compressor(content):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level)
            return zstandard.ZstdCompressor(level=level, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        self.plain, self.both = compressor(ordinary), compressor(toxic + ordinary)

    def __call__(self, text: str | None) -> list[float]:
        """Features of a document: mean, largest and three largest savings, the
        shares of windows that save 1 to 6 bytes at least and that lose some,
        the number of windows and of those that save 3."""
        parts = windows(words_of(text))
        if not parts:
            return [0.0] * 12
        saved = [len(self.plain(w)) - len(self.both(w)) for w in parts]
        n, top = len(saved), sorted(saved)[-3:]
        shares = [sum(s >= k for s in saved) / n for k in range(1, 7)]
        return [sum(saved) / n, float(max(saved)), sum(top) / len(top), *shares, sum(s < 0 for s in saved) / n, math.log1p(n), math.log1p(shares[2] * n)]


def logistic(x, y, ridge: float = 1.0, steps: int = 60, weight: float = 1.0):
    """Weights, the constant last, by Newton's method on scaled features; a row of label 1 counts ``weight`` times."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    keep, counts = np.append(np.full(x.shape[1], ridge), 1e-6), np.where(y > 0, weight, 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (counts * p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (counts * (y - p)) - keep * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return [*(w[:-1] / scale).tolist(), float(w[-1] - (w[:-1] * mean / scale).sum())]


def terms(word: bytes) -> list[bytes]:
    """What is counted for a word: itself and its beginnings."""
    return [word, *(word[:n] for n in PREFIXES if n < len(word))]


def plain_words(words: list[bytes]) -> set[bytes]:
    return {v for w in words if (v := w.strip(EDGES))}


def terms_of(text: str | None) -> set[bytes]:
    return {t for w in plain_words(words_of(text)) for t in terms(w)}


@functools.lru_cache(maxsize=None)  # of a bounded sample, and only while a model is fitted
def training_windows(text: str | None) -> tuple[bytes, ...]:
    return tuple(windows(words_of(text), 32))


def ordinary_windows(texts: list[str]) -> list[bytes]:
    """Training windows of 32 words, at most ``ORDINARY_WINDOWS``, spread evenly over all texts."""
    counts = [len(training_windows(t)) for t in texts]
    total, out, at = max(1, sum(counts)), [], 0
    take = min(sum(counts), ORDINARY_WINDOWS)
    for text, n in zip(texts, counts):
        first, last = -(-at * take // total), -(-(at + n) * take // total)  # the k-th is window k * total // take
        if first < last:
            parts = training_windows(text)
            out += [parts[k * total // take - at] for k in range(first, last)]
        at += n
    return out


def learn(docs) -> tuple[bytes, bytes]:
    """The two dictionaries from (text, signature, label) of documents.

    A term of at least three toxic documents is toxic if its log-likelihood
    ratio exceeds twice the logarithm of the number of such terms, at which by
    chance about one would pass, and a margin for near copies.
    """
    seen, own = set(), ([], [])
    for text, mark, y in docs:
        if mark and seen.isdisjoint(mark):
            own[y].append(text)
        seen.update(mark)
    known, other = Counter(), Counter()
    for text in own[1]:
        known.update(terms_of(text))
    known = {t: n for t, n in known.items() if n > 2}
    for text in own[0]:
        other.update(known.keys() & terms_of(text))
    least, n = 2 * math.log(max(2, len(known))) + MARGIN, (max(1, len(own[0])), len(own[1]))
    toxic = {t for t, a in known.items() if evidence(a, other[t], n[1], n[0]) >= least}
    found = [b" " + b" ".join(v for w in words_of(text) if (v := w.strip(EDGES)) and not toxic.isdisjoint(terms(v))) + b" " for text in own[1]]
    return dictionary(ordinary_windows(own[0]), ORDINARY_BYTES), dictionary([f for f in found if len(f) > 8], TOXIC_BYTES)


def fit(rows) -> dict:
    """A model from (text, label) pairs, in an order that has nothing to do with the labels."""
    docs = []
    for text, y in rows:
        words = words_of(text)
        docs.append((text, signature(words) if words else [], int(y)))
    share = sum(y for *_, y in docs) / len(docs) if docs else 0.0
    if not 0 < share < 1:
        return {"constant": share}
    x, labels = [], []
    for fold in range(FOLDS):
        savings = Savings(*learn([d for k, d in enumerate(docs) if k % FOLDS != fold]))
        x += [savings(t) for k, (t, *_) in enumerate(docs) if k % FOLDS == fold]
        labels += [y for k, (*_, y) in enumerate(docs) if k % FOLDS == fold]
    ordinary, taught = learn(docs)
    training_windows.cache_clear()
    return {"ordinary": ordinary, "toxic": taught, "weights": logistic(x, labels, weight=TOXIC_WEIGHT)}


def scorer(model: dict):
    """The score of a text under a fitted model."""
    if "constant" in model:
        return lambda _: model["constant"]
    savings, (*weights, base) = Savings(model["ordinary"], model["toxic"]), model["weights"]
    return lambda t: 1 / (1 + math.exp(-max(-30.0, min(30.0, base + sum(w * x for w, x in zip(weights, savings(t)))))))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list:
    """The bounded sample of labelled texts, in the order of a hash."""
    mine = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).where(F.col(id_col).isNotNull())
    mine = mine.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    drawn = [mine.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in SAMPLE.items()]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most the sample's size
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(drawn, "_id")
    texts = texts.groupBy("_id", "_y").agg(F.min("_text").alias("_text"))  # a row for each id
    got = texts.select(F.xxhash64("_id").alias("_h"), "_id", "_text", "_y").toArrow().to_pylist()
    return [(r["_text"], r["_y"]) for r in sorted(got, key=lambda r: (r["_h"], r["_id"], r["_text"] or ""))]


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score), a row for each input row."""
    import pyarrow as pa

    model = fit(sample(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        score = scorer(model)
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` without those whose score reaches ``threshold``, in one pass without a shuffle."""
    import pyarrow as pa

    model = fit(sample(docs, labels, id_col, text_col, label_col))
    at = docs.columns.index(text_col)

    def run(batches):
        score = scorer(model)
        for batch in slices(batches):
            yield batch.filter(pa.array([score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
