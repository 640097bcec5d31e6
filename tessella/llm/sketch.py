"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch is the k smallest distinct hashes of a text's shingles of five words
(ASCII letters in lower case).  Sketches of parts merge into that of the whole,
and estimate the resemblance and containment of two sets and their distinct
counts.  With at most k distinct shingles in a set the estimates are exact.

Cases: a null or empty text, or one of white space, has the empty sketch, which
resembles the empty sketch wholly and any other not at all; fewer words than a
shingle holds make one shingle; repeated rows have a row each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices
from tessella.llm.suffix import Rolling

K = 128
WORDS = 5
#: Keys whose sketches a task merges at once.
MERGE_KEYS = 4096


class Sketcher:
    def __init__(self, k: int = K, words: int = WORDS):
        import numpy as np

        self.np, self.k, self.words, self.rolling = np, k, words, Rolling()
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.weights = np.random.default_rng(77).integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, text: str):
        """The hash of each shingle, in order; repeats included."""
        np, out = self.np, []
        data = np.frombuffer(text.encode().lower(), np.uint8)
        if not len(data):
            return np.empty(0, np.uint64)
        held = np.concatenate([[False], ~self.space[data], [False]])
        starts, stops = np.flatnonzero(held[1:] & ~held[:-1]), np.flatnonzero(held[:-1] & ~held[1:])
        if not len(starts):
            return np.empty(0, np.uint64)
        step = 1 << 20  # bytes whose sums are held at once
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data) + step, step)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            base = starts[a]
            sums = self.rolling.sums(data[base : stops[b - 1]])
            out.append(self.rolling.mixed(self.rolling.between(sums, starts[a:b] - base, stops[a:b] - base)))
        own = np.concatenate(out)
        n = max(1, len(own) - self.words + 1)
        total = np.zeros(n, np.uint64)
        for j in range(min(self.words, len(own))):
            total += own[j : j + n] * self.weights[j]
        return self.rolling.mixed(total)

    def __call__(self, text: str | None):
        np, k = self.np, self.k
        h = self.hashes(text or "")
        if len(h) > 4 * k:
            some = np.unique(np.partition(h, 2 * k)[: 2 * k])
            if len(some) >= k:
                return some[:k]
        return np.unique(h)[:k]


def merge(sketches, k: int = K):
    """The sketch of the union."""
    import numpy as np

    return np.unique(np.concatenate([*sketches, np.empty(0, np.uint64)]))[:k]


def resemblance(a, b, k: int = K) -> float:
    """Shared shingles over all: the share of the union's sketch that both have."""
    import numpy as np

    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge([a, b], k)
    return len(np.intersect1d(np.intersect1d(union, a, True), b, True)) / len(union)


def distinct(a, k: int = K) -> float:
    """The number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[k - 1]) + 1)


def containment(a, b, k: int = K) -> float:
    """The share of the first set that the second has: of the first sketch's
    values up to where the second sketch ends, those that it holds."""
    import numpy as np

    own = a if len(b) < k else a[a <= b[-1]]
    return float(np.isin(own, b).mean()) if len(own) else float(not len(a))


def text_of(sketch) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def of_text(text: str):
    import numpy as np

    return np.frombuffer(base64.b64decode(text), "<u8")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, n_shingles), a row for each input row, in one pass."""
    import pyarrow as pa

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        make = Sketcher(k, words)
        for batch in slices(batches):
            made = [make(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([text_of(s) for s in made], pa.string()), pa.array([distinct(s, k) for s in made])], ["doc_id", "fingerprint", "n_shingles"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string, n_shingles double")


def merged(made: DataFrame, key: str, k: int = K, keys: int = MERGE_KEYS) -> DataFrame:
    """(key, fingerprint, n_shingles) of the union of each key's sketches; a null key is a key too.

    Each task first merges what it reads, ``keys`` keys at a time, so that
    a hot key sends few sketches; these meet sorted by key and are merged one
    after another, so that no group is held.
    """
    import pyarrow as pa

    kind = made.schema[key].dataType.simpleString()

    def partial(batches):
        held, id_type = {}, None

        def flushed():
            return pa.record_batch([pa.array([*held], id_type), pa.array([text_of(merge(x, k)) for x in held.values()], pa.string())], [key, "fingerprint"])

        for batch in batches:
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(name, []).append(of_text(text))
                if len(held[name]) > 64:
                    held[name] = [merge(held[name], k)]
                if len(held) >= keys:
                    yield flushed()
                    held.clear()
        if held:
            yield flushed()

    def final(batches):
        last, total = None, None
        for batch in batches:
            out, id_type = [], batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = of_text(text)
                if total is not None and name == last:
                    total = merge([total, own], k)
                    continue
                if total is not None:
                    out.append((last, text_of(total), distinct(total, k)))
                last, total = name, own
            columns = [*zip(*out)] or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (id_type, pa.string(), pa.float64()))], [key, "fingerprint", "n_shingles"])
        if total is not None:
            yield pa.record_batch([pa.array([last], id_type), pa.array([text_of(total)]), pa.array([distinct(total, k)])], [key, "fingerprint", "n_shingles"])

    parts = made.select(key, "fingerprint").mapInArrow(partial, f"{key} {kind}, fingerprint string")
    return parts.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(final, f"{key} {kind}, fingerprint string, n_shingles double")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def in_chunks(docs: DataFrame, parts: int) -> DataFrame:
    """(_part, _extra, doc_id, text): rows in ``parts`` ranges of falling id, each
    followed by the row that comes next in all (the first, after the last).

    The ranges come from quantiles of the ids, the first id of each range from
    one aggregation; both have ``parts`` values at most.  A null id comes last.
    """
    probs = [i / parts for i in range(1, parts)]
    known = docs.where("doc_id is not null")
    splits = sorted({int(x) for x in known.approxQuantile("doc_id", probs, 0.1 / parts)}, reverse=True) if probs else []
    size = max(1, round(len(splits) ** 0.5))  # found in two steps of about the root each
    blocks = [splits[i : i + size] for i in range(0, len(splits), size)]
    if splits:
        heads, inner = F.array(*[F.lit(b[-1]) for b in blocks]), F.array(*[F.array(*map(F.lit, b)) for b in blocks])
        block = F.size(F.filter(heads, lambda x: F.col("doc_id").isNull() | (x > F.col("doc_id"))))
        own = F.size(F.filter(F.get(inner, F.col("_block")), lambda x: x > F.col("doc_id")))
        docs = docs.withColumn("_block", block).withColumn("_part", F.when(F.col("_block") < len(blocks), F.col("_block") * size + own).otherwise(len(splits)).cast("int"))
    else:
        docs = docs.withColumn("_part", F.lit(0))
    firsts = {r._part: r.first for r in docs.groupBy("_part").agg(F.max("doc_id").alias("first")).collect()}
    used = sorted(firsts)
    ahead = {p: used[(i - 1) % len(used)] for i, p in enumerate(used)}
    first_of = F.create_map(*[F.lit(x).cast(t) for p in used for x, t in ((p, "int"), (firsts[p], "long"))]) if used else None
    to = F.create_map(*[F.lit(x) for p in used for x in (p, ahead[p])]) if used else None
    if not used:
        return docs.select("_part", F.lit(False).alias("_extra"), "doc_id", "text")
    extra = docs.where(F.col("doc_id").eqNullSafe(first_of[F.col("_part")])).withColumn("_part", to[F.col("_part")])
    both = docs.withColumn("_extra", F.lit(False)).unionByName(extra.withColumn("_extra", F.lit(True)))
    return both.select("_part", "_extra", "doc_id", "text").repartitionById(max(used) + 1, F.col("_part")).sortWithinPartitions("_part", "_extra", F.desc("doc_id"), "text")


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The next document is that of the next smaller id; after the smallest comes
    the largest.  Texts are shuffled once, by ranges of the id.
    """
    import pyarrow as pa

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = in_chunks(docs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        make, out, last = Sketcher(k, words), [], None

        def made():
            return pa.record_batch([pa.array(c, t) for c, t in zip([*zip(*out)] or [()] * len(kinds), kinds)], names)

        for batch in slices(batches):
            for extra, doc, text in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                own = make(text)
                if last is not None:
                    prior, old, sketch = last
                    new = edited(old, text)
                    other = make(new)
                    out.append((prior, len(old), hashlib.sha256(new.encode()).hexdigest(), text_of(sketch), text_of(other), resemblance(sketch, other, k), resemblance(sketch, own, k)))
                    if len(out) >= 2000:
                        yield made()
                        out.clear()
                last = None if extra else (doc, text, own)
                if extra:
                    break
        yield made()

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
