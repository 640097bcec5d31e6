"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; the hash is the axis, with its sign, that it then lies nearest to.
Two or more such hashes make a bucket of a table; the number of tables grows with
theirs and with the dimensions, so that pairs at the threshold are found with
probability 0.9999 at every size.  Besides its own ("home")
bucket a vector probes those in which one hash is replaced by its second
choice.  Pairs that meet in a bucket, one of them at home, are verified by
their cosine in double precision.

What meets are the ids of vectors with a sketch of 64 bits, the sides of random
planes on which a vector lies.  A vector goes on, with its components, to those
buckets only that hold another whose sketch is near enough; one in a million
pairs at the threshold at most is lost there.

Pairs never leave their bucket: a pair counts only in the first table, and
there in one bucket, in which it meets, so that each task adds up links by
vector and sends a spanning forest of them.  Equal vectors of a label are one
class with a count from the start.  A bucket with more than ``CHUNK`` vectors is
cut into chunks, and pairs of chunks are compared apart; as every link counts,
the comparisons in a group of n close vectors are n^2 / 2, by whatever way.

Cases: vectors that are null or zero, or hold null, NaN or infinite components,
and vectors without a label, link with nothing and are their own components;
vectors of different lengths don't link; each row is a vector of its own, so
that null and repeated ids link like others; a component's id is its smallest
id that is not null, null if it has none, and a row is kept if its id is that
(null-safe); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored
from tessella.llm.components import components
from tessella.llm.simhash import bounded_groups, grouped

THRESHOLD = 0.93
#: Tables at least; as many more as keep the share of pairs found at the threshold.
TABLES = 10
RECALL = 0.9999
SEED = 90210
#: Vectors of a bucket that are compared in one place; above it the bucket is cut.
CHUNK = 4096
#: The share of pairs at the threshold that the sketches may lose.
SKETCH_LOSS = 1e-6


def hashes_for(n: int, axes: int) -> int:
    """Hashes in a bucket key: as many as keep chance meetings a few for each vector."""
    k = 2
    while n > 16 * axes**k:
        k += 1
    return k


def tables_for(k: int, width: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Tables in one of which a pair at the threshold meets with probability ``recall``.

    The chances that one hash is equal, and that it is another's second choice,
    are counted over random pairs and taken two standard errors low.
    """
    import numpy as np

    if threshold >= 1:
        return 1
    r, pairs, step = np.random.default_rng(SEED), 1 << 14, max(1, (1 << 21) // width)
    equal = second = 0
    for at in range(0, pairs, step):
        x, y = r.standard_normal((2, min(step, pairs - at), width))
        found = []
        for z in (x, threshold * x + np.sqrt(1 - threshold**2) * y):
            size, rows = np.abs(z), np.arange(len(z))
            for _ in range(2):
                best = size.argmax(axis=1)
                size[rows, best] = -1
                found.append(2 * best + (z[rows, best] < 0))
        a, a2, b, b2 = found
        equal += int((a == b).sum())
        second += int(((a != b) & ((a == b2) | (a2 == b))).sum())
    low = lambda n: max(1.0, n - 2 * np.sqrt(n * (1 - n / pairs))) / pairs
    p = low(equal) ** k + k * low(equal) ** (k - 1) * low(second)
    return int(np.ceil(np.log(1 - recall) / np.log1p(-p)))


def hadamard(x):
    """The transform of each row, in log2 of its length steps."""
    import numpy as np

    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def digits(x, tables: int, k: int, seed: int = SEED):
    """(n, tables, k, 2): the first and second choice of each hash of unit vectors."""
    import numpy as np

    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.hstack([x, np.zeros((n, width - d))]).astype(np.float32)
    rows, signs = np.arange(n), np.random.default_rng(seed)
    out = np.empty((n, tables, k, 2), np.uint8 if 2 * width <= 256 else np.uint16 if 2 * width <= 65_536 else np.uint32)
    for t in range(tables):
        for j in range(k):
            y = x
            for _ in range(3):
                y = hadamard(y * signs.choice(np.array([-1, 1], np.float32), width))
            size = np.abs(y)
            for choice in range(2):
                best = size.argmax(axis=1)
                size[rows, best] = -1
                out[:, t, j, choice] = 2 * best + (y[rows, best] < 0)
    return out


def keys_of(own, width: int):
    """(home, probes): the bucket keys that digits make, (n, tables) and (n, tables, k) integers."""
    import numpy as np

    scale = np.array([pow(2 * width, j, 1 << 62) for j in range(own.shape[2])], np.int64)
    first, second = own[..., 0].astype(np.int64), own[..., 1].astype(np.int64)
    home = (first * scale).sum(axis=2)
    return home, home[:, :, None] + (second - first) * scale


def signatures(x, tables: int, k: int, seed: int = SEED):
    """The bucket keys of unit vectors."""
    return keys_of(digits(x, tables, k, seed), 1 << max(1, (x.shape[1] - 1).bit_length()))


def mixed(x):
    import numpy as np

    with np.errstate(over="ignore"):
        x = np.asarray(x, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def bucket_ids(label_hash, d, t, key):
    """Buckets of all labels, lengths and tables as one kind of 64-bit ids, that may collide."""
    return mixed(mixed(key) ^ mixed(d * 65_536 + t) ^ label_hash)


def sketch(x, seed: int = SEED):
    """64 sides of random planes for each row."""
    import numpy as np

    planes = np.random.default_rng(seed + 1).standard_normal((x.shape[1], 64))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)[:, 0]


def sketch_distance(threshold: float, loss: float = SKETCH_LOSS) -> int:
    """The differing bits that pairs at the threshold exceed with probability ``loss`` at most."""
    import math

    p, above, h = math.acos(max(-1.0, min(1.0, threshold))) / math.pi, 1.0, -1
    while above > loss and h < 64:
        h += 1
        above -= math.comb(64, h) * p**h * (1 - p) ** (64 - h)
    return h


def meets(a, b, home, probes, t):
    """Whether the pairs (a, b) meet in table ``t``, and the key they count under."""
    import numpy as np

    at_a = (home[a, t] == home[b, t]) | (probes[b, t] == home[a, t][:, None]).any(axis=1)
    at_b = (probes[a, t] == home[b, t][:, None]).any(axis=1)
    return at_a | at_b, np.where(at_a, home[a, t], home[b, t])


def has_partner(bucket, own, bits, most: int):
    """Rows, sorted by bucket, that are near another of their bucket, one of the two at home."""
    import numpy as np

    out, at, step, bits = np.zeros(len(bucket), bool), np.arange(len(bucket) - 1), 1, bits.view(np.uint64)
    while len(at):
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        near = at[(own[at] | own[at + step]) & (np.bitwise_count(bits[at] ^ bits[at + step]) <= most)]
        out[near] = out[near + step] = True
        step += 1
    return out


def bucket_links(unit, order, own_home, home, probes, t: int, counted, chunk, across: bool, threshold: float):
    """Pairs (i, j), order[i] < order[j], that link and count in this bucket:
    ``counted`` says which of pairs that meet here under given keys do."""
    import numpy as np

    out = ([], [])
    for at in range(0, len(unit), 512):
        near = unit[at : at + 512] @ unit.T >= threshold
        i, j = np.nonzero(near)
        i += at
        keep = (order[i] < order[j]) & (own_home[i] | own_home[j])
        if across:
            keep &= chunk[i] != chunk[j]
        i, j = i[keep], j[keep]
        for s in range(t):
            if len(i):
                earlier = ~meets(i, j, home, probes, s)[0]
                i, j = i[earlier], j[earlier]
        if len(i):
            _, under = meets(i, j, home, probes, t)
            here = counted(i, j, under)
            i, j = i[here], j[here]
        out[0].append(i)
        out[1].append(j)
    return np.concatenate(out[0]), np.concatenate(out[1])


def forest(n: int, i, j):
    """The smallest index that each of ``n`` is joined to by the pairs."""
    import numpy as np

    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (before == label).all():
            return label


def normalized(raw):
    """Rows of length 1, in double precision."""
    import numpy as np

    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(vector: str) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each input row."""
    import pyarrow as pa

    element = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(valid("v") & F.col("label").isNotNull(), F.lit(False)))
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    total, longest = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = 1 << max(1, ((longest or 1) - 1).bit_length())
    k = hashes_for(total, 2 * width)
    tables = max(tables, tables_for(k, width, threshold)) if total else tables
    near_bits = sketch_distance(threshold)

    def sign(batches):
        import numpy as np

        for whole in batches:
            for first in range(0, whole.num_rows, 2048):
                batch = whole.slice(first, 2048)
                lists = batch.column("v")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                for d in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == d)
                    raw = flat[starts[at][:, None] + np.arange(d)]
                    unit = normalized(raw)
                    own = digits(unit, tables, k)
                    home, probes = keys_of(own, 1 << max(1, (d - 1).bit_length()))
                    part = batch.take(pa.array(at)).select(["rep", "n", "label", "hash"])
                    hashes = part.column("hash").to_numpy()[:, None, None]
                    keys = bucket_ids(hashes, d, np.arange(tables)[None, :, None], np.concatenate([home[:, :, None], probes], axis=2)).reshape(len(at), -1)
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                    blobs = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (raw, own)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), d, np.int32)), pa.array(sketch(unit)), keys, *blobs], ["rep", "n", "label", "hash", "d", "bits", "keys", "raw", "own"])

    kind = classes.schema["label"].dataType.simpleString()
    signed = classes.select("rep", "n", "label", F.xxhash64("label").alias("hash"), "v")
    signed = stored(signed.mapInArrow(sign, f"rep long, n long, label {kind}, hash long, d int, bits long, keys array<long>, raw binary, own binary"), "signed")
    entries = signed.select("rep", "bits", F.posexplode("keys").alias("at", "bucket"))
    entries = entries.select("bucket", F.expr(f"cast(at div {k + 1} as int)").alias("t"), (F.col("at") % (k + 1) == 0).alias("home"), "bits", "rep")

    def meet(batches):
        for part, hot in bounded_groups(batches, 1, CHUNK):
            bucket, home, bits = (part.column(c).to_numpy() for c in ("bucket", "home", "bits"))
            if not hot:
                part = part.filter(pa.array(has_partner(bucket, home, bits, near_bits)))
            if len(part):
                for batch in part.select(["bucket", "t", "home", "rep"]).append_column("hot", pa.array([hot] * len(part), pa.bool_())).to_batches():
                    yield batch

    dealt = entries.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    met = stored(dealt.mapInArrow(meet, "bucket long, t int, home boolean, rep long, hot boolean"), "met")
    hot = met.where("hot")
    sizes = hot.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    cut = hot.join(sizes, "bucket").withColumn("chunk", F.expr("cast(pmod(xxhash64(rep), chunks) as int)"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.select("bucket", "t", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "home", "rep")
    zero = F.lit(0).cast("int")
    met = met.where("not hot").select("bucket", "t", zero.alias("lo"), zero.alias("hi"), zero.alias("chunk"), "home", "rep").unionByName(cut)
    met = met.join(signed.select("rep", "n", "label", "hash", "d", "raw", "own"), "rep")
    keys = ["bucket", "t", "d", "lo", "hi"]
    met = met.select(*keys, "chunk", "home", "rep", "n", "label", "hash", "raw", "own")
    met = met.repartition(F.col("bucket"), F.col("lo"), F.col("hi")).sortWithinPartitions("bucket", "lo", "hi", "t", "d", "rep")

    def verify(batches):
        import numpy as np

        for part in grouped(batches, 5):
            bucket, t, d, lo, hi = (part.column(c).to_numpy() for c in keys)
            rep, n, at_home, chunk, label_hash = (part.column(c).to_numpy() for c in ("rep", "n", "home", "chunk", "hash"))
            label = part.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in (bucket, t, d, lo, hi)])) + 1).tolist(), len(d)]
            raw, digit = part.column("raw").to_pylist(), part.column("own").to_pylist()
            counts, links = ([], []), ([], [])
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a < 2:
                    continue
                unit = normalized(np.frombuffer(b"".join(raw[a:b]), np.float32 if element == "float" else np.float64).reshape(b - a, -1))
                width = 1 << max(1, (int(d[a]) - 1).bit_length())
                own = np.frombuffer(b"".join(digit[a:b]), np.uint8 if 2 * width <= 256 else np.uint16 if 2 * width <= 65_536 else np.uint32).reshape(b - a, tables, k, 2)
                home, probes = keys_of(own, width)
                here, whose, of_label = int(bucket[a]), label_hash[a:b], label[a:b]
                counted = lambda i, j, under: (of_label[i] == of_label[j]) & (bucket_ids(whose[i], int(d[a]), int(t[a]), under) == here)  # noqa: B023, E731
                i, j = bucket_links(unit, rep[a:b], at_home[a:b], home, probes, int(t[a]), counted, chunk[a:b], lo[a] != hi[a], threshold)
                if not len(i):
                    continue
                found = np.zeros(b - a, np.int64)
                np.add.at(found, i, n[a:b][j])
                np.add.at(found, j, n[a:b][i])
                hit = np.flatnonzero(found)
                counts[0].append(rep[a:b][hit])
                counts[1].append(found[hit])
                least = forest(b - a, i, j)
                moved = np.flatnonzero(least != np.arange(b - a))
                links[0].append(rep[a:b][moved])
                links[1].append(rep[a:b][least[moved]])
            if counts[0]:
                who, many = np.concatenate(counts[0]), np.concatenate(counts[1])
                yield pa.record_batch([pa.array(who), pa.array(many), pa.nulls(len(who), pa.int64())], ["rep", "found", "joined"])
                who, to = np.concatenate(links[0]), np.concatenate(links[1])
                yield pa.record_batch([pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(to)], ["rep", "found", "joined"])

    linked = stored(met.mapInArrow(verify, "rep long, found long, joined long"), "linked")
    roots = stored(components(linked.where("joined is not null"), "rep", "joined").withColumnRenamed("node", "rep"), "roots", total)
    counted = linked.where("found is not null").groupBy("rep").agg(F.sum("found").alias("found"))
    about = classes.join(counted, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    about = stored(about.select("label", "v", "root", "least", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links")), "about")
    # only components of several classes need the smallest id of all their classes
    firsts = about.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("first"))
    about = about.join(firsts, "root", "left").select("label", "v", "n_links", F.coalesce("first", "least").alias("component_id"))
    known = rows.where("ok").join(about, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


LINKS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON id = vec_id LEFT JOIN n ON a = vec_id
"""
