"""Near-duplicates by shingle similarity: SimHash proposes, whole shingle sets decide.

A text's shingles are its runs of five words.  Their SimHash is made as long as
is needed: each of a number of tables takes bits of its own as a key, and texts
that share a key meet in a bucket.  Bits of texts with a Jaccard similarity of
0.8 differ with probability 0.15, so that with ``tables_for`` such texts miss
each other in all tables with probability 3e-5, less above.  In a bucket the
first 192 bits are compared.  What is joined by near fingerprints of any bucket
is a group, in which the similarity of whole shingle sets is computed.

Texts with the same shingles are one vertex from the start, and a group gives a
spanning forest of its links.  A group with very many members is cut into chunks, each of which is
held against the group's first member.  What is like it is joined by that;
only the rest is compared with all chunks, block by block.  Fingerprints of a
bucket with very many members are compared by pairs of its parts.

Cases: texts without words (null, empty, white space only) are copies of each
other; fewer words than a shingle holds make one shingle; rows may repeat, and
ids may be null or repeated; an empty table gives an empty result; further
columns are kept.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import keyed, partitions_for, slices, stored, unused
from tessella.llm.components import components
from tessella.llm.simhash import bounded_groups, grouped, majority

WORDS = 5
SIMILARITY = 0.8
SEED = 42
#: The probability that two texts at the threshold share no table's key; as much again that their first bits are not near.
MISSED = 3e-5
#: Comparisons of two fingerprints that cost as much as a row of a table.
COMPARISONS = 1000
#: Bits of a fingerprint that are compared in a bucket.
NEAR_BITS = 192
#: Members of a group that are searched in one place; above it the group is cut.
CHUNK = 512
#: Fingerprints of a bucket that are compared in one place; above it the bucket is cut.
BUCKET = 1 << 15


def shingles(text: str | None, words: int = WORDS):
    """The sorted, distinct hashes of a text's shingles."""
    import numpy as np
    import xxhash

    own = text.encode().lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    line, ends = b" ".join(own), [*itertools.accumulate(map(len, own), lambda a, n: a + n + 1)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:e], SEED) for a, e in zip(starts, ends[words - 1 :] or ends[-1:])], np.uint64))


def differing(similarity: float) -> float:
    """The probability that a bit of two texts' fingerprints differs, at most: sets
    of the same size have the widest angle."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tables_for(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(bits of a key, tables): what costs least for ``n`` texts, where rows and
    chance meetings count.  Recall is the same for every ``n``."""
    best, same = None, 1 - differing(similarity)
    for bits in range(4, 31):
        tables = math.ceil(math.log(MISSED) / math.log1p(-min(same**bits, 1 - MISSED)))
        cost = tables * (1 + n / 2**bits / 2 / COMPARISONS)
        if best is None or cost < best[0]:
            best = (cost, bits, tables)
    return best[1:]


def distance_for(similarity: float = SIMILARITY) -> int:
    """The bits of ``NEAR_BITS`` in which similar texts differ at most, but with probability ``MISSED``."""
    p, rest = differing(similarity), 1.0
    for d in range(NEAR_BITS + 1):
        rest -= math.comb(NEAR_BITS, d) * p**d * (1 - p) ** (NEAR_BITS - d)
        if rest <= MISSED:
            return d


def fingerprint(own, bits: int, tables: int):
    """The bits of the SimHash of a set of hashes, as many as the tables and comparisons take."""
    return majority(own, -(-max(NEAR_BITS, bits * tables) // 64))


def table_keys(print_, bits: int, tables: int):
    """The key of each table, of a fingerprint's bits."""
    import numpy as np

    return print_[: bits * tables].reshape(tables, bits) @ (1 << np.arange(bits))


def band_keys(own, bits: int = 10, tables: int = 49):
    """The key of each table, of a set of hashes; by default the tables of about a million texts."""
    return table_keys(fingerprint(own, bits, tables), bits, tables)


def joined(near, label, distance: int):
    """For each fingerprint (a row of words) the first of those that equal labels
    and links of at most ``distance`` bits join it to."""
    import numpy as np

    def apart(x, y):
        return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.uint8)

    same = np.unique(label, return_index=True, return_inverse=True)
    first = same[1][same[2]]
    pairs, many = [np.stack([first, np.arange(len(near))])[:, first < np.arange(len(near))]], 16 * len(near)
    for at in range(0, len(near) - 1, 64):
        x, y = near[at : at + 64, None], near[None, at:]
        some = np.bitwise_count(x[..., 0] ^ y[..., 0]) + np.bitwise_count(x[..., 1] ^ y[..., 1])
        i, j = np.nonzero(some <= distance)
        i, j = (k[j > i] + at for k in (i, j))
        hit = apart(near[i], near[j]) <= distance
        many -= np.count_nonzero(hit)
        if many < 0:  # a dense bucket: what is reached is removed
            left = np.arange(len(near))
            while len(left) > 1:
                todo, left = [left[0]], left[1:]
                while todo and len(left):
                    x = todo.pop()
                    hit = apart(near[x], near[left]) <= distance
                    pairs.append(np.stack([np.full(hit.sum(), x), left[hit]]))
                    todo.extend(left[hit])
                    left = left[~hit]
            break
        hit &= label[i] != label[j]
        pairs.append(np.stack([i[hit], j[hit]]))
    root = list(range(len(near)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in np.concatenate(pairs, axis=1).T.tolist():
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in root])


def met(rows: DataFrame, keys: list[str], distance: int, most: int | None = None) -> DataFrame:
    """(a, b, bucket, f0, ...): links that join all labels that near fingerprints
    join among the rows (*keys, rep, f0, ...) that share the keys; ``rep`` is the
    label.  Without b the rows of buckets of more than ``most``."""
    import pyarrow as pa

    words = [f"f{k}" for k in range(NEAR_BITS // 64)]
    names = ["a", "b", "bucket", *words]

    def run(batches):
        import numpy as np

        n = len(keys)
        for part, hot in bounded_groups(batches, n, most) if most else ((g, False) for g in grouped(batches, n)):
            columns = [part.column(c).to_numpy() for c in range(part.num_columns)]
            rep, near = columns[n], np.stack(columns[n + 1 :], axis=1).view(np.uint64)
            if hot:
                yield pa.record_batch([pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(columns[0]), *map(pa.array, columns[n + 1 :])], names)
                continue
            edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:n]])) + 1
            first = np.arange(len(rep))
            for a, b in itertools.pairwise([0, *edges.tolist(), len(rep)]):
                if b - a > 1:
                    first[a:b] = a + joined(near[a:b], rep[a:b], distance)
            pairs = np.stack([rep[first], rep], axis=1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            if len(pairs):
                yield pa.record_batch([*map(pa.array, np.ascontiguousarray(pairs.T)), *[pa.nulls(len(pairs), pa.int64())] * (1 + len(words))], names)

    return rows.select(*keys, "rep", *words).sortWithinPartitions(*keys, "rep").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def compared(rows: DataFrame, parts: int, distance: int) -> DataFrame:
    """(a, b): links that join all labels that near fingerprints join in a bucket, of rows (bucket, rep, f0, ...)."""
    found = stored(met(rows.repartition(parts, "bucket"), ["bucket"], distance, BUCKET), "near")
    out, hot = found.where("b is not null").select("a", "b"), found.where("b is null").withColumnRenamed("a", "rep").drop("b")
    if not hot.head(1):
        return out
    sizes = hot.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / (BUCKET / 2)).cast("long").alias("parts"))
    dealt = hot.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64(*hot.columns), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part != other")
    dealt = dealt.withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other")})
    return out.unionByName(stored(met(dealt.repartition("bucket", "one", "two"), ["bucket", "one", "two"], distance), "near").select("a", "b"))


def proposed(classes: DataFrame, total: int, tables: int, similarity: float) -> DataFrame:
    """(t, key, rep): the classes (rep, near, keys) that fingerprints join which
    share a table's key and are near, by groups of the first two.  Those that
    the first table joins have one label in the others, which link labels only."""
    distance, spark = distance_for(similarity), classes.sparkSession

    def rows(classes, which):
        each = classes.select("rep", *[F.col("near")[k].alias(f"f{k}") for k in range(NEAR_BITS // 64)], F.posexplode("keys").alias("t", "key")).where(which)
        return each.withColumn("bucket", F.col("t") * F.lit(1 << 32) + F.col("key"))

    edges = compared(rows(classes, "t = 0"), partitions_for(spark, 48 * total), distance)
    labels = stored(components(edges, "a", "b"), "labels").withColumnRenamed("node", "rep").hint("merge")  # grows with the input
    labelled = classes.join(labels, "rep", "left").withColumn("rep", F.coalesce("root", "rep"))
    edges = edges.unionByName(compared(rows(labelled, "t > 0"), partitions_for(spark, 48 * total * tables), distance))
    return components(edges, "a", "b").select(F.lit(0).cast("long").alias("t"), F.col("root").alias("key"), F.col("node").alias("rep"))


def similar(own, sets, sizes, among, similarity: float):
    """Which of ``among`` (indices of ``sets``) are similar to the set ``own``."""
    import numpy as np

    near = among[(sizes[among] >= similarity * len(own) - 1e-9) & (len(own) >= similarity * sizes[among] - 1e-9)]
    if not len(near):
        return near
    if not len(own):
        return near
    flat = np.concatenate([sets[y] for y in near])
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    shared = np.add.reduceat(hit, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
    return near[shared >= similarity * (len(own) + sizes[near] - shared) - 1e-9]


def reach(sets, similarity: float = SIMILARITY):
    """Links (i, j) between sets that connect all that are connected."""
    import numpy as np

    sizes, left, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = similar(sets[x], sets, sizes, left, similarity)
            out += [(x, y) for y in near]
            todo.extend(near)
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def star(sets, similarity: float):
    """Which sets are similar to the first."""
    import numpy as np

    sizes, out = np.array([len(s) for s in sets]), np.zeros(len(sets), bool)
    out[similar(sets[0], sets, sizes, np.arange(len(sets)), similarity)] = True
    return out


def searched(rows: DataFrame, similarity: float, how: str) -> DataFrame:
    """(a, b, t, key) of rows (t, key, chunk, block, role, rep, own), by groups of the first four.

    ``all``: links that connect all that are connected.  ``star``: links to the
    member of role 0, and without b those that have none.  ``rest``: links
    of those of role 0 to the others: to one of role 1, which are all
    connected, and to all of role 2.
    """
    import pyarrow as pa

    keys = ["t", "key", "chunk", "block"]
    rows = rows.select(*keys, "role", "rep", "own").repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, "role", "rep")

    def run(batches):
        import numpy as np

        for part in grouped(batches, 4):
            t, key, chunk, block, role, rep = (part.column(c).to_numpy() for c in range(6))
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in (t, key, chunk, block)])) + 1
            blobs, found = part.column("own").to_pylist(), {}
            for a, b in itertools.pairwise([0, *new.tolist(), len(t)]):
                sets, who = [np.frombuffer(s, np.uint64) for s in blobs[a:b]], rep[a:b].tolist()
                if how == "all":
                    found.update(((who[i], who[j]), None) for i, j in reach(sets, similarity))
                elif how == "star":
                    for k, near in enumerate(star(sets, similarity).tolist()):
                        if k:
                            found[(who[0], who[k]) if near else (who[k], None, int(t[a]), int(key[a]))] = None
                else:
                    sizes, kind = np.array([len(s) for s in sets]), role[a:b]
                    others = np.flatnonzero(kind > 0)
                    for k in np.flatnonzero(kind == 0).tolist():
                        near = similar(sets[k], sets, sizes, others, similarity)
                        for j in [*near[kind[near] == 1][:1].tolist(), *near[kind[near] == 2].tolist()]:
                            found[who[k], who[j]] = None
            if found:
                columns = zip(*[(*f, None, None)[:4] if len(f) == 2 else f for f in found])
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "b", "t", "key"])

    return rows.mapInArrow(run, "a long, b long, t long, key long")


def links(entries: DataFrame, rows: DataFrame, row: str, text_col: str, similarity: float) -> DataFrame:
    """(a, b): links between the classes of entries (t, key, rep) that join all that are joined in a group."""
    import pyarrow as pa

    buckets = entries.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    buckets = stored(buckets.select("t", "key", "pivot", F.ceil(F.col("size") / CHUNK).cast("long").alias("chunks")), "buckets")
    met = entries.join(buckets, ["t", "key"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    met = stored(met.select("t", "key", "chunks", "chunk", "rep"), "met")

    def hashed(batches):
        for batch in slices(batches):
            yield pa.record_batch([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["rep", "own"])

    members = rows.join(met.select(F.col("rep").alias(row)).distinct().hint("merge"), row, "left_semi")  # grows with the input
    sets = stored(members.select(F.col(row).alias("rep"), text_col).mapInArrow(hashed, "rep long, own binary"), "sets")
    zero, one = (F.lit(n).cast("long") for n in range(2))
    found = searched(met.where("chunks = 1").withColumns({"block": zero, "role": one}).join(sets, "rep"), similarity, "all").select("a", "b")
    large = buckets.where("chunks > 1")
    if not large.head(1):
        return found
    many = met.where("chunks > 1").select("t", "key", "chunk", "rep")
    each = F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk")
    heads = large.select("t", "key", each, F.col("pivot").alias("rep")).withColumn("role", zero)
    others = many.join(large.select("t", "key", F.col("pivot").alias("rep")), ["t", "key", "rep"], "left_anti").withColumn("role", one)
    stars = stored(searched(heads.unionByName(others).withColumn("block", zero).join(sets, "rep"), similarity, "star"), "stars")
    rest = stars.where("b is null").select("t", "key", F.col("a").alias("rep"))
    blocks = stored(rest.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("blocks")).join(large.select("t", "key", "chunks"), ["t", "key"]), "blocks")
    mine = rest.join(blocks, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")))
    mine = mine.select("t", "key", each, "block", "rep").withColumn("role", zero)
    theirs = many.join(rest.withColumn("left", F.lit(True)), ["t", "key", "rep"], "left").join(blocks, ["t", "key"])
    theirs = theirs.select("t", "key", "chunk", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), "rep", F.when(F.col("left"), F.lit(2)).otherwise(F.lit(1)).cast("long").alias("role"))
    more = searched(mine.unionByName(theirs).join(sets, "rep"), similarity, "rest")
    return found.unionByName(stars.where("b is not null").select("a", "b")).unionByName(more.select("a", "b"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Of the rows of ``docs`` that are joined by similar texts the one with the smallest id (nulls last)."""
    import pyarrow as pa

    row = unused(docs, "_row")
    rows = keyed(docs, id_col, text_col, row)
    bits, tables = tables_for(rows.count(), similarity)

    def sign(batches):
        import numpy as np
        import xxhash

        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            shapes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            prints = [fingerprint(s, bits, tables) for s in sets]
            near = [np.packbits(p[:NEAR_BITS]).view(np.int64) for p in prints]
            keys = [table_keys(p, bits, tables) if len(s) else [] for s, p in zip(sets, prints)]
            yield pa.record_batch([batch.column(0), shapes, pa.array(near, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int32()))], ["row", "shape", "near", "keys"])

    signed = stored(rows.select(row, text_col).mapInArrow(sign, "row long, shape binary, near array<long>, keys array<int>"), "shapes")
    classes = stored(signed.groupBy("shape").agg(F.min(F.struct("row", "near", "keys")).alias("c")).select(F.col("c.row").alias("rep"), "c.near", "c.keys"), "classes")
    total = classes.count()
    entries = stored(proposed(classes, total, tables, similarity), "proposed")
    found = components(stored(links(entries, rows, row, text_col, similarity), "links"), "a", "b")
    later = found.where("node != root").select(F.col("node").alias("rep"))
    kept = stored(classes.select("rep").join(later, "rep", "left_anti").select(F.col("rep").alias(row)), "kept", total)
    return rows.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)  # grows with the input: never broadcast
