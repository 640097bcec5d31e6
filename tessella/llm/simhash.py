"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distances.

A fingerprint's 64 bits are cut into m blocks.  Two fingerprints that differ in
at most d bits agree on m - d whole blocks at least, so that under one of the
C(m, d) choices of blocks both have the same key.  m grows with the number of
distinct fingerprints, which keeps chance meetings few; every choice of m finds
every link.  Rows that share a key are searched in one pass that removes what it
has reached: a group of close fingerprints gives a link for each member, not
for each pair, and equal fingerprints are one vertex from the start.

Cases: a null or empty text, or one of white space only, has fingerprint zero,
linked like any other; fewer words than a shingle holds make one shingle;
repeated rows and ids each return a row; a component's id is its smallest id
that is not null, null if it has none; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import keyed, slices, stored, unused
from tessella.llm.components import components

WORDS = 4
SEED = 42
DISTANCE = 4
#: Distinct fingerprints of a block that are searched in one place; the rows of a larger one are dealt to narrower blocks.
CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> bytes:
    """8 bytes, the highest bit first."""
    import numpy as np
    import xxhash

    own = text.encode().lower().split() if text else []  # bytes: ASCII letters and white space only
    if not own:
        return bytes(8)
    line, ends = b" ".join(own), [*itertools.accumulate(map(len, own), lambda a, n: a + n + 1)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:e], seed) for a, e in zip(starts, ends[words - 1 :] or ends[-1:])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def majority(hashes, words: int):
    """The bits, 0 or 1, of a SimHash of 64 * ``words`` bits over distinct 64-bit
    hashes.  The first 64 are voted on by the hashes themselves, as those of
    ``fingerprint`` are, each 64 more by another mixture of them."""
    import numpy as np

    steps = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255):  # so many votes fit a byte
        own = hashes[at : at + 255]
        z = own[:, None] + steps
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        z[:, 0] = own
        votes += np.add.reduce(np.unpackbits(z.astype(">u8").view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * votes > len(hashes)).view(np.uint8)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long with the same bits."""
    import pyarrow as pa

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        import numpy as np

        for batch in slices(batches):
            made = b"".join([fingerprint(t, words) for t in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(made, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(n: int, distance: int = DISTANCE, bits: int = 64) -> list[int]:
    """The bit masks of the block choices: as many blocks as keep the rows of
    all tables, and the chance meetings in them, fewest; two whole blocks agree
    at least, so that small and middling inputs have the same tables."""
    best = None
    for m in range(distance + 2, distance + 6):
        tables = math.comb(m, distance)
        cost = tables * (1 + n / 2 ** (bits * (m - distance) / m) / 3)
        if best is None or cost < best[0]:
            best = (cost, m)
    m = best[1]
    edges = [bits * k // m for k in range(m + 1)]
    blocks = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(m)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, m - distance)]


def reach(fps, distance: int = DISTANCE):
    """Links that connect all of ``fps`` (distinct, sorted) that are connected: (from, to) arrays."""
    import numpy as np

    out, left = ([], []), fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                new = left[near]
                out[0].append(np.full(len(new), x))
                out[1].append(new)
                todo.extend(new)
                left = left[~near]
    return tuple(np.concatenate(x) if x else fps[:0] for x in out)


def grouped(batches, n_keys: int):
    """Rows sorted by their first ``n_keys`` columns, as tables cut where a group ends."""
    import numpy as np
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(n_keys)):
            yield pa.Table.from_batches(held)
            held = []
        if len(changes):
            last = int(changes[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounded_groups(batches, n_keys: int, most: int):
    """(table, hot): whole groups of rows sorted by their first ``n_keys`` columns;
    a group of more than ``most`` rows (that spans batches) comes in parts, with hot set."""
    import numpy as np
    import pyarrow as pa

    held, size, hot, last = [], 0, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        if last is not None and last != [k[0] for k in keys]:
            if held:
                yield pa.Table.from_batches(held), hot or size > most
            held, size, hot = [], 0, False
        edges = (np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist()
        if edges:
            held.append(batch.slice(0, edges[0]))
            yield pa.Table.from_batches(held), hot or size + edges[0] > most
            if len(edges) > 1:
                yield pa.Table.from_batches([batch.slice(edges[0], edges[-1] - edges[0])]), False
            held, size, hot = [], 0, False
        rest = batch.slice(edges[-1] if edges else 0)
        held.append(rest)
        size, last = size + rest.num_rows, [k[-1] for k in keys]
        if size > most:
            yield pa.Table.from_batches(held), True
            held, hot = [], True
    if held:
        yield pa.Table.from_batches(held), hot or size > most


def choices(bits: list[int], distance: int):
    """The bits as distance + 2 blocks, and the masks of every two of them."""
    n = distance + 2
    blocks = [sum(1 << b for b in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]
    return [x | y for x, y in itertools.combinations(blocks, 2)]


def narrowed(hot: DataFrame, distance: int) -> DataFrame:
    """(t, key, fp): the rows of blocks with very many fingerprints in narrower
    ones.  The bits in which a block's fingerprints differ are cut anew, into
    distance + 2 blocks, two of which close pairs share."""
    import pyarrow as pa

    differ = hot.groupBy("t", "key").agg(F.bit_or("a").alias("o"), F.bit_and("a").alias("n"))
    differ = stored(differ.select("t", "key", F.col("o").bitwiseXOR(F.col("n")).alias("bits"), F.monotonically_increasing_id().alias("block")), "blocks")
    n = len(choices([], distance))

    def run(batches):
        import numpy as np

        for batch in batches:
            block, bits, fp = (batch.column(c).to_numpy() for c in range(3))
            for which in np.unique(bits):
                own = np.flatnonzero(bits == which)
                masks = np.array(choices([b for b in range(64) if int(which) >> b & 1], distance), np.uint64).view(np.int64)
                t = block[own][:, None] * n + np.arange(n)
                yield pa.record_batch([pa.array(x.ravel()) for x in (t, fp[own][:, None] & masks, np.repeat(fp[own], n))], ["t", "key", "fp"])

    return hot.join(differ, ["t", "key"]).select("block", "bits", F.col("a").alias("fp")).mapInArrow(run, "t long, key long, fp long")


def links(distinct: DataFrame, count: int, fp_col: str = "fp", distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between ``count`` distinct fingerprints that join all that are joined."""
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(count, distance)]
    keys = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col(fp_col).bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)])
    rows = distinct.select(F.explode(keys).alias("k"), F.col(fp_col).alias("fp")).select("k.t", "k.key", "fp")
    out = None
    while True:
        found = stored(searched(rows, distance), "links")
        own = found.where("b is not null").select("a", "b")
        out = own if out is None else out.unionByName(own)
        hot = found.where("b is null")
        if not hot.head(1):
            return out
        rows = narrowed(hot, distance)


def searched(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b, t, key): links of rows (t, key, fp) that share t and key; without b
    the rows of those with more than ``CHUNK`` fingerprints."""
    import pyarrow as pa

    least = 1 << (distance + 2)  # so many fingerprints differ in enough bits to be cut anew
    rows = rows.repartition(F.col("t"), F.col("key")).sortWithinPartitions("t", "key", "fp")

    def run(batches):
        import numpy as np

        for part, hot in bounded_groups(batches, 2, max(CHUNK, least)):
            t, key, fp = (part.column(k).to_numpy() for k in range(3))
            if hot:
                yield pa.record_batch([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(t), pa.array(key)], ["a", "b", "t", "key"])
                continue
            fp = fp.view(np.uint64)
            edge = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, stops = np.concatenate([[0], edge]), np.concatenate([edge, [len(t)]])
            size = stops - starts
            a, b = [], []
            two = starts[size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
            a.append(fp[two[near]])
            b.append(fp[two[near] + 1])
            for k in np.flatnonzero(size > 2):
                x, y = reach(fp[starts[k] : stops[k]], distance)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([a, b], axis=1), axis=0)
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.record_batch([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64)), none, none], ["a", "b", "t", "key"])

    return rows.mapInArrow(run, "a long, b long, t long, key long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id), a row for each input row."""
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    total = distinct.count()
    found = stored(components(links(distinct, total, "fp", distance), "a", "b"), "components", total)
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least", total)
    classes = stored(rooted.join(least, "root").select("fp", "component_id"), "classes", total)
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of ``docs`` of a component the one with the smallest id (nulls last)."""
    row = unused(docs, "_row")
    rows = keyed(docs, id_col, text_col, row)
    kept = near_duplicates(rows, row, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
