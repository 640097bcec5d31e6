"""Exact removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of 100 bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in the same one.  In a suffix array, the
nearest entries before and after a suffix that start earlier in the text (its
previous and next smaller positions) share the longest prefixes with it that
any earlier suffix shares: the longest-previous-factor (LPF) array.  A suffix
whose entry is 100 or more starts a string to remove.

One suffix array of a whole corpus can't be built in one place, and most of its
entries would tell nothing.  So:

1. Every window of 100 bytes has an anchor: the smallest hash of the 24-byte
   strings in it.  Equal windows have equal anchors.  A run of windows with one
   anchor is a piece (77 windows at most, 39 on average).
2. Pieces are shuffled, packed and without their bytes, by anchor.  An anchor
   that stands once tells nothing more.
3. The bytes of all other pieces meet by anchor.  Of pieces with equal bytes
   all but the first have LPF entries of 100 or more throughout, by definition,
   and go as they are; the LPF array of the distinct ones tells which of their
   windows came earlier.  An anchor with very many contents (a frequent line in
   ever new surroundings) is split further: its windows meet by a hash of their
   100 bytes.
4. Each document's removed intervals meet its text.

Pieces that a task sees twice are compared there already, byte by byte, before
step 2.  Hashes only say what to compare: nothing is removed but on equal bytes,
and equal windows always meet.

Each step's memory is bounded by a flush, a bucket of a size derived from the
input's bytes, or a group's cut: an anchor sends ``FLUSH_CONTENTS`` pieces a
flush at most, then one piece a bucket for each content.  No rows are capped.

Cases: a null text has no bytes; texts under 100 bytes lose nothing; a row that
repeats an id and its text is the same document and has the same result, one
that repeats an id with another text is a document of its own (they come in an
order of their own under that id); rows with a null id lose nothing and take
nothing from others; an empty table gives an empty result; further columns are
ignored.  Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import GROUP_BYTES, keyed, measured, partitions_for, slices, stored, unused
from tessella.llm.simhash import grouped

LENGTH = 100
ANCHOR = 24
FLUSH_BYTES = 16 << 20
SEGMENT = 1 << 17
#: An anchor with more contents than this, in a flush or in all, or with more pieces in all, is split by window.
FLUSH_CONTENTS, CONTENTS, PIECES = 128, 1024, 1 << 16
MOST_WINDOWS = 255
#: Bytes of candidate pieces in one suffix array, at least up to the end of a group.
SUFFIX_BYTES = 1 << 20


class Rolling:
    """Hashes of all substrings of a text from prefix sums: a substring's hash
    is the sum of its bytes' values times powers of an odd base, modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        import numpy as np

        self.np = np
        self.values = np.random.default_rng(20_240_901).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def tables(self, n: int):
        np = self.np
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.BASE, -m, 1 << 64))])
        return self.up, self.down

    def sums(self, data):
        np = self.np
        up, _ = self.tables(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * up[: len(data)], out=out[1:])
        return out

    def between(self, sums, start, stop):
        _, down = self.tables(len(sums))
        return (sums[stop] - sums[start]) * down[start]

    def mixed(self, h):
        np = self.np
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def least_in_windows(h, width: int):
    """The least of each ``width`` neighbours, by doubling."""
    import numpy as np

    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def pieces_of(rolling: Rolling, data, length: int = LENGTH):
    """(anchor hash, content hash, start, windows, inner) arrays of the pieces of one segment.

    ``inner``: the anchor's hash stands at two places of the piece at least;
    only then can two of the piece's own windows be equal.
    """
    np, anchor = rolling.np, min(ANCHOR, max(1, length // 4))
    sums = rolling.sums(data)
    at = np.arange(len(data) - anchor + 1)
    _, down = rolling.tables(len(sums))
    grams = rolling.mixed((sums[anchor:] - sums[: len(at)]) * down[: len(at)])
    least = least_in_windows(grams, length - anchor + 1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(least)))
    if sizes.max() > MOST_WINDOWS:
        parts = -(-sizes // MOST_WINDOWS)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + sizes, parts)
        starts = np.repeat(starts, parts) + inner * MOST_WINDOWS
        sizes = np.minimum(MOST_WINDOWS, ends - starts)
    content = rolling.mixed(rolling.between(sums, starts, starts + sizes + length - 1) + sizes.astype(np.uint64))
    width, value = length - anchor + 1, least[starts]
    within = np.lib.stride_tricks.sliding_window_view(grams, width)
    leftmost = starts + (within[starts] == value[:, None]).argmax(axis=1)
    rightmost = starts + sizes + width - 2 - (within[starts + sizes - 1] == value[:, None])[:, ::-1].argmax(axis=1)
    return value, content, starts, sizes, rightmost > leftmost


#: A piece with its place in a flush, and as it is shuffled (there, the hash of its content only helps to count contents).
PLACED = [("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("windows", "u1"), ("inner", "u1"), ("at", "<i8")]
PIECE = [("anchor", "<u8"), ("content", "<u2"), ("doc", "<i8"), ("start", "<u4"), ("windows", "u1"), ("inner", "u1")]
#: Windows of a document that go (kind 0) or that are to be compared: all pieces of an anchor (1; INNER: also a piece's own windows) or window by window (2).
MARK = [("doc", "<i8"), ("start", "<u4"), ("windows", "u1"), ("kind", "u1"), ("anchor", "<u8")]
INNER = 3
#: Added to a candidate's windows if they are to be compared with each other too.
OWN_WINDOWS = 1024


def bucket_of(keys, parts: int):
    """``pmod(xxhash64(key), parts)`` of whole numbers, as Spark's functions have it."""
    import numpy as np

    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.uint64(42) + p5 + np.uint64(8) ^ turned(np.asarray(keys, np.int64).view(np.uint64) * p2, 31) * p1
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % parts


def of_kind(pieces, kind):
    """``pieces`` as records of another kind, by the fields that both have."""
    import numpy as np

    out = np.zeros(len(pieces), kind)
    for c in out.dtype.names:
        if c in pieces.dtype.names:
            out[c] = pieces[c]
    return out


def marks(pieces, kind):
    out = of_kind(pieces, MARK)
    out["kind"] = kind
    return out


def judged(pieces):
    """Pieces in order of anchor, content and place, with what is known of them:
    first of its content, contents of its anchor, pieces of its anchor."""
    import numpy as np

    pieces = pieces[np.lexsort((pieces["start"], pieces["doc"], pieces["content"], pieces["anchor"]))]
    new_anchor = np.concatenate([[True], pieces["anchor"][1:] != pieces["anchor"][:-1]])
    first = new_anchor | np.concatenate([[True], pieces["content"][1:] != pieces["content"][:-1]])
    group = np.cumsum(new_anchor) - 1
    return pieces, first, np.bincount(group, weights=first).astype(np.int64)[group], np.bincount(group)[group]


def same_bytes(data, a, b, sizes, block: int = 1 << 21):
    """Whether the strings of ``sizes`` bytes at places a and b of ``data`` are equal."""
    import numpy as np

    out, ends = np.empty(len(a), bool), np.cumsum(sizes)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, block)), len(a)))
    for x, y in zip([0, *cuts], cuts):
        if x < y:
            n = sizes[x:y]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = data[np.repeat(a[x:y], n) + within] != data[np.repeat(b[x:y], n) + within]
            out[x:y] = np.add.reduceat(differ, np.cumsum(n) - n, dtype=np.int64) == 0
    return out


def packed(array) -> bytes:
    """Records byte by byte, all first bytes before all second ones: what differs little then takes little."""
    return array.view("u1").reshape(len(array), array.itemsize).T.tobytes()


def unpacked(blobs, kind):
    import numpy as np

    size = np.dtype(kind).itemsize
    parts = [np.frombuffer(b, "u1").reshape(size, -1).T for b in blobs]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind)[:, 0] if parts else np.empty(0, kind)


def bucket_rows(kind_of_row: int, array, bucket):
    """(kind, bucket, blob) rows of a structured array dealt by ``bucket``."""
    import numpy as np

    order = np.lexsort((array["start"], array["doc"], bucket)) if array.dtype == np.dtype(MARK) else np.argsort(bucket, kind="stable")
    array, bucket = array[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    return [(kind_of_row, int(bucket[a]), packed(array[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]


def found_marks(docs: DataFrame, buckets: int, doc_buckets: int, length: int) -> DataFrame:
    """(bucket, blob): marks by document bucket, from steps 1 and 2, for documents (key, text)."""
    import pyarrow as pa

    def batch_of(rows):
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int8()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "bucket", "blob"])

    def cut(batches):
        import numpy as np

        rolling, held, texts, size = Rolling(), [], [], 0

        def flush():
            pieces, first, contents, _ = judged(np.concatenate(held))
            data, again = np.concatenate(texts), np.flatnonzero(~first)
            source = np.maximum.accumulate(np.where(first, np.arange(len(pieces)), 0))[again]
            sizes = pieces["windows"][again].astype(np.int64)
            same = sizes == pieces["windows"][source]
            same[same] = same_bytes(data, pieces["at"][again[same]], pieces["at"][source[same]], sizes[same] + (length - 1))
            first[again[~same]] = True  # equal by hash only
            hot = contents > FLUSH_CONTENTS
            known = np.concatenate([marks(pieces[~first], 0), marks(pieces[first & hot], 2)])
            out = bucket_rows(1, known, bucket_of(known["doc"], doc_buckets))
            # of an anchor with very many contents one piece goes on, marked by 0 windows
            keep = first & ~hot
            one = np.flatnonzero(hot & np.concatenate([[True], pieces["anchor"][1:] != pieces["anchor"][:-1]]))
            sent = of_kind(np.concatenate([pieces[keep], pieces[one]]), PIECE)
            sent["windows"][keep.sum() :] = 0
            out += bucket_rows(0, sent, (sent["anchor"] >> np.uint64(8)) % np.uint64(buckets))
            yield batch_of(out)

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8) if text else b""
                if len(data) < length:
                    continue
                for at in range(0, len(data) - length + 1, SEGMENT):
                    a, c, s, n, inner = pieces_of(rolling, data[at : at + SEGMENT + length - 1], length)
                    own = np.empty(len(a), PLACED)
                    own["anchor"], own["content"], own["doc"], own["start"], own["windows"], own["inner"], own["at"] = a, c, doc, s + at, n, inner, s + at + size
                    held.append(own)
                texts.append(data)
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield from flush()
                    held, texts, size = [], [], 0
        if held:
            yield from flush()

    cuts = docs.where("key is not null").select("key", "text").mapInArrow(cut, "kind byte, bucket long, blob binary")
    # marks already known pass through, dealt by their own buckets
    dealt = cuts.select("bucket", "kind", "blob").repartition(max(1, buckets // 4), F.col("bucket")).sortWithinPartitions("bucket", "kind")

    def meet(batches):
        import numpy as np

        for part in grouped(batches, 2):
            kinds, blobs = part.column(1).to_numpy(), part.column(2).to_pylist()
            edges = np.flatnonzero((np.diff(part.column(0).to_numpy()) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(blobs)]):
                if kinds[a]:
                    made = unpacked(blobs[a:b], MARK)
                else:
                    pieces = unpacked(blobs[a:b], PIECE)
                    split = np.unique(pieces["anchor"][pieces["windows"] == 0])
                    pieces = pieces[pieces["windows"] > 0]
                    if not len(pieces):
                        continue
                    pieces, _, contents, number = judged(pieces)
                    hot = (contents > CONTENTS) | (number > PIECES) | np.isin(pieces["anchor"], split)
                    inner = pieces["inner"] > 0
                    made = np.concatenate([marks(pieces[hot], 2), marks(pieces[~hot & ~inner & (number > 1)], 1), marks(pieces[~hot & inner], INNER)])
                if out := bucket_rows(0, made, bucket_of(made["doc"], doc_buckets)):
                    yield pa.record_batch([pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "blob"])

    return dealt.mapInArrow(meet, "bucket long, blob binary")


def longest_previous_factors(data, starts, order, length: int = LENGTH):
    """For each of ``starts`` in ``data``: the longest prefix, up to ``length``,
    that a start of smaller ``order`` shares.

    Suffixes are sorted by ranks of prefixes of doubling length.  The previous
    and next smaller positions in suffix order come by pointer jumping, along
    which the common prefix lengths take the minimum.
    """
    import numpy as np

    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * length + 4, np.uint8)]).astype(np.uint64)
    word, ranks, size = padded[: n + length], {}, 4
    for k in range(1, 4):
        ranks[k] = word
        word = (word << np.uint64(8)) | padded[k : k + n + length]
    del ranks[3]
    ranks[4] = word
    while 2 * size <= length:
        r = ranks[size]
        step = np.concatenate([r[size:], np.zeros(size, np.uint64)])
        ranks[2 * size] = np.unique((r << np.uint64(32)) | step, return_inverse=True)[1].astype(np.uint64)
        size *= 2
    key, offset = [], 0
    for w in sorted(ranks, reverse=True):
        while length - offset >= w:
            key.append(ranks[w][starts + offset])
            offset += w
    by = np.lexsort((order, *key[::-1]))
    pos, place = order[by], starts[by]
    same = np.zeros(max(0, len(by) - 1), np.int64)
    for w in sorted(ranks, reverse=True):  # the common prefix with the suffix before, binary digit by digit
        same += w * ((same + w <= length) & (ranks[w][place[:-1] + same] == ranks[w][place[1:] + same]))
    best = np.zeros(len(by), np.int64)
    for step in (1, -1):
        p, common = (pos, same) if step == 1 else (pos[::-1], same[::-1])
        prior = np.arange(len(p)) - 1
        shared = np.concatenate([[0], common]) if len(p) else common
        todo = np.flatnonzero(prior >= 0)
        while len(todo):
            todo = todo[(prior[todo] >= 0)]
            todo = todo[p[prior[todo]] > p[todo]]
            over = prior[todo]
            shared[todo] = np.minimum(shared[todo], shared[over])
            prior[todo] = prior[over]
        shared = np.where(prior >= 0, shared, 0)
        best = np.maximum(best, shared if step == 1 else shared[::-1])
    out = np.empty(len(by), np.int64)
    out[by] = best
    return out


def runs(hit):
    import numpy as np

    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def candidates(rows: DataFrame, length: int) -> DataFrame:
    """(key, doc, start, windows, content): the bytes of marked pieces, by anchor
    or by window.  Fewer than 0 windows: so many that came earlier in the bucket."""
    import pyarrow as pa

    names = ["key", "doc", "start", "windows", "content"]

    def run(table):
        import numpy as np
        import xxhash

        found = unpacked([b for b in table.column("blob").to_pylist() if b is not None], MARK)
        found = found[found["kind"] > 0]
        found = found[np.lexsort((found["start"], found["doc"]))]
        keys, texts = table.column("key").to_pylist(), table.column("text").to_pylist()
        rows, pieces, windows = [], set(), set()
        for doc, text in sorted({i: t for i, t in zip(keys, texts) if i is not None and t is not None}.items()):
            own = found[slice(*np.searchsorted(found["doc"], [doc, doc + 1]))]
            data = text.encode() if len(own) else b""
            for s, n, kind, anchor in zip(own["start"].tolist(), own["windows"].tolist(), own["kind"].tolist(), own["anchor"].astype(np.int64).tolist()):
                if kind != 2:
                    part = data[s : s + n + length - 1]
                    if (anchor, part) in pieces:
                        rows.append((anchor, doc, s, -n, None))
                    else:
                        pieces.add((anchor, part))
                        rows.append((anchor, doc, s, n + OWN_WINDOWS * (kind == INNER), part))
                    continue
                since = s  # where the windows met before begin
                for at in range(s, s + n):
                    part = data[at : at + length]
                    if part not in windows:
                        windows.add(part)
                        rows.append((xxhash.xxh3_64_intdigest(part) - (1 << 63), doc, at, 1, part))
                        if since < at:
                            rows.append((at, doc, since, since - at, None))
                        since = at + 1
                if since < s + n:
                    rows.append((s, doc, since, since - s - n, None))
        columns = [*zip(*rows)] or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names)

    return rows.groupBy("bucket").applyInArrow(run, "key long, doc long, start long, windows int, content binary")


def distinct_first(key, contents):
    """Whether each content, in order, is the first of its key with these bytes."""
    out, seen, at = [], set(), None
    for k, content in zip(key, contents):
        if k != at:
            seen, at = set(), k
        out.append(content not in seen)
        seen.add(content)
    return out


def compared(pieces: DataFrame, parts: int, doc_buckets: int, length: int) -> DataFrame:
    """(bucket, blob): marks of the windows that came earlier, from the LPF arrays of step 3."""
    import pyarrow as pa

    def lpf(tables):
        import numpy as np

        table = pa.concat_tables(tables)
        key, doc, start, size = (table.column(c).to_numpy() for c in ("key", "doc", "start", "windows"))
        known = size < 0
        made = [np.stack([doc[known], start[known], -size[known].astype(np.int64)], axis=1)]
        order = np.lexsort((start, doc, key))
        order = order[~known[order]]
        contents = table.column("content").take(pa.array(order)).to_pylist()
        key, doc, start, inner, size = key[order], doc[order], start[order], size[order] >= OWN_WINDOWS, size[order].astype(np.int64) % OWN_WINDOWS
        new = np.array(distinct_first(key.tolist(), contents), bool)
        made.append(np.stack([doc[~new], start[~new], size[~new]], axis=1))
        key, doc, start, inner, size = key[new], doc[new], start[new], inner[new], size[new]
        edge = np.concatenate([[True], key[1:] != key[:-1], [True]])
        use = inner | ~(edge[:-1] & edge[1:])  # what nothing else shares came first
        doc, start, size = doc[use], start[use], size[use]
        if len(doc):
            data = np.frombuffer(b"".join([contents[k] for k in np.flatnonzero(new)[use]]), np.uint8)
            begin = np.cumsum(size + length - 1) - (size + length - 1)
            rank = np.empty(len(doc), np.int64)
            rank[np.lexsort((start, doc))] = np.arange(len(doc))
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hit = longest_previous_factors(data, np.repeat(begin, size) + inside, np.repeat(rank, size) * 512 + inside, length) >= length
            piece = np.repeat(np.arange(len(doc)), size)
            a, b = runs(hit)
            ends = np.flatnonzero(np.diff(piece)) + 1  # runs end with their pieces
            edges = np.unique(np.concatenate([a, b, ends[hit[ends]]])) if len(a) else a
            if len(edges):
                x, y = edges[:-1][hit[edges[:-1]]], edges[1:][hit[edges[:-1]]]
                made.append(np.stack([doc[piece[x]], start[piece[x]] + inside[x], y - x], axis=1))
        made = np.concatenate(made)
        out = np.zeros(len(made), MARK)
        out["doc"], out["start"], out["windows"] = made.T
        rows = bucket_rows(0, out, bucket_of(out["doc"], doc_buckets))
        return pa.record_batch([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "blob"])

    def run(batches):
        held, size = [], 0
        for part in grouped(batches, 1):
            held.append(part)
            size += part.nbytes
            if size >= SUFFIX_BYTES:
                yield lpf(held)
                held, size = [], 0
        if held:
            yield lpf(held)

    return pieces.repartition(parts, F.col("key")).sortWithinPartitions("key").mapInArrow(run, "bucket long, blob binary")


def as_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows, one row for each document) of rows (doc_id, text) of which some
    repeat an id, with a ``key`` in the order of ids, and under an id of its texts."""
    rows = docs.withColumn("_text", F.md5(F.coalesce("text", F.lit(""))))
    known = rows.where("doc_id is not null").select("doc_id", "_text").distinct()
    order = ["doc_id", "_text"]
    known = stored(known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "keys")
    rows = stored(rows.join(known, order, "left").select("key", "doc_id", "text"), "rows")
    return rows, rows.where("key is not null").dropDuplicates(["key"])


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), a row for each input row: the byte
    intervals that go, and the bytes that stay.  ``whole_characters``: a
    character goes only with all of its bytes."""
    import pyarrow as pa

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, distinct, size = measured(docs, "doc_id", "text")
    parts = partitions_for(docs.sparkSession, size)
    doc_buckets = max(4 * parts, -(-size // GROUP_BYTES))
    docs, once = (docs.withColumn("key", F.col("doc_id")),) * 2 if distinct else as_documents(docs)
    marked = stored(found_marks(once, 4 * parts, doc_buckets, length), "marks")
    bucket = F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(doc_buckets))).otherwise(F.pmod(F.xxhash64("text"), F.lit(doc_buckets)))
    rows = docs.select(bucket.alias("bucket"), "key", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("binary").alias("blob"))
    rows = rows.unionByName(marked.select("bucket", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob"))
    rows = rows.repartition(parts, "bucket")
    late = compared(candidates(rows, length), parts, doc_buckets, length).repartition(parts, "bucket")

    def cut(table, more):
        import numpy as np

        blobs = [b for b in table.column("blob").to_pylist() if b is not None] + more.column("blob").to_pylist()
        found = unpacked(blobs, MARK)
        found = found[found["kind"] == 0]
        found = found[np.argsort(found["doc"], kind="stable")]
        out = []
        for key, doc, text in zip(*(table.column(c).to_pylist() for c in ("key", "doc_id", "text"))):
            if text is None:
                continue
            data = text.encode()
            own = found[slice(*np.searchsorted(found["doc"], [key, key + 1]))] if key is not None else found[:0]
            if not len(own):
                out.append((doc, len(data), [], data))
                continue
            change = np.zeros(len(data) + 1, np.int64)
            start = own["start"].astype(np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + own["windows"] + (length - 1), -1)
            gone = np.cumsum(change[:-1]) > 0
            if whole_characters:
                first = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(data))))
            spans = [{"start": int(a), "stop": int(b)} for a, b in zip(*runs(gone))]
            out.append((doc, len(data), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
        columns = [*zip(*out)] or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.groupBy("bucket").cogroup(late.groupBy("bucket")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut from the texts, by whole characters.

    Rows come in the order of ids (nulls last, and those take part); each row
    is a document, so that one that repeats an earlier row's text is emptied.
    Other columns keep their values, whatever their names.
    """
    row, other, kept, null = (unused(docs, c) for c in ("_row", "_id", "_kept", "_null"))
    rows = keyed(docs, id_col, text_col, row)
    found = repeated(rows, row, text_col, whole_characters=True).select(F.col("doc_id").alias(other), F.col("kept").cast("string").alias(kept))
    rest = rows.withColumn(null, F.col(text_col).isNull()).drop(text_col)
    out = rest.join(found, F.col(row) == F.col(other))
    out = out.withColumn(text_col, F.when(~F.col(null), F.col(kept)))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return out.select(*docs.columns)


DIGESTS_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS z FROM documents),
s AS (SELECT doc_id, 1000 * j AS o, substr(h, (2000 * j + 1)::INT, {2000 + 2 * (LENGTH - 1)}) AS t
      FROM (SELECT *, unnest(range((z - {LENGTH}) // 1000 + 1)) AS j FROM d WHERE z >= {LENGTH})),
w AS (SELECT doc_id, o + i AS i, md5_number(substr(t, (2 * i + 1)::INT, {2 * LENGTH})) AS k
      FROM (SELECT *, unnest(range(least(1000, len(t) // 2 - {LENGTH - 1}))) AS i FROM s)),
f AS (SELECT k, min((doc_id, i)) AS first FROM w GROUP BY k HAVING count(*) > 1),
x AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE (doc_id, i) <> first),
b AS (SELECT *, CASE WHEN i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS new FROM x),
g AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM b) GROUP BY doc_id, n),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM g),
q AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, (2 * p + 1)::INT, (2 * (a - p))::INT), '' ORDER BY a) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, z::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, (2 * last + 1)::INT) END)) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""
