"""Packing documents into token windows by the sum of squares.

Each task packs the documents it reads, online: a document's last part goes
into the fill level h that makes the sum of the squares of the counts of
partially filled windows smallest, tracked in an array of counts by level.  A
longer document first fills windows of its own.

Exact fits need many documents for each level.  When a task's documents end, or
its open windows hold ``OPEN_TOKENS``, what lies in them is packed again by the
same rule with fewer, coarser levels, about as many as there are windows to
fill: sizes are rounded up, and what rounding leaves free in a window is filled
with tokens cut from the last document in the queue.  Levels get coarser until
less than a window is left, which is cut at powers of two and needs no padding.
Nothing is shuffled, a task's memory is bounded by ``OPEN_TOKENS``, a batch of
results and its cache of words, and a repeated task gives the same result.

Cases: a null text is empty, and each document ends with the end id, so that an
empty one still holds a token; very long documents span many windows; repeated
rows are packed each, and null ids like others; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import collections
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices
from tessella.llm.tokens import WordIds, default_path

WINDOW = 4096
END_ID = 2
#: Tokens in open windows at which a task packs them again with coarser levels.
OPEN_TOKENS = 2 << 20


class SumOfSquares:
    """Open windows by fill level, in grains.  ``put`` returns a window once its levels are all taken.

    Placing s grains at level h changes the sum of squares by
    1 - 2 n[h] (a window leaves level h > 0) and by 1 + 2 n[h + s] (it arrives,
    if not full).  Ties go to the fullest window.
    """

    def __init__(self, window: int, grain: int = 1):
        import numpy as np

        self.np, self.levels, self.grain = np, window // grain, grain
        self.count = np.zeros(self.levels + 1, np.int64)
        self.open: dict[int, list] = {}

    def put(self, piece, size: int):
        size = -(-size // self.grain)
        np, n, top = self.np, self.count, self.levels - size
        levels = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(n[1 : top + 1]) + 1])
        change = np.where(levels > 0, 1 - 2 * n[levels], 0) + np.where(levels < top, 1 + 2 * n[levels + size], 0)
        h = int(levels[len(levels) - 1 - int(np.argmin(change[::-1]))])
        if h:
            held = self.open[h].pop()
            n[h] -= 1
        else:
            held = []
        held.append(piece)
        if h + size == self.levels:
            return held
        n[h + size] += 1
        self.open.setdefault(h + size, []).append(held)
        return None

    def rest(self):
        """The pieces in windows that are still open, fullest first."""
        return [p for h in sorted(self.open, reverse=True) for held in self.open[h] for p in held]


def size_of(piece) -> int:
    return len(piece[3]) // 4


def cut(piece, n: int):
    """The first ``n`` tokens of a piece (doc, start, doc_tokens, ids), and the others."""
    doc, start, total, ids = piece
    return (doc, start, total, ids[: 4 * n]), (doc, start + n, total, ids[4 * n :])


def packed_again(pieces, window: int, grain: int):
    """(whole windows, what is left) of pieces placed at levels of ``grain`` tokens."""
    packer, queue, windows, left = SumOfSquares(window, grain), collections.deque(pieces), [], []
    while queue:
        piece = queue.popleft()
        held = packer.put(piece, size_of(piece))
        if held is None:
            continue
        room = window - sum(map(size_of, held))
        while room and queue:
            last = queue.pop()
            if size_of(last) > room:
                last, more = cut(last, room)
                queue.append(more)
            held.append(last)
            room -= size_of(last)
        if room:
            left += held
        else:
            windows.append(held)
    return windows, left + packer.rest()


def settled(pieces, window: int, keep: int = 0):
    """(whole windows, what is left): at most ``keep`` tokens, or less than a window, are left."""
    windows, grain = [], 1
    while (size := sum(map(size_of, pieces))) > keep and size >= window:
        filled = size // window
        grain = min(window, max(2 * grain, window >> (filled.bit_length() - 1)))
        made, pieces = packed_again(pieces, window, grain)
        windows += made
    return windows, pieces


def closing(size: int, window: int):
    """Window sizes that hold ``size`` tokens without padding: whole windows, then powers of two."""
    out = [window] * (size // window)
    left = size % window
    while left:
        out.append(1 << (left.bit_length() - 1))
        left -= out[-1]
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are little-endian unsigned 32-bit; a sequence is its pieces in the
    order of their offsets.
    """
    import pyarrow as pa

    path = path or default_path("word_bpe_49k.json")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    batch_bytes, names = 4 << 20, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches):
        from pyspark import TaskContext

        ids_of, packer, end = WordIds(path), SumOfSquares(window), WordIds.packed([end_id])
        sequence, rows, held, id_type, waiting = TaskContext.get().partitionId() << 33, [], 0, pa.int64(), 0

        def close(pieces):  # a piece: doc_id, start, doc_tokens, ids
            nonlocal sequence, held
            at = 0
            for doc, start, total, ids in pieces:
                rows.append((doc, start, len(ids) // 4, total, sequence, at, ids))
                at += len(ids) // 4
                held += len(ids)
            sequence += 1

        def made(least):
            nonlocal rows, held
            if held > least:
                columns = [*zip(*rows)]
                kinds = [id_type, *[pa.int64()] * 5, pa.binary()]
                rows, held = [], 0
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def taken(pieces):
            """The pieces as windows of these sizes, one after another."""
            sizes = closing(sum(map(size_of, pieces)), window)
            own = []
            for piece in pieces:
                while size_of(piece) >= sizes[0] - sum(map(size_of, own)):
                    first, piece = cut(piece, sizes[0] - sum(map(size_of, own)))
                    yield [*own, first]
                    own = []
                    sizes.pop(0)
                    if not sizes or not size_of(piece):
                        break
                if size_of(piece):
                    own.append(piece)

        for batch in slices(batches):
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (ids_of(text) if text else b"") + end
                total = len(ids) // 4
                whole = total // window * window
                for at in range(0, whole, window):
                    close([(doc, at, total, ids[4 * at : 4 * (at + window)])])
                if whole < total:
                    waiting += total - whole
                    if full := packer.put((doc, whole, total, ids[4 * whole :]), total - whole):
                        waiting -= window
                        close(full)
                if waiting > OPEN_TOKENS:
                    windows, left = settled(packer.rest(), window, OPEN_TOKENS // 2)
                    packer, waiting = SumOfSquares(window), 0
                    for pieces in windows:
                        close(pieces)
                        yield from made(batch_bytes)
                    for piece in left:
                        waiting += size_of(piece)
                        if full := packer.put(piece, size_of(piece)):
                            waiting -= window
                            close(full)
                yield from made(batch_bytes)
        windows, left = settled(packer.rest(), window)
        for pieces in itertools.chain(windows, taken(left)):
            close(pieces)
            yield from made(batch_bytes)
        yield from made(0)

    return docs.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
