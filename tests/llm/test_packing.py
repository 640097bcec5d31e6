"""What becomes of the windows that are open at the end."""

import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing
from tests.llm.test_tokens import check_pack


def pieces_of(sizes):
    out, at = [], 0
    for k, n in enumerate(sizes):
        out.append((k, 0, n, np.arange(at, at + n, dtype="<u4").tobytes()))
        at += n
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.sampled_from([0, 200]))
def test_settled_loses_nothing(sizes, keep):
    windows, left = packing.settled(pieces_of(sizes), 64, keep)
    assert all(sum(map(packing.size_of, w)) == 64 for w in windows)
    assert sum(map(packing.size_of, left)) <= max(keep, 63)
    got = sorted((p[0], p[1], p[2], p[3]) for w in [*windows, left] for p in w)
    by = {}
    for k, start, total, ids in got:
        assert total == sizes[k] and start == len(by.get(k, b"")) // 4
        by[k] = by.get(k, b"") + ids
    assert by == {k: ids for k, _, _, ids in pieces_of(sizes)}


def share_by_the_method(sizes, window=4096):
    """Tokens beyond whole windows, and those of them that stand, uncut, where the sum of squares put them."""
    packer, beyond, placed, open_sizes = packing.SumOfSquares(window), 0, 0, {}
    for k, n in enumerate(sizes):
        rest = n % window
        if rest:
            beyond += rest
            open_sizes[k] = rest
            full = packer.put((k, 0, n, bytes(4 * rest)), rest)
            placed += window if full else 0
            for p in full or ():
                del open_sizes[p[0]]
    windows, _ = packing.settled(packer.rest(), window)
    placed += sum(packing.size_of(p) for w in windows for p in w if packing.size_of(p) == open_sizes[p[0]])
    return beyond, placed


def test_most_tokens_go_through_the_method():
    """Of 10,000 documents in 32 tasks, at least half of the tokens outside whole windows."""
    r = random.Random(1)
    sizes = [max(1, int(r.lognormvariate(6, 1.2))) for _ in range(10_000)]
    found = [share_by_the_method(sizes[t::32]) for t in range(32)]
    assert sum(p for _, p in found) >= 0.8 * sum(b for b, _ in found)


def test_open_windows_are_bounded(make_docs, monkeypatch):
    """Documents that don't fit together are cut before they fill the memory."""
    monkeypatch.setattr(packing, "OPEN_TOKENS", 3 * 4096)
    rows = [(k, "word " * (2500 + k), "s") for k in range(40)] + [(100 + k, "a b c", "s") for k in range(30)] + [(None, "null id", None)]
    pieces = packing.pack(make_docs(rows, 1)).collect()
    check_pack(rows, pieces, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert len({p.sequence_id for p in pieces}) <= sum(p.length for p in pieces) // 4096 + 13
