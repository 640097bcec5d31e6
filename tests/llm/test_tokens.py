import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tessella.llm import packing, tokens


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_counts_equal_the_library(make_docs, hard_rows):
    model = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in tokens.token_counts(make_docs(hard_rows)).collect()}
    assert len(got) == len(hard_rows)
    for i, t, _ in hard_rows:
        assert got[i].n_tokens == len(model.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert got[i].n_bytes == len((t or "").encode())


def test_every_token_is_what_its_bytes_encode_to():
    """What makes the fast encoder's merges those of the file."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder, _ = tokens.fast_encoder(public_tokenizers.path(name))
        one = encoder._core_bpe.encode_single_piece
        wrong = [t for t, n in encoder._mergeable_ranks.items() if one(t) != [n]]
        assert not wrong
        import json

        model = json.load(open(public_tokenizers.path(name)))["model"]
        chars, end = tokens.byte_of_char(), model["end_of_word_suffix"] or "\0"
        raw = lambda t: bytes(chars[c] for c in t.removesuffix(end)) + (b"\x1f" if t.endswith(end) else b"")
        # merges of lower rank alone give the two parts of each merge
        from random import Random

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        for k in Random(1).sample(range(len(merges)), 300):
            a, b = merges[k]
            rank = encoder._mergeable_ranks[raw(a) + raw(b)]
            parts = [bytes([c]) for c in raw(a) + raw(b)]
            while True:
                best = min(((encoder._mergeable_ranks.get(x + y, rank), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
                if best[0] >= rank:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert parts == [raw(a), raw(b)]


def test_words_of_many_kinds():
    import random

    r = random.Random(4)
    wide, word = library_cached("byte_bpe_50k.json"), library_cached("word_bpe_49k.json")
    ids, counts = tokens.WordIds(public_tokenizers.path("word_bpe_49k.json")), tokens.UnitCounts(public_tokenizers.path("byte_bpe_50k.json"), {})
    letters = "abcdefghijklmnopqrstuvwxyzéèçÉßÀñüŁŒÿ0123456789'.,-!ABC_#|%"
    for _ in range(300):
        text = " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 14))) for _ in range(60))
        assert np.frombuffer(ids(text), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids
        assert counts(text) == len(wide.encode(text, add_special_tokens=False).ids)


ALPHABET = st.text(st.sampled_from(list(" \n\t'asdtrevml.,!19é ́İΣ\x1c日<|>")) | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_units_are_independent(text):
    wide, word = library_cached("byte_bpe_50k.json"), library_cached("word_bpe_49k.json")
    assert tokens.UnitCounts(public_tokenizers.path("byte_bpe_50k.json"), {" a": 1})(text) == len(wide.encode(text, add_special_tokens=False).ids)
    ids = np.frombuffer(tokens.WordIds(public_tokenizers.path("word_bpe_49k.json"))(text), "<u4").tolist()
    assert ids == word.encode(text, add_special_tokens=False).ids


_models = {}


def library_cached(name):
    return _models.setdefault(name, library(name))


def test_empty_table_and_extra_columns(make_docs, hard_rows):
    assert tokens.token_counts(make_docs([])).count() == 0
    assert packing.pack(make_docs([])).count() == 0
    extra = make_docs(hard_rows[:6]).withColumn("n_tokens", F.lit(1)).withColumn("ids", F.lit("x"))
    assert tokens.token_counts(extra).columns == ["doc_id", "n_bytes", "n_tokens"]
    assert packing.pack(extra).count() >= 6


def check_pack(rows, pieces, model, window=4096):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == {i for i, *_ in rows}
    for i, t, _ in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            own = np.frombuffer(p.ids, "<u4")
            assert p.start == at and p.length == len(own) and p.doc_tokens == len(ids)
            assert own.tolist() == ids[at : at + p.length]
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at & (at - 1) == 0 and at < window


def test_pack_round_trip(make_docs, hard_rows):
    check_pack(hard_rows, packing.pack(make_docs(hard_rows)).collect(), library("word_bpe_49k.json"))


def test_pack_is_repeatable_and_crc(make_docs, hard_rows):
    docs = make_docs(hard_rows, 2).cache()
    a = packing.pack(docs).withColumn("crc", F.crc32("ids")).collect()
    assert sorted(a) == sorted(packing.pack(docs).withColumn("crc", F.crc32("ids")).collect())
    assert all(r.crc == zlib.crc32(r.ids) for r in a)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_sum_of_squares_choice(sizes):
    """Each placement is the best of all by brute force."""
    packer, levels = packing.SumOfSquares(64), []
    for k, s in enumerate(sizes):
        before = sorted(levels)

        def cost(h, s=s):
            n = defaultdict(int)
            for x in before:
                n[x] += 1
            if h:
                n[h] -= 1
            if h + s < 64:
                n[h + s] += 1
            return sum(v * v for v in n.values())

        best = min(cost(h) for h in {0, *before} if h + s <= 64)
        packer.put(k, s)
        levels = [h for h, held in packer.open.items() for _ in held]
        assert sum(v * v for v in packer.count.tolist()) == best


def test_closing():
    assert packing.closing(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]
    assert packing.closing(0, 4096) == []
