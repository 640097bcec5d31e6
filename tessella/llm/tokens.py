"""Exact tokenisation by units that no token crosses, with caches in the workers.

The texts' white space splits them into units.  The tokenizers here never make
a token that runs from a visible character into white space, so that the ids
of a text are those of its units in turn.  Each distinct unit is encoded once
and then looked up, in a cache of two generations.  Texts with the four control
characters that Python, but not the library, takes for white space go to the
library whole.

Units of ASCII and Latin letters that are not in the cache go to a faster
byte-pair encoder over the same merges.  It merges the adjacent pair whose
joined bytes have the lowest rank; as every token of a trained vocabulary is
what its own bytes encode to, these are the merges of the file.  All other
units go to the library.
"""

from __future__ import annotations

import json
import re
import struct
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices

#: A unit keeps its leading white space; trailing white space is a unit.
UNITS = re.compile(r"\s*\S+|\s+")
#: White space to Python, but not to the library.
ODD = re.compile("[\x1c-\x1f]")
#: Units whose letters, digits and case are beyond doubt: ASCII, and Latin letters that lower to one letter.
PLAIN = re.compile("[\t-\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017e]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-\u017e]+|[0-9]|[^\\sa-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u017e]+")
#: Ends of words and of units, in what the fast encoder reads; ODD keeps them out of units.
WORD_END, UNIT_END = "\x1f", "\x1e"
CACHE_UNITS = 150_000
CACHE_CHARS = 64


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _kept(key, make):
    """One object for each worker process, whatever way this module got there."""
    kept = sys.__dict__.setdefault("_tessella_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def tokenizer(path: str):
    def make():
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(path)
        out.no_truncation()
        out.no_padding()
        return out

    return _kept(("tokenizer", path), make)


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies:
    visible Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def fast_encoder(path: str):
    """The merges of a tokenizer file for the faster encoder, or None if the
    file has features that it lacks.  Ids are ranks in such files."""

    def make():
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, special = whole["model"], {t["content"] for t in whole["added_tokens"]}
        end = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return None
        chars = byte_of_char()

        def raw(token):
            marked = end and token.endswith(end)
            body = token[: -len(end)] if marked else token
            return bytes(chars[c] for c in body) + (WORD_END.encode() if marked else b"")

        ranks = {raw(t): n for t, n in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        if made != sorted(made) or len(made) + 256 * (1 + bool(end)) != len(ranks):
            return None
        import public_tokenizers

        pattern = f"[^{WORD_END}{UNIT_END}]*{WORD_END}|{UNIT_END}" if end else public_tokenizers.PATTERN
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special

    return _kept(("fast", path), make)


class Cache:
    """Two generations: what is not met again goes with the older one."""

    def __init__(self):
        self.young, self.old = {}, {}

    def add(self, made):
        self.young.update((u, x) for u, x in made.items() if len(u) <= CACHE_CHARS)
        if len(self.young) > CACHE_UNITS:
            self.young, self.old = {}, self.young

    def found(self, units):
        """The values of those units that are in the older generation, now young again."""
        out = {u: x for u in units if (x := self.old.get(u)) is not None}
        self.young.update(out)
        return out


class WordIds:
    """Ids of whole texts, as little-endian unsigned 32-bit integers, for a
    tokenizer that drops white space."""

    def __init__(self, path: str):
        self.model, self.cache, self.fast = tokenizer(path), _kept(("word ids", path), Cache), fast_encoder(path)
        self.stop = self.fast and self.fast[0].encode_ordinary(UNIT_END)[0]

    @staticmethod
    def packed(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if ODD.search(text):
            return self.packed(self.model.encode(text, add_special_tokens=False).ids)
        units, young = text.split(), self.cache.young
        found = [*map(young.get, units)]
        if None in found:
            made = self.made({u for u, x in zip(units, found) if x is None})
            found = [made[u] if x is None else x for u, x in zip(units, found)]
            self.cache.add(made)
        return b"".join(found)

    def made(self, new: set[str]) -> dict[str, bytes]:
        import numpy as np

        out = self.cache.found(new)
        new = [u for u in new if u not in out]
        if self.fast:
            encoder, special = self.fast
            plain = [u for u in new if PLAIN.fullmatch(u) and not any(x in u for x in special)]
            if plain:
                line = "".join([WORD_END.join([*WORDS.findall(u.lower()), UNIT_END]) for u in plain])
                ids = np.asarray(encoder.encode_ordinary(line), "<u4")
                raw, stops = ids.tobytes(), (np.flatnonzero(ids == self.stop) * 4).tolist()
                out.update((u, raw[a:b]) for u, a, b in zip(plain, [0, *(x + 4 for x in stops)], stops))
                new = [u for u in new if u not in out]
        if new:
            out.update((u, self.packed(e.ids)) for u, e in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False)))
        return out


class UnitCounts:
    """Token counts of whole texts for a byte-level tokenizer: a table of
    frequent units first, then the worker's cache, then an encoder."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.model, self.frequent, self.cache, self.fast = tokenizer(path), frequent, _kept(("unit counts", path), Cache), fast_encoder(path)

    def __call__(self, text: str) -> int:
        if ODD.search(text):
            return len(self.model.encode(text, add_special_tokens=False))
        units = UNITS.findall(text)
        found = [*map(self.frequent.get, units)]
        if None not in found:
            return sum(found)
        rare = [u for u, x in zip(units, found) if x is None]
        total, found = sum(filter(None, found)), [*map(self.cache.young.get, rare)]
        if None in found:
            made = self.made({u for u, x in zip(rare, found) if x is None})
            found = [made[u] if x is None else x for u, x in zip(rare, found)]
            self.cache.add(made)
        return total + sum(found)

    def made(self, new: set[str]) -> dict[str, int]:
        out = self.cache.found(new)
        new = [u for u in new if u not in out]
        if self.fast:
            encoder, special = self.fast
            one = encoder.encode_ordinary
            out.update((u, len(one(u))) for u in new if PLAIN.fullmatch(u) and not any(x in u for x in special))
            new = [u for u in new if u not in out]
        if new:
            out.update((u, len(e)) for u, e in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False)))
        return out


#: The table of frequent units: its size, and about how many documents it is drawn from.
TABLE_UNITS = 65_536
SAMPLE_DOCS = 2_048


def frequent_units(docs: DataFrame, id_col: str, text_col: str, path: str, units: int = TABLE_UNITS, sample: int = SAMPLE_DOCS) -> tuple[bytes, bytes]:
    """A compact table of the most frequent units of a sample: their UTF-8 forms,
    each with its byte length before it, and their token counts.

    The table only saves time: units outside it are encoded exactly.  The
    sample is drawn by a hash of the id and the text, so that rows which share an
    id (a null one, too) are not all drawn: ``sample`` documents on average.
    """
    import pyarrow as pa

    rows = docs.count()
    picked = docs.where(F.col(text_col).isNotNull() & (F.expr(f"pmod(xxhash64({id_col}, {text_col}, 5), {max(1, -(-rows // sample))})") == 0)).select(text_col)

    def count(batches):
        from collections import Counter

        total = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                total.update(u for u in UNITS.findall(text) if len(u) <= CACHE_CHARS)
        total = total.most_common(units)
        yield pa.record_batch([pa.array([u for u, _ in total], pa.string()), pa.array([n for _, n in total], pa.int64())], ["unit", "n"])

    top = picked.mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(units)
    names = [r.unit for r in top.select("unit", "n").collect()]
    made = tokenizer(path).encode_batch(names, add_special_tokens=False)
    pairs = [(u.encode(), len(e.ids)) for u, e in zip(names, made) if len(e.ids) < 256]
    return b"".join(struct.pack("<H", len(u)) + u for u, _ in pairs), bytes(n for _, n in pairs)


def unpacked(table: tuple[bytes, bytes]) -> dict[str, int]:
    blob, counts = table
    out, at = {}, 0
    for n in counts:
        size = struct.unpack_from("<H", blob, at)[0]
        out[blob[at + 2 : at + 2 + size].decode()] = n
        at += 2 + size
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), a row for each input row.

    Texts and the units that are looked up are not shuffled; the units of the
    bounded sample that the table is made from are, with their counts.

    Cases: a null or empty text has no bytes and no tokens; special strings
    count as the library counts them; repeated rows are counted each; an empty
    table gives an empty result; further columns are ignored.
    """
    import pyarrow as pa

    path = path or default_path("byte_bpe_50k.json")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, "doc_id", "text", path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        counts = UnitCounts(path, unpacked(table.value))
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array([counts(t) if t else 0 for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
