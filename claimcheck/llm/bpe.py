"""Exact whole-text encoding with the tokenizers library, one call per distinct piece of text.

A text is cut only where a BPE pre-tokenizer of the supported kinds cuts anyway: before a run
of ASCII white space that follows something else, and between a letter and ASCII punctuation.
Distinct pieces of a step are encoded once and cached; a text's ids are its pieces' ids.
Pieces that are one blank and letters are encoded many at a time, as a text; the lengths of the
ids (byte-level vocabularies) or their word-end marks say where each piece's ids end, and where
these don't add up the pieces are encoded one by one. Texts with other white space (where a run may go on across a cut) and texts that hold one of
the vocabulary's added tokens (which a tokenizer finds before it cuts) are encoded whole.

The cache has two generations of bounded bytes. Pieces that are met again move to the younger
one; when that is full it becomes the older one, whose pieces go. So frequent pieces stay, and a
worker's memory does not grow with what it has read.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import from_parts, parts

#: Bytes of one generation of a worker's cache, a bound on memory and not on results.
CACHE_BYTES = 32 << 20
#: What a piece costs beside its text and its ids: two objects and a place in the dictionary.
PIECE_BYTES = 190
#: Text bytes encoded at once, and pieces that are joined to one text.
STEP = 2 << 20
JOINED = 500
PLAIN = r"^ \p{L}+$"
#: White space (or what an engine may take for it) beyond ASCII blanks.
OTHER_SPACE = "[\x1c-\x1f\x85\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"

_SPACE = "[\x1c-\x1f\x85\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT &= ~_LETTER
_PUNCT[0x30:0x3A] = False


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; ``name`` may be a path already."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of whole texts; ``end`` is appended to each."""

    _made: dict[tuple[str, int], Encoder] = {}

    @classmethod
    def of(cls, name: str, end: int) -> Encoder:
        """One per Python worker, so that its cache serves all tasks."""
        if (name, end) not in cls._made:
            cls._made[name, end] = cls(name, end)
        return cls._made[name, end]

    def __init__(self, name: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end = end
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = "|".join(re.escape(t) for t in added) or None
        self.kind = "H" if max(self.size, end + 1) <= 1 << 16 else "I"
        self._marks()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _marks(self) -> None:
        """By id: its bytes, or whether it ends a word; None where ids say neither."""
        model, self.bytes, self.closes = self.tokenizer.model, None, None
        names = sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        suffix = getattr(model, "end_of_word_suffix", None)
        marks = np.zeros(self.size, np.int32)
        if suffix:
            marks[[k for _, k in names]] = [name.endswith(suffix) for name, _ in names]
            self.closes = marks > 0
        elif type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None:
            marks[[k for _, k in names]] = [len(name) for name, _ in names]
            self.bytes = marks

    def _plain(self, pieces: list[str]) -> list[bytes]:
        """ids of pieces that are one blank and letters."""
        if self.bytes is None and self.closes is None:
            return self._whole(pieces)
        out: list[bytes] = []
        lots = [pieces[a : a + JOINED] for a in range(0, len(pieces), JOINED)]
        unit = array(self.kind).itemsize
        for lot, raw in zip(lots, self._whole(["".join(x) for x in lots])):
            ids = np.frombuffer(raw, f"<u{unit}")
            if self.closes is not None:
                cut = np.flatnonzero(self.closes[ids]) + 1
                good = len(cut) == len(lot) and cut[-1] == len(ids)
            else:
                want = np.cumsum([len(x.encode()) for x in lot])
                ends = np.cumsum(self.bytes[ids])
                cut = np.searchsorted(ends, want) + 1
                good = cut[-1] == len(ids) and bool((ends[cut - 1] == want).all())
            if good:
                cut = [0, *(cut * unit).tolist()]
                out += [raw[a:b] for a, b in zip(cut, cut[1:])]
            else:
                out += self._whole(lot)
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        kind = self.kind
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, names: list[str], ids: list[bytes]) -> None:
        self.young.update(zip(names, ids))
        self.held += sum(map(len, names)) + sum(map(len, ids)) + PIECE_BYTES * len(names)
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0

    def _ids(self, pieces: list[str], odd: list[int], plain: list[bool]) -> list[bytes]:
        """ids of each piece; those at ``odd`` are of no use and stay empty."""
        out = list(map(self.young.get, pieces))
        for k in odd:
            out[k] = b""
        missing = [k for k, x in enumerate(out) if x is None]
        again = [k for k in missing if pieces[k] in self.old]
        for k in again:
            out[k] = self.old[pieces[k]]
        missing = [k for k in missing if out[k] is None]
        for found, encode in (([k for k in missing if plain[k]], self._plain), ([k for k in missing if not plain[k]], self._whole)):
            for a in range(0, len(found), 10_000):
                some = found[a : a + 10_000]
                for k, x in zip(some, encode([pieces[k] for k in some])):
                    out[k] = x
        again += missing
        for a in range(0, len(again), 10_000):
            some = again[a : a + 10_000]
            self._keep([pieces[k] for k in some], [out[k] for k in some])
        return out

    def __call__(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets by row, ids as unsigned integers of 2 or 4 bytes, the end id included)."""
        offsets, data = parts(column)
        n = len(offsets) - 1
        first = np.zeros(len(data) + 1, bool)
        if len(data):
            space, letter = _SPACE[data], _LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            first[1:-1] = (space[1:] & ~space[:-1]) | (letter[:-1] & _PUNCT[data[1:]])
        first[offsets] = True
        bounds = np.flatnonzero(first).astype(np.int32) if len(data) else np.zeros(1, np.int32)
        pieces = from_parts(bounds, data).dictionary_encode()
        codes, distinct = np.asarray(pieces.indices, np.int32), pieces.dictionary
        at = np.searchsorted(bounds, offsets)
        odd = np.asarray(pc.match_substring_regex(distinct, OTHER_SPACE), bool)
        whole = np.zeros(n, bool)
        if odd.any():
            whole[np.searchsorted(at, np.flatnonzero(odd[codes]), "right") - 1] = True
        if self.added and n:
            whole |= np.asarray(pc.match_substring_regex(column, self.added), bool)
        plain = pc.match_substring_regex(distinct, PLAIN).to_pylist()
        ids = self._ids(distinct.to_pylist(), np.flatnonzero(odd).tolist(), plain)
        # the end and whole texts are pieces too
        ends = np.full(n, len(ids), np.int32)
        ids.append(array(self.kind, [self.end]).tobytes())
        if whole.any():
            rows = np.flatnonzero(whole)
            own = np.arange(len(ids), len(ids) + len(rows), dtype=np.int32)
            ids += self._whole(column.take(pa.array(rows)).to_pylist())
            kept = np.ones(len(codes), bool)
            for r in rows:
                kept[at[r] : at[r + 1]] = False
            at = np.concatenate([[0], np.cumsum(kept)])[at]
            codes = np.insert(codes[kept], at[rows], own)
            at = at + np.concatenate([[0], np.cumsum(whole)])
        codes = np.insert(codes, at[1:], ends)
        at = at + np.arange(n + 1)
        unit = array(self.kind).itemsize
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // unit
        flat = np.frombuffer(b"".join(ids), f"<u{unit}")
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
        out = table.take(pa.array(codes))
        return np.asarray(out.offsets, np.int64)[at], np.asarray(out.values)
