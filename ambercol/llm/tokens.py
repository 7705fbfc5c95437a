"""Whole-text encoding with the tokenizers library, faster by remembering the ids of pieces.

A byte-level BPE splits a text before each space or newline that follows a character which is no white space, and after the
letters of a word that a comma or full stop follows, whatever lies around them. So the piece between two such places has the same
ids in every text, and the library encodes each new piece once. Arrow cuts the texts and numbers their distinct pieces, and NumPy
strings the pieces' ids together, so that Python handles each distinct piece of a batch, not each word. Texts with longer runs of
white space, and texts that hold an added token of the vocabulary, are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that the tokenizer does not always cut before its last character, as it is assumed here.
_UNSAFE = re.compile(r"\s |[^\S\n]\n|\n\n(?:\s|\Z)")
_LONGEST = 64
#: Characters of the texts that are cut into pieces at once.
_AT_ONCE = 4_000_000


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``remembered`` bounds the pieces of each of two generations; an older generation goes when the younger one is full, and
    what goes is merely encoded again.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # a piece is encoded once, so the library's own memory of words is of no use
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)
        self.library.no_padding()
        self.library.no_truncation()
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.leads = np.zeros(self.size, bool)  # ids whose bytes begin with a space
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte_level = "ByteLevel" in str(self.library.pre_tokenizer) and self.library.normalizer is None
        for piece, i in vocabulary.items():
            self.leads[i] = byte_level and piece.startswith("Ġ")
        self.by_piece = False
        self.remembered = remembered
        self.old: dict[str, bytes] = {}
        self.marks, self.fixed = {}, {}
        if byte_level:
            newline, space, *marks = self._whole(["\n", " ", ",", "."])
            self.newline = np.frombuffer(newline, "<u4")
            self.marks = dict(zip(",.", marks))
            self.fixed = {"": space, "\n": newline}  # a space that ends a text; an empty line
            self.by_piece = len(newline) == 4
        self.young: dict[str, bytes] = dict(self.fixed)
        self.odd = set(self.fixed)  # pieces with white space at their end: their texts are looked at more closely

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], text: str, begins) -> None:
        """Encode new pieces strung together as ``text``; ``begins`` tells the ids with which a piece begins."""
        if not pieces:
            return
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(begins(ids))
        if len(at) != len(pieces):
            self.young.update(zip(pieces, self._whole([p if p[0] == "\n" else f" {p}" for p in pieces])))
            return
        raw, ends = ids.tobytes(), (np.append(at, len(ids)) * 4).tolist()
        self.young.update({p: raw[ends[k] : ends[k + 1]] for k, p in enumerate(pieces)})

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        if self.by_piece:
            plain = [i for i, t in enumerate(texts) if not t[:1].isspace() and not any(x in t for x in self.added)]
            while plain:
                size = np.cumsum([len(texts[i]) for i in plain])
                n = max(1, int(np.searchsorted(size, _AT_ONCE, "right")))
                for i, x in zip(plain[:n], self._by_piece([texts[i] for i in plain[:n]])):
                    out[i] = x
                plain = plain[n:]
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self._whole([texts[i] for i in rest])):
                out[i] = x
        return out

    def _by_piece(self, texts: list[str]) -> list[bytes | None]:
        """A piece is keyed by what follows its space; a line's first, and for that a text's first, by its newline and what follows."""
        cut = pc.split_pattern(pa.array([f"\n{t}".replace("\n", " \n")[1:] for t in texts], pa.string()), " ")
        coded = cut.flatten().dictionary_encode()
        # no piece has a space, so this is the list of them, made faster
        pieces = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ")
        which, bounds = coded.indices.to_numpy(), cut.offsets.to_numpy()
        self._know(pieces)
        ids = list(map(self.young.__getitem__, pieces))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        # the ids of all pieces in their order: the place within ``flat`` of each
        size = lengths[which]
        ends = np.cumsum(size)
        kind = np.int32 if max(ends[-1], len(flat)) < 1 << 30 else np.int64
        first = ((np.cumsum(lengths) - lengths)[which] - ends + size).astype(kind)
        raw, at = flat[np.arange(ends[-1], dtype=kind) + np.repeat(first, size)].tobytes(), (np.concatenate([[0], ends])[bounds] * 4).tolist()
        close = np.zeros(len(texts), bool)
        if odd := [k for k, p in enumerate(pieces) if p in self.odd]:
            flags = np.zeros(len(pieces), bool)
            flags[odd] = True
            close = np.logical_or.reduceat(flags[which], bounds[:-1])
        out = [None if close[k] and _UNSAFE.search(t) else raw[at[k] + 4 : at[k + 1]] for k, t in enumerate(texts)]
        if len(self.young) > self.remembered:
            self.old, self.young = {k: v for k, v in self.young.items() if len(k) < _LONGEST}, dict(self.fixed)
            self.odd = {p for p in self.odd if p in self.old or p in self.fixed}
        return out

    def _know(self, pieces: list[str]) -> None:
        """See that all pieces are in ``young``; what the library has not seen it encodes."""
        young, old = self.young, self.old
        spaced, lines, marked = {}, {}, []
        for p in pieces:
            if p in young:
                continue
            if (known := old.get(p)) is not None:
                young[p] = known
                continue
            stem = p
            if p[-1] in self.marks and p[-2:-1].isalpha():
                stem = p[:-1]
                marked.append(p)
                if stem in young:
                    continue
                if (known := old.get(stem)) is not None:
                    young[stem] = known
                    continue
            elif p[-1].isspace():
                self.odd.add(p)
            (lines if stem[0] == "\n" else spaced)[stem] = None
        self._learn(list(spaced), " " + " ".join(spaced), self.leads.__getitem__)
        self._learn(list(lines), "".join(lines), self.newline.__eq__)
        for p in marked:
            young[p] = young[p[:-1]] + self.marks[p[-1]]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = 400_000) -> Encoder:
    """One encoder for a Python worker and vocabulary file."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]
