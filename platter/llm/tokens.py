"""Byte-level BPE token ids by the tokenizers library, each distinct unit of a worker's texts encoded once."""

from __future__ import annotations

import re
from codecs import charmap_decode
from functools import lru_cache

import numpy as np

# Units, and pieces between spaces, that a Python worker remembers; beyond that only those of the texts at hand.
REMEMBERED_UNITS = 400_000

# Unicode White_Space. The tokenizer splits texts at white space before it merges: a run of
# other characters takes one space before it along, the rest of the white space stands alone.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters that need no look at their category; words of other letters are encoded as any other unit.
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = re.compile(f" ?[{_LETTER}]+")
# A word and the full stops and commas after it, with white space behind; any other run; white space.
_UNITS = re.compile(
    f" ?[{_LETTER}]+(?=[.,]*(?:[{_SPACE}]|$))|[.,]+(?=[{_SPACE}]|$)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
# A word and the ASCII marks after it, which are two pre-tokens; an apostrophe could belong to a contraction.
_WORD_AND_MARKS = re.compile(f"([{_LETTER}]+)([!-&(-/:-@\\[-`{{-~]*)")
_ENDS_IN_SPACE = re.compile(f"[{_SPACE}]\\Z")
TEXTS_AT_ONCE = 250


def _byte_letters() -> str:
    """Byte-level BPE writes a byte as the Latin-1 character where that is visible, else as the next one from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return "".join(chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))


_BYTE_LETTERS = _byte_letters()


class _Uncut(Exception):
    """A piece that does not stand between two units."""


class _Units(dict):
    """Ids of units as they are asked for."""

    def __init__(self, owner: UnitEncoder):
        self.owner = owner

    def __missing__(self, unit: str) -> bytes:
        owner = self.owner
        ids = self[unit] = owner.word(unit) if owner.direct and _WORD.fullmatch(unit) else owner.plain(unit)
        return ids


class _Pieces(dict):
    """Ids of what stands between two spaces, with the space before it, as they are asked for. The key is without that space."""

    def __init__(self, owner: UnitEncoder):
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        owner = self.owner
        found = _WORD_AND_MARKS.fullmatch(piece) if owner.direct else None
        if found:
            word, marks = found.groups()
            ids = self[word] + owner.units[marks] if marks else owner.word(" " + word)
        elif not piece or _ENDS_IN_SPACE.search(piece):
            raise _Uncut
        else:
            ids = owner.by_units(" " + piece)
        self[piece] = ids
        return ids


class UnitEncoder:
    """Ids of whole texts, equal to `Tokenizer.encode(text, add_special_tokens=False)`.

    Strings of special tokens in a text are ordinary text, or with `markers` the tokens that the
    library by default takes them for: texts that hold any added token are left to it as a whole.
    """

    def __init__(self, path: str, markers: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [token.content for token in self.library.get_added_tokens_decoder().values()] if markers else []
        self.marked = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.id_bytes = [n.to_bytes(4, "little") for n in range(max(self.tokenizer.get_vocab().values()) + 1)]
        # A word is one pre-token, so the library's merges can be applied to it directly, and so are the marks after it.
        words = [" trial", "Trial", " l\u00e4nger", "\u00c9t\u00e9s"]
        self.direct = all(self.word(w) == self.plain(w) and self.plain(w + m) == self.word(w) + self.plain(m) for w in words for m in (".", ",!", "##_#"))
        self.units, self.pieces = _Units(self), _Pieces(self)

    def word(self, unit: str) -> bytes:
        id_bytes = self.id_bytes
        return b"".join([id_bytes[token.id] for token in self.merge(charmap_decode(unit.encode(), "strict", _BYTE_LETTERS)[0])])

    def plain(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def by_units(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, _UNITS.findall(text)))

    def _whole(self, text: str) -> bytes:
        """A space that follows a character other than white space begins a unit, so a text is cut there; if other white space
        stands before a space, the text is cut into units only."""
        if self.marked(text):
            return self._bytes(self.library.encode(text, add_special_tokens=False).ids)
        first, *between = text.split(" ")
        if not between:
            return self.by_units(text)
        last = between.pop()
        if _ENDS_IN_SPACE.search(first):
            return self.by_units(text)
        try:
            ids = b"".join(map(self.pieces.__getitem__, between))
        except _Uncut:
            return self.by_units(text)
        return self.by_units(first) + ids + self.by_units(" " + last)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[start : start + TEXTS_AT_ONCE]
            out += map(self._whole, some)
            for known in (self.units, self.pieces):
                if len(known) > REMEMBERED_UNITS:  # what these texts use is worth keeping
                    used = set().union(*(t.split(" ") if known is self.pieces else _UNITS.findall(t) for t in some))
                    kept = {u: known[u] for u in used & known.keys()}
                    known.clear()
                    known.update(kept)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path, markers=True)
