"""Whole texts to token ids with the public tokenizers, through a bounded cache of word units.

The tokenizers used here cut a text into pieces that never hold a word's end and the white space
after it, so a text's ids are those of its units, one after the other: a run of white space and
the word behind it. Encoding each different unit once a worker is exact and much cheaper than
encoding running text. The cache has ``UNITS`` entries a worker process; units beyond it are
encoded each time they appear.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

#: Memory of the units that a worker process keeps, by an estimate of ``ENTRY`` bytes a unit beside its letters and ids.
CACHE_BYTES = 128 << 20
ENTRY = 200

#: White space to the tokenizers' patterns; Python's own class also has \x1c-\x1f.
_WS = r"\t-\r \x85\xa0  -     　"
_SPACED = re.compile(r"\s\s|\s\Z")
_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: The same units where no two white spaces are neighbours and none is last: at spaces and line ends.
_FAST = re.compile(r"[ \n]?[^ \n]+")
_WORDS = re.compile(f"[^{_WS}]+")
#: Units whose pieces are plain: one space or line end, Latin letters, ASCII signs but the apostrophe.
_PLAIN = re.compile(r"([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([!-&(-/:-@\[-`{-~]*)")
_ODD = re.compile(r"[\x1c-\x1f]")
_made: dict[str, Encoder] = {}
assert array("I").itemsize == 4 and sys.byteorder == "little"


def _space_units(text: str) -> list[str]:
    """Units of a tokenizer that joins one space to the word behind it."""
    return (_UNIT if _SPACED.search(text) else _FAST).findall(text)


def _word_units(text: str) -> list[str]:
    """Units of a tokenizer that drops white space and lower-cases."""
    units = _WORDS.findall(text) if _ODD.search(text) else text.split()
    return [x.lower() for x in units] if text.isascii() else units


def _byte_names() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, or
    else the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``ids`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str, units, lower: bool, special: bool = True, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.marks = {t.content: array("I", [i]).tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()} if special else {}
        self.at_marks = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None
        # what is left between the marks is ordinary text
        self.tokenizer.encode_special_tokens = True
        self.units, self.lower, self.cache, self.room = units, lower, {}, cache_bytes
        self.pieces: dict[str, bytes] = {}
        self.names = str.maketrans({chr(b): c for b, c in _byte_names().items()})

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, from the tokenizer's model."""
        got = self.pieces.get(piece)
        if got is None:
            raw = piece.encode().decode("latin-1").translate(self.names)
            got = array("I", [t.id for t in self.tokenizer.model.tokenize(raw)]).tobytes()
            if len(piece) < 4:  # signs and short words
                self.pieces[piece] = got
        return got

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units that the cache lacks.

        Plain units are cut here and go to the tokenizer's model, which is what takes the least time;
        all others go through the whole tokenizer.
        """
        new, rest = {}, []
        for u in units:
            m = _PLAIN.fullmatch(u)
            if not m:
                rest.append(u)
                continue
            sep, word, signs = m.groups()
            if self.lower:
                parts = self._piece(word.lower())
            elif sep == "\n":
                parts = self._piece(sep) + self._piece(word)
            else:
                parts = self._piece(sep + word)
            new[u] = parts + self._piece(signs) if signs else parts
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                new[u] = array("I", e.ids).tobytes()
        for u, x in new.items() if self.room > 0 else ():
            size = ENTRY + len(u) + len(x)
            if size <= 2 * ENTRY:
                self.cache[u] = x
                self.room -= size
        return new

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = self._ordinary(texts if not self.marks else [x if x and not any(m in x for m in self.marks) else None for x in texts])
        for k, text in enumerate(texts) if self.marks else ():
            if text and any(m in text for m in self.marks):
                parts = self.at_marks.split(text)  # ordinary text and marks by turns
                out[k] = b"".join(self.marks[x] if i % 2 else self._ordinary([x])[0] for i, x in enumerate(parts))
        return out

    def _ordinary(self, texts: list[str | None]) -> list[bytes]:
        get, units_of = self.cache.get, self.units
        out: list[list[bytes | None]] = []
        gaps: list[tuple[int, list[tuple[int, str]]]] = []
        for k, text in enumerate(texts):
            # a text's units are looked up once, while they are at hand
            units = units_of(text) if text else []
            found = list(map(get, units))
            if None in found:
                gaps.append((k, [(i, u) for i, (u, x) in enumerate(zip(units, found)) if x is None]))
            out.append(found)
        if gaps:
            new = self._learn({u for _, gap in gaps for _, u in gap})
            for k, gap in gaps:
                found = out[k]
                for i, u in gap:
                    found[i] = new[u]
        return list(map(b"".join, out))


def encoder(name: str, folder: str | None = None, special: bool = True, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """The encoder of a public tokenizer's file, one a worker process. ``folder``: where the files lie."""
    key = f"{folder}/{name}/{special}/{cache_bytes}"
    if key not in _made:
        if folder:
            file = os.path.join(folder, name)
        else:
            import public_tokenizers

            file = public_tokenizers.path(name)
        word = name.startswith("word_")
        _made[key] = Encoder(file, _word_units if word else _space_units, word, special, cache_bytes)
    return _made[key]
