"""Tokenizing whole texts fast: the tokenizers library with a word memo.

A text is cut before a space that a letter, digit or other visible ASCII
character follows (byte-level vocabulary), or at single spaces and line ends
(word vocabulary, which drops white space). Both pre-tokenizers always end a
pre-token there, so the pieces' ids, joined, are the ids of the whole text.
Pieces repeat a lot in natural text, and a worker keeps their packed ids. A
new piece is cut again where letters meet other characters, another end of a
pre-token; the library's model encodes a run of letters, the whole library
anything else. What these cuts do not hold for (contractions, special tokens,
composing marks, odd spacing) is encoded whole. Words of letters are kept as
they come while there is much room, then, as anything else that runs can be put
together for, once they come again: most new pieces never do.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from array import array

import numpy as np

#: A worker keeps at most so many pieces, and so many runs that stand behind no
#: space; others are encoded each time. While there are fewer than MEMO_OPEN,
#: words of letters are kept as they come.
MEMO_PIECES = 900_000
MEMO_RUNS = 100_000
MEMO_OPEN = 350_000
#: Longer ones are not kept: text without spaces has pieces of any length.
MEMO_CHARS = 64
#: Slots, by hash, for what came once.
SEEN_SLOTS = 1 << 22
_VISIBLE = re.compile(r"[\w!-~]")
_ODD_PIECE = re.compile(r"'|<\||\s\s")
_RUNS = re.compile(r"[^\W\d_]+|[\W\d_]+")
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes for themselves, the others in order from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return "".join(chr(b) if b in printable else chr(0x100 + others.index(b)) for b in range(256))


class Encoder:
    """Texts to packed little-endian unsigned 32-bit ids.

    ``kind`` is "byte" for a byte-level vocabulary, whose pre-tokens may start
    with one space, and "word" for one that drops white space and case.
    """

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.byte = kind == "byte"
        self.space = " " if self.byte else ""
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {} if self.byte else {"": b""}
        # Pieces stand behind a space; where there is none, runs are pieces too.
        self.runs: dict[str, bytes] = {} if self.byte else self.memo
        self.seen = bytearray(SEEN_SLOTS)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """The words to look up. For a byte-level vocabulary each but the
        first stands behind one space."""
        if self.byte:
            return text.split(" ")
        # Case goes anyway, letter by letter: only these two depend on more, and special tokens keep theirs.
        if "<|" not in text and "\u03a3" not in text and "\u0130" not in text:
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def keep(self, word: str, space: str, found: bytes, at_once: bool) -> bytes:
        """``found``, which is kept if the word is open to be and there is
        room."""
        memo, most = (self.memo, MEMO_PIECES) if space == self.space else (self.runs, MEMO_RUNS)
        n = len(memo)
        if n < most and len(word) <= MEMO_CHARS:
            slot = hash(word) % SEEN_SLOTS
            if self.seen[slot] or (at_once and n < MEMO_OPEN):
                memo[word] = found
            else:
                self.seen[slot] = 1
        return found

    def run(self, text: str, space: str) -> bytes:
        """A run of letters or of other characters, behind ``space``."""
        found = (self.memo if space == self.space else self.runs).get(text)
        if found is not None:
            return found
        if text.isalpha() and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text)):
            # Latin letters have one lower case each and are composed, but for the dotted I.
            shown = text if self.byte else text.lower()
            if not shown.isascii():
                shown = codecs.charmap_decode(shown.encode(), "strict", self.letters)[0]
            found = array("I", [t.id for t in self.tokenize("\u0120" + shown if space else shown)]).tobytes()
        else:
            found = self.whole(space + text)
        return self.keep(text, space, found, True)

    def piece(self, word: str, space: str) -> bytes:
        """A piece that is not kept yet."""
        if word.isalpha():
            return self.run(word, space)
        ascii_only = word.isascii()
        plain = ascii_only or ("\u0130" not in word and unicodedata.is_normalized("NFC", word))
        runs = _RUNS.findall(word) if plain and not _ODD_PIECE.search(word) else []
        if not runs or (not ascii_only and any(r[0].isalnum() and not (r.isalpha() or r[0].isdecimal()) for r in runs)):
            return self.keep(word, space, self.whole(space + word), True)
        if len(runs) == 1:
            return self.run(word, space)
        return self.keep(word, space, self.run(runs[0], space) + b"".join([self.run(r, "") for r in runs[1:]]), False)

    def encode(self, text: str) -> bytes:
        get = self.memo.get
        words = self.pieces(text)
        first = b""
        if self.byte:
            first = self.piece(words[0], "") if words[0] else b""
            words = words[1:]
        found = list(map(get, words))
        j = -1
        try:
            while True:
                j = found.index(None, j + 1)
                w = words[j]
                v = get(w)
                if v is None:
                    # No kept piece is empty or begins with what may be white space, so such spacing shows here.
                    if self.byte and not ("!" <= w < "\x7f" or _VISIBLE.match(w)):
                        return self.whole(text)
                    v = self.piece(w, self.space)
                found[j] = v
        except ValueError:  # none is left
            return first + b"".join(found)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode(t) if t else b"" for t in texts]


def release() -> None:
    """Give back what this worker keeps: the next stage, of another operator,
    runs in the same process."""
    _ENCODERS.clear()


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
