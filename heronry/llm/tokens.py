"""Token ids by the ``tokenizers`` library, computed once for each *distinct* piece of text.

Byte-pair merges never cross a pre-token, so a text may be cut wherever a pre-token is sure to
end; the ids of a cut are remembered, and a text is then a join of remembered byte strings.
Cuts of plain Latin letters, digits and punctuation go straight to the library's model, past its
general normaliser and splitter, which for them have a known outcome; all others go through
the whole library, as do whole texts that hold an added token such as an end mark. Ids are little-endian unsigned 32-bit bytes throughout: lengths and
checksums need no Python integers.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import islice

#: Remembered pieces a worker keeps. Beyond it the first half stays, as frequent pieces are met
#: early, and the rest is learned again when needed; no result depends on it.
REMEMBERED = 500_000
#: Longer pieces are not remembered, so what a worker keeps is bounded in bytes as well.
LONGEST_KEPT = 64

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Printable ASCII and the accented letters of Latin-1: here both libraries' classes are certain.
_plain = re.compile(f"[\n -~{_LETTERS}]+").fullmatch
_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+").findall
_bytes = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+").findall
#: Most pieces: a word, and marks after it other than apostrophes, told on bytes (two of them for a letter of Latin-1).
_MARKS = rb"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_accented_and_marks = re.compile(rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)?").fullmatch
_packers = [struct.Struct(f"<{n}I").pack for n in range(64)]
_spaced = re.compile(r"\s\s|[^\S \n]|\x01").search
#: Control bytes, and the first bytes of all characters beyond ASCII that are white space.
_DOUBTFUL = bytes([*range(10), *range(11, 32), 0xC2, 0xE1, 0xE2, 0xE3])


def _not_simple(data: bytes, text: str) -> bool:
    """Whether white space other than single blanks and line feeds may be in a text."""
    if b"  " in data or b"\n\n" in data or b" \n" in data or b"\n " in data:
        return True
    return len(data.translate(None, _DOUBTFUL)) < len(data) and bool(_spaced(text))


_loaded: dict[str, "TokenBytes"] = {}


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a visible letter: itself if visible, else 256, 257, ..."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenBytes(dict):
    """Piece -> id bytes. For a vocabulary with word ends, white space only separates pieces."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.marker = os.path.commonprefix(added)  # of all tokens that the library finds in a text before splitting it
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.tokenize = self.tok.model.tokenize
        self.words = "</w>" in (self.tok.model.end_of_word_suffix or "")
        self.letters = byte_letters()
        self.blank = self.letters[ord(" ")]

    def _packed(self, letters: str) -> bytes:
        ids = [t.id for t in self.tokenize(letters)]
        return _packers[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, letters: bytes) -> bytes:
        return self._packed(letters.decode("latin-1").translate(self.letters))

    def _ids(self, piece: bytes) -> bytes:
        core = piece.rstrip(_MARKS)
        bare = core[1:] if core[:1] == b" " else core
        if bare.isalpha():  # of bytes: A-Z and a-z alone
            if len(core) < len(piece):
                return self[core] + self[piece[len(core) :]]
            if self.words:
                return self._packed(bare.lower().decode())
            return self._packed(bare.decode() if bare is core else self.blank + bare.decode())
        quick = None if self.words else _accented_and_marks(piece)
        if quick:
            word, marks = quick.groups()
            return self[word] + self[marks] if marks else self._word(word)
        text = piece.decode("utf-8", "replace")
        if not _plain(text):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = _words(text.lower()) if self.words else _bytes(text)
        if len(parts) == 1:
            return self._word(parts[0].encode())
        return b"".join([self[p.encode()] for p in parts])

    def __missing__(self, piece: bytes) -> bytes:
        ids = self._ids(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids

    def cut(self, text: str) -> list[bytes]:
        """Pieces whose ids, one after the other, are the ids of the text.

        Without word ends, a cut is made before a blank and around a line feed, and only in
        texts without neighbouring white space, where each such place starts a pre-token
        whatever stands before it; any other text stays whole.
        """
        data = text.encode("utf-8", "replace")
        if self.words:
            return data.split()
        if _not_simple(data, text):
            return [data]
        return [p for p in data.replace(b" ", b"\x01 ").replace(b"\n", b"\x01\n\x01").split(b"\x01") if p]

    def encode(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            kept = list(islice(self.items(), REMEMBERED // 2))
            self.clear()
            self.update(kept)
        if self.added and self.marker in text and self.added.search(text):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.__getitem__, self.cut(text)))


def load(path: str) -> TokenBytes:
    """One encoder for each path and Python worker."""
    if path not in _loaded:
        _loaded[path] = TokenBytes(path)
    return _loaded[path]
