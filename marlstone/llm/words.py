"""Words of UTF-8 texts by a byte table: A-Z lower-cased, separators blanked, then split."""

from __future__ import annotations

#: Bytes of text that are held as words at a time.
PIECE_BYTES = 1 << 20

#: Digits, letters and all bytes of other characters stay; A-Z become a-z, the rest blanks.
TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def word_pieces(text: bytes, limit: int = PIECE_BYTES):
    """The words of ``text`` in order, as lists of the words of about ``limit`` bytes.

    No word is cut: a piece ends at a separator, and grows where a word is longer.
    """
    at = 0
    while at < len(text):
        size = limit
        while True:
            piece = text[at : at + size].translate(TABLE)
            stop = len(piece) if at + size >= len(text) else piece.rfind(b" ")
            if stop >= 0:
                break
            size *= 2
        yield piece[:stop].split()
        at += stop + 1
