"""Terms of a text: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

from zlib import crc32

#: Each byte to itself, A-Z to a-z, separators to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def coordinate(term: bytes) -> int:
    """A 32-bit hash."""
    return crc32(term)
