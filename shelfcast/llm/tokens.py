"""Token ids of whole texts from the tokenizers library, one library call for each distinct chunk.

A text is cut where no token of the given tokenizer can reach across, and each chunk is looked up in
a bounded cache of the worker process; unseen chunks go to the library. The ids are those of one
library call on the whole text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable
from itertools import islice

import numpy as np

ID = np.dtype("<u4")
CACHE_ENTRIES = 400_000
#: Chunks that stay between tasks, those met first; an idle worker then holds little.
KEPT_ENTRIES = 50_000
#: Longer chunks aren't kept.
CACHED_BYTES = 64
#: ASCII signs that end a run of letters in both tokenizers and need no look at their neighbours.
SIGNS = ".,;:!?#$%&*|"
#: White space, widely taken, before a space: the space then is no cutting point.
WIDE = re.compile(r"(?<=\S)(?= )")
DOUBLE = re.compile(rb"[\t-\r\x1c-\x20] ")
#: First bytes of white space beyond ASCII.
EXOTIC = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, the
    others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Chunks(dict):
    """Ids of chunks, as little-endian unsigned 32-bit bytes.

    `encode` takes any text; `encode_word` takes one run of letters (with the space before it, if
    any) that normalising leaves as it is.
    """

    def __init__(
        self, encode: Callable[[str], list[int]], encode_word: Callable[[str], list[int]], folds_case: bool
    ):
        self.encode, self.encode_word, self.folds_case = encode, encode_word, folds_case

    def __missing__(self, chunk: bytes) -> bytes:
        value = np.array(self.value(chunk), dtype=ID).tobytes()
        if len(chunk) <= CACHED_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = value
        return value

    def value(self, chunk: bytes) -> list[int]:
        """The ids, not kept."""
        text = chunk.decode()
        found = self._by_parts(chunk, text)
        return self.encode(text) if found is None else found

    def trim(self) -> None:
        """At the end of a task."""
        if len(self) > KEPT_ENTRIES:
            kept = dict(islice(self.items(), KEPT_ENTRIES))
            self.clear()
            self.update(kept)

    def _by_parts(self, chunk: bytes, text: str) -> list[int] | None:
        """A run of letters and the signs after it are separate words in either tokenizer."""
        core = text.rstrip(SIGNS)
        if not core.removeprefix(" ").isalpha():
            return None
        if len(core) < len(text):
            return self.value(core.encode()) + self.value(text[len(core) :].encode())
        if self.folds_case:
            low = chunk.lower().decode() if chunk.isascii() else "".join(c.lower() for c in text)
            if not (low.isascii() or unicodedata.is_normalized("NFC", text) and low.isalpha() and unicodedata.is_normalized("NFC", low)):
                return None
            if low != text:
                return self.value(low.encode())
        return self.encode_word(text)


class WordChunks(Chunks):
    """For tokenizers that drop white space: chunks lie between ASCII white space."""

    def text_ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


class SpaceChunks(Chunks):
    """For byte-level tokenizers that bind one space to the word after it: a cut before each space
    that follows anything but white space."""

    def chunk_list(self, text: bytes) -> list[bytes]:
        odd = text[:1] == b" " or DOUBLE.search(text)
        if odd or not text.isascii() and any(x in text for x in EXOTIC):
            return [x.encode() for x in WIDE.split(text.decode())]
        first, *rest = text.split(b" ")
        return [first, *(b" " + x for x in rest)]

    def text_ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, self.chunk_list(text))) if text else b""


def load_library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def drops_space(path: str) -> bool:
    """Whether the tokenizer file drops white space between words (else it must be byte-level)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["normalizer"] is None:
        return False
    return True


_ENCODERS: dict[str, Chunks] = {}


def library_encoder(path: str) -> Chunks:
    """The worker's encoder of a tokenizer file of one of the two kinds above."""
    if path not in _ENCODERS:
        library = load_library(path)
        tokenize, letters = library.model.tokenize, byte_letters()
        kind = WordChunks if drops_space(path) else SpaceChunks

        def encode(text: str) -> list[int]:
            return library.encode(text, add_special_tokens=False).ids

        def encode_word(word: str) -> list[int]:  # the library's merges alone
            plain = word if word.isascii() and word[:1] != " " else "".join([letters[b] for b in word.encode()])
            return [t.id for t in tokenize(plain)]

        _ENCODERS[path] = kind(encode, encode_word, kind is WordChunks)
    return _ENCODERS[path]
