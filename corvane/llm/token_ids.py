"""Token ids of whole texts with a public tokenizer, by cached white-space chunks.

The tokenizer's pre-tokenizer never joins text across white space, so the ids of a text are those of
its white-space separated chunks in order. A worker keeps the ids of chunks and of words it has met,
in one cache of bounded size, and asks the library only for new ones: plain Latin chunks are cut into the
pre-tokenizer's words and go to the library's BPE model word by word, all other chunks go through the
whole library pipeline. Texts with the control characters U+001C to U+001F, which Python counts as
white space and the tokenizer does not, go through the library as a whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import cache

#: The pre-tokenizer's words, for chunks of printable ASCII and Latin-1 letters in lower case.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: entries of the cache, after which it starts anew
LIMIT = 800_000


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Chunks(dict):
    """The ids of chunks and of pre-tokenizer's words in lower case: such a word is a chunk of the same ids, and is kept once."""

    def __init__(self, tokenizer, plain: bool):
        self.tokenizer, self.model, self.plain, self.letters = tokenizer, tokenizer.model, plain, byte_letters()

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if len(self) >= LIMIT:
            self.clear()
        self[chunk] = ids
        return ids

    def word(self, word: str) -> bytes:
        ids = self.get(word)
        if ids is None:
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = self.keep(word, packed([t.id for t in self.model.tokenize(mapped)]))
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if self.plain and chunk.isascii() and chunk.isalpha():
            low = chunk.lower()
            return self.word(low) if low == chunk else self.keep(chunk, self.word(low))
        if self.plain and PLAIN.fullmatch(chunk) and "<|" not in chunk:
            found = WORDS.findall(chunk.lower())
            return self.word(chunk) if found[0] == chunk else self.keep(chunk, b"".join([self.word(w) for w in found]))
        return self.keep(chunk, packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids))


class ChunkEncoder:
    """ids(text): the text's token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        patterns = json.dumps([parts["normalizer"], parts["pre_tokenizer"]])
        # the short way for plain chunks holds for this pre-tokenizer alone: lower case, and letters, digits, others apart
        known = all(x in patterns for x in ("NFC", "Lowercase", "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+", "ByteLevel"))
        self.chunks = _Chunks(self.tokenizer, known)
        self.by_chunk = known

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or ODD_SPACE.search(text):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.split()))


@cache
def encoder(path: str) -> ChunkEncoder:
    """One for each worker process, kept from task to task."""
    return ChunkEncoder(path)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
