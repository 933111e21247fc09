"""The cache of token ids."""

import random

import pytest
from corvane.llm import token_ids

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_a_word_is_kept_once_and_bytes_have_the_library_s_letters():
    e = token_ids.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    e.ids("stra\u00dfe Stra\u00dfe zebra Zebra zebra")
    assert len(e.chunks) + len(getattr(e.chunks, "words", ())) == 4
    rnd = random.Random(4)
    letters = [chr(c) for c in range(0x21, 0x250) if not 0x7F <= c < 0xA0] + ["'s", "'ll", "<|", "7", "the", "ing"]
    for _ in range(3000):
        text = " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(4))
        assert e.ids(text) == token_ids.packed(e.tokenizer.encode(text, add_special_tokens=False).ids), ascii(text)
