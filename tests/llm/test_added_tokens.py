"""Texts that contain an added token's string have the ids of the unmodified library."""

import struct

import public_tokenizers
from tokenizers import Tokenizer

from ledgerlight.llm import tokenfile


def test_added_tokens_equal_library():
    tk, cache = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), tokenfile.ChunkCache()
    for t in ["a <|endoftext|> b", "x<|startoftext|>Y  <|endoftext|>", "<|endoftext|><|endoftext|>", "a <|ENDOFTEXT|> b", "<| endoftext|>", "<|endoftext|", "é <|startoftext|>\n中"]:
        want = tk.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(want)}I", cache.encode(t.encode()))) == want, t
    assert list(struct.unpack("<3I", cache.encode(b"a <|endoftext|> b"))) == [320, 49407, 321]


def test_chunks_of_every_kind_equal_the_library(monkeypatch):
    """Letters of either case and with marks, letters whose lower case lies elsewhere, signs, digits; with caches that turn over all the time."""
    monkeypatch.setattr(tokenfile, "CACHE", 5)
    monkeypatch.setattr(tokenfile, "PIECES", 3)
    chunks = "Word word word. WORD! It's it's 'tis ''s ... . ? 123 a1b2 Été été. ÉTÉ, İstanbul ȺȺbc Ⱥ. straße naïve? été 日本語 ﬁne x y ǅ ªº µm .,!? ͅa <|x|> \x7f \x85z".split(" ")
    cache, library = tokenfile.ChunkCache(), Tokenizer.from_file(tokenfile.VOCABULARY)
    texts = [*chunks, " ".join(chunks), " ".join(reversed(chunks)), "".join(chunks)] * 2
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert cache.encode(text.encode()) == b"".join(i.to_bytes(4, "little") for i in ids), text
