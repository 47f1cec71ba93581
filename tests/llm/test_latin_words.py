"""Words of Latin-1 letters go to the tokenizer's model by their parts: the same ids as by the whole tokenizer."""

import random

import numpy as np

from tallyspark.llm import packing

ODD = ["don't", "we'll!'s", "'s", "x's's", "é's", "ÀÉÜ-ß", "ÿ", "Ÿx", "a×b÷c", "ª5º½²³", "µm", "\x85", "a\xa0b", "\x1c", "a\x1fb", "\x7f", "\xad", "<|endoftext|>", "<|startoftext|>é", "é", "İ", "ǅ", "ſ", "日本", "$$$", "12é34", "___", "\x00"]


def test_same_ids_as_the_tokenizer(monkeypatch):
    random.seed(3)
    letters = [chr(i) for i in range(0x21, 0x180)] + list("aeiounrst'") * 20
    words = ODD + ["".join(random.choices(letters, k=random.randint(1, 14))) for _ in range(30_000)]
    got, want = packing.Words(), packing.Words()
    encoded = got.encode(words)
    for w, ids in zip(words, encoded):
        parts = [np.array(want.model.encode(p.decode(), add_special_tokens=False).ids, "<u4").tobytes() for p in w.encode().split()]
        assert ids == b"".join(parts), ascii(w)


def test_the_tokenizer_reads_no_latin_word(monkeypatch):
    words = packing.Words()
    monkeypatch.setattr(words, "model", type("Only", (), {"model": words.model.model})())  # has no encode()
    assert len(words.encode(["zusch, éleauxè déjà $$$ don't"])[0]) >= 4 * 7


def test_parts_held_are_bounded():
    words = packing.Words(size=1000)
    for i in range(20):
        words.encode([" ".join(f"{chr(97 + i)}{k:x}q" for k in range(300))])
    assert len(words.parts) <= 1500 and len(words) + len(words.old) <= 2600
