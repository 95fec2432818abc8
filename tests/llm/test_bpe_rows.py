import random

import numpy as np

from homolith.llm import bpe

ODD = ["", "'", "a'", "'s it's", "x　", "　x", "a  b", "<|endoftext|>a<|endoftext|>", "\x01\x02a\x01", "é\xa0", "日本語　日本", "a\n\n b  ", "don't'", "  lead", " 123,456.7", " \x85x\x85"]


def test_new_fragments_of_many_texts_take_few_calls(monkeypatch):
    c, calls = bpe.Codec(bpe.default_path()), []
    batch = c.encode_batch
    c.encode_batch = lambda *a, **b: calls.append(1) or batch(*a, **b)
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghilmnorst", k=draw.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(draw.choices(words, k=40)) for _ in range(300)]
    want = c.tokenizer.encode_batch(texts, add_special_tokens=False)
    got = list(c.encode_all(texts))
    assert got == [np.array(w.ids, dtype="<u4").tobytes() for w in want]
    assert len(calls) < 30
    # A full cache goes on, with the same ids.
    monkeypatch.setattr(bpe, "CACHED", 50)
    monkeypatch.setattr(bpe, "TOGETHER", 1000)
    assert list(c.encode_all(texts)) == got and len(c.cache) <= 50


def test_odd_texts_in_rows():
    c, draw = bpe.Codec(bpe.default_path()), random.Random(5)
    texts = ODD * 2 + ["".join(draw.choices("ab'  \n\t　\x85\xa0é日🙂1,.<|>\x01\x00s", k=200)) for _ in range(500)]
    assert c.separator is not None
    for separator in (c.separator, None):
        c.cache, c.separator = {}, separator
        for t, ids, w in zip(texts, c.encode_all(texts), c.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids == np.array(w.ids, dtype="<u4").tobytes(), t
            assert c.decode(ids) == c.tokenizer.decode(w.ids, skip_special_tokens=False)
