import random

import numpy as np
import pyarrow as pa
import pytest

from tallyard.llm import tokens

ODD = ["", None, " ", "  ", "\n", "a", " a", "a ", "a\n\n b  c\n", "\t tab nb ls", "<|endoftext|> x <|endoftext|>", "don't I'll  'tis", "café café ﬁ Å",
       "日本語 テキスト です", "a\r\nb", "x" * 300 + " y", "<s> </s> <unk>", "e ́x", "1234 5 67.8!!", "\U0001f600 \U0001f468‍\U0001f469", "a\x00 b", "a b c", "a b\nc\nd", "İ ΣΣ x"]


def texts(n=1500, seed=3):
    r = random.Random(seed)
    alphabet = ["the", "The", "é", "ß", " ", " a", "\n", "b\n", "'", "s", ".", "!!", "12", "x", "́", "|", "ing", "日本", "  ", "\t", "<|endoftext|>", "▁"]
    return ODD + ["".join(r.choice(alphabet[: r.choice([8, 18, len(alphabet)])]) for _ in range(r.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 3000)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    monkeypatch.setattr(tokens, "KEEP_WORDS", 100)
    e = tokens.IdEncoder(name)
    assert e.spaced or e.bare
    ts = texts()
    ids, borders = e.encode(pa.array(ts))
    for t, a, b in zip(ts, borders, borders[1:]):
        assert ids[a:b].tolist() == e.tok.encode(t or "", add_special_tokens=False).ids, repr(t)
    ids, borders = e.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and borders.tolist() == [0]
    assert np.diff(e.encode(pa.array([None, ""], pa.string()))[1]).tolist() == [0, 0]


def test_counts():
    c = tokens.Counter("piece_bpe_32k.model")
    assert c.count(pa.array(["", None, "a b"])) == [0, 0, len(c.sp.encode("a b"))]
