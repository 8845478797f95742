"""Words encoded one by one against the library over whole texts, and how often a form of a word reaches the library."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from tallyframe.llm.units import UnitEncoder  # noqa: E402

ODD = [
    "", " ", "\n", "Word", "word.\nWord, WORD!\tword;;\r\nword", "H̱ ẖ á. Á É̱", "İ İstanbul İ",
    "ΣΑΣ σας. ẞ ß STRASSE Straße", "don't DON'T we'll. 's 't.'s it's.", ".,a .,! a.,b a.́ a.̸",
    "Мир, МИР. Ӑ Ӑ", "ǅ Ǆ ǆ ŉ ǰ J̌", "ª º µ × ÷ café CAFÉ É!",
    "1.2 x1, 2x. a². 中文. ok", "a\x00b a \x00 b \x85x Y  Z", "a\x1cb \x1c A. ​B ﻿C", "# ### a### a.# <|endoftext|> END", "\U0001d400 \U00010400 \U00010428.",
    "one é̀ ẗ T̈ W̊. Y̊", "\n\nWord\n word \t", "A" * 300 + ". " + "a" * 300,
]


@pytest.mark.parametrize("together", [1, 4, len(ODD)])
def test_word_vocabulary_equals_the_library(together):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), UnitEncoder(path, False)
    texts = ODD + [" ".join(ODD)] + ODD[::-1]
    got = [x for at in range(0, len(texts), together) for x in encoder.encode(texts[at : at + together])]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("together", [1, 5])
def test_byte_vocabulary_equals_the_library(together):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), UnitEncoder(path, True)
    texts = ODD + ["a", " a", "a ", " ", "a b", "a  b", " a b c", "\na \nb"] + ODD[::-1]
    got = [x for at in range(0, len(texts), together) for x in encoder.encode(texts[at : at + together])]
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_forms_of_a_word_are_encoded_once(monkeypatch):
    encoder, asked = UnitEncoder(public_tokenizers.path("word_bpe_49k.json"), False), []
    plain = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text, *more: asked.append(text) or plain(text, *more))
    encoder.encode(["Quorn quorn, QUORN!\nQuorn.\nquorn;", "Āquorn Quorn: quorn"])
    assert sum(text.lower().count("quorn") for text in asked) == 2  # the word itself, and the one with another letter before it
