"""Token ids of whole texts, against the tokenizer one text at a time."""

from random import Random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, normalizers

from partita.llm import packing


def encoded(encode, texts, most=packing.AT_ONCE):
    out = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["id", "text"])
    for b in packing.by_bytes([batch], most):
        ids, at = encode(b.column(1))
        out += [np.frombuffer(ids[lo:hi], "<u4").tolist() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def plainly(path, texts):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode((t or b"").decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(
    "text",
    [
        "J̌ ǰ ǰ H̱ Ę́",  # lower-case before composing is another text
        "<|ENDOFTEXT|> <|endoftext|>'s x<|endoftext|>Y̊.<|StartOfText|>",  # an added token has one spelling
        "it'S 'tis don't.'re l'été 12.5% (the) a≠b É.×,é!",
    ],
)
def test_cases_and_marks(text):
    path = packing.vocabulary_path()
    assert encoded(packing.Encoder(path), [text.encode()]) == plainly(path, [text.encode()])


@pytest.mark.parametrize("kept, most", [(packing.KEPT_WORDS, packing.AT_ONCE), (50, 100), (0, 1)])
def test_ids_are_the_tokenizers(monkeypatch, kept, most):
    monkeypatch.setattr(packing, "KEPT_WORDS", kept)
    path, random = packing.vocabulary_path(), Random(5)
    parts = [*"abstzJKTÉéßÿñ÷×í019.,;'!|<>#-_\n\t\x0b\x1c\x01\x85\xa0", "̌", "̸", "İ", "Σ", "中", "ᄀ", "ᅡ", "\U0001f600"]
    parts += ["'s", "'T", "'re", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "the ", "²", "٣", "﻿", " ", " ", "."]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))).encode() for _ in range(4000)]
    texts += [bytes(random.choices(b"aZ.\xc3\xa9\xe2\x80\xc3\x97 '1\xf0\x9f", k=random.randint(0, 8))) for _ in range(2000)]  # often not UTF-8
    texts += [b"ends in <|endof", b"text|> of the text before", None, b"", b"\xc3", b"\xa9.", b"<|endoftext|>" * 2000, b"q" * 5000]
    assert encoded(packing.Encoder(path), texts, most) == plainly(path, texts)


def test_other_rules_take_texts_whole(tmp_path):
    other = Tokenizer.from_file(packing.vocabulary_path())
    other.normalizer = normalizers.Sequence([normalizers.NFD()])
    other.save(path := str(tmp_path / "other.json"))
    texts = ["A café, it's\n12 <|endoftext|> J̌".encode(), b"", b"Two."]
    assert encoded(packing.Encoder(path), texts) == plainly(path, texts)


def test_words_of_letters_skip_the_rules():
    """The rules of the vocabulary cost three times the merges, so distinct words of letters do not go through them."""
    encode, random, seen = packing.Encoder(packing.vocabulary_path()), Random(7), []
    words = ["".join(random.choices("abcdefghijéñü", k=9)) for _ in range(3000)]

    class Counted:
        def encode_batch_fast(self, texts, **options):
            seen.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    plain, encode.tokenizer = encode.tokenizer, Counted()
    text = " ".join(w + random.choice(["", ".", ",", "!!", "$$$", " (x)"]) for w in words).encode()
    assert encoded(encode, [text]) == plainly(packing.vocabulary_path(), [text])
    assert len(seen) < 20
