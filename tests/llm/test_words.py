import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilframe.llm.tokens import WordEncoder

BITS = ["'", "'s", "'S", "'re", "'LL", "'ll", "'v", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\0", "a", "Ab", "zq", "1", "22", ".", "..", "é", "É", "ß", "×", "÷", "Þ", "ÿ", "²", "µ", "\xa0", "\x85", "　", " ", "中", "Σ", "İ", "é", "٣", "😀", "<", "<|endoftext|>"]


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_texts_that_are_cut_all_at_once_get_the_librarys_ids(name, spaces):
    rng = random.Random(11)
    texts = ["", *("".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(5000)), *("".join(rng.choices(BITS[:31], k=rng.randint(0, 30))) for _ in range(5000)), ""]
    enc = WordEncoder(public_tokenizers.path(name), spaces)
    ids, counts = enc.encode(texts)
    found = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]


def test_new_words_go_to_the_model_many_at_once():
    """Each new word was a text by itself, which took most of the time where words are rare."""
    enc = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    sent = []

    class Model:
        def encode_batch_fast(self, texts, **more):
            sent.append(len(texts))
            return model.encode_batch_fast(texts, **more)

    model, enc.model = enc.model, Model()
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'xyz' * (i // 676)}" for i in range(2000))
    ids, counts = enc.encode([text, text])
    assert sent == [20] and ids[: counts[0]].tolist() == enc.tok.encode(text, add_special_tokens=False).ids == ids[counts[0] :].tolist()
