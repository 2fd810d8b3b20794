import numpy as np
import pytest

from corpusloom.llm import token_files as tf


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "a<|startoftext|>b  C", "x <|ENDOFTEXT|> y", "<|endoftext|><|startoftext|>", "plain Text only"])
def test_added_tokens_are_those_of_the_library(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tf.default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tf.WordEncoder(tf.default_tokenizer()).encode(text), "<u4").tolist() == want
