"""Words of the token store's encoder."""

import numpy as np

from docmill.llm import token_store


def test_words_in_any_case_are_kept_once():
    enc = token_store.WordEncoder(token_store.word_tokenizer_path())
    texts = ["One one ONE two, TWO, x1 X1", "IT'LL it'll 'LL No.1,A", "<|ENDOFTEXT|> A", "<|endoftext|> A", "ÀB ΑΣ İx Σ Á", "", "a\x1cB"]
    got = enc(texts)
    assert got == [np.array(enc.lib.encode(t, add_special_tokens=False).ids, enc.kind).tobytes() for t in texts]
    assert not {"One", "ONE", "TWO,", "X1", "IT'LL"} & set(enc.ids) and {"one", "two,", "x1"} <= set(enc.ids)
