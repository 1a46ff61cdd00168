"""Every bit of a code is a decision that is predicted and mixed; none is only counted."""

import numpy as np

from tests.llm.test_lm_score import _chunk


def test_all_bits_of_a_code_are_mixed():
    coded, words, codes, lens, texts, letters = _chunk()
    assert max(lens) == 22 and not coded.plain.any()
    for n, text in enumerate(texts):
        token, bit, *_ = coded.decisions(coded.starts[n] + np.arange(len(text)), np.full(len(text), n))
        for t, w in enumerate(text):
            spelled = [] if lens[w] else [*words[w], 256]
            want = format(codes[w], f"0{lens[w]}b") if lens[w] else "0"
            want += "".join(format(int(letters[0][c]), f"0{letters[1][c]}b") for c in spelled)
            assert "".join(map(str, bit[token == t])) == want
