import random
import re

import numpy as np
import pyarrow as pa

from palimpsest.llm import words as W


def test_split_hash_distinct():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\t\n\x0b\x0c\r 日\x1c\xa0") for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "x" * 300_000, " a"]
    for begin, end, data, offsets in W.text_chunks(pa.array(texts).slice(3), 2000):
        starts, ends, upto = W.split(data, offsets)
        codes, first = W.distinct(data, starts, ends)
        found = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
        assert len(first) == len(set(found)) and [found[i] for i in first[codes]] == found
        for i in range(begin, end):
            want = re.findall(r"[^\x20\x09-\x0D]+", texts[i + 3] or "")
            assert want == [w.decode() for w in found[upto[i - begin] : upto[i - begin + 1]]]


def test_rolling_is_a_function_of_the_words():
    h = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    both = W.rolling(np.concatenate([h, h[::-1], h]), 5)
    assert (both[:46] == both[100:146]).all() and len(set(both[:96].tolist())) == 96
    assert len(W.rolling(h, 51)) == 0
