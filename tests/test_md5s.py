import hashlib

import numpy as np

from weftline.functions.md5s import digests


def test_digests_are_those_of_hashlib():
    for length in (1, 9, 55, 56, 63, 64, 130):
        messages = np.random.default_rng(length).integers(0, 256, (5, length), dtype=np.uint8)
        want = [[int(hashlib.md5(m.tobytes()).hexdigest()[8 * j : 8 * j + 8], 16) for m in messages] for j in range(4)]
        assert digests(messages).tolist() == want
