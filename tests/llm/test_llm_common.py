import random

import numpy as np

from plume.llm import common as C


def test_words_over_64_kib_have_hashes_of_their_own():
    r = random.Random(1)
    word = bytes(r.choice(b"abcdefgh") for _ in range(200_000))
    variants = [word]
    for i, j in ((5, 5 + 65_536), (70, 70 + 131_072), (65_535, 65_536), (199_998, 199_999)):
        swapped = bytearray(word)
        swapped[i], swapped[j] = b"xy"
        variants.append(bytes(swapped))
        swapped[i], swapped[j] = b"yx"
        variants.append(bytes(swapped))
    variants += [word[:65_536], word[:65_537], word[:131_072], word[65_536:] + word[:65_536]]
    alone = [int(C.Words([v], C.SPACE_TABLE).hash[0]) for v in variants]
    assert len(set(alone)) == len(variants)
    together = C.Words([b" and ".join(variants), b"short " + word + b" tail"], C.SPACE_TABLE)
    assert together.hash[0:2 * len(variants):2].tolist() == alone
    assert int(together.hash[together.first[1] + 1]) == alone[0]


def test_short_words_hash_by_all_their_bytes():
    words = sorted({bytes(np.random.Generator(np.random.PCG64(i)).integers(97, 100, 1 + i % 6, dtype=np.uint8)) for i in range(2000)})
    assert len(set(C.Words([b" ".join(words)], C.SPACE_TABLE).hash.tolist())) == len(words)
