import random

import numpy as np

from loomgraph.llm.chunks import Chunks


def test_forgets_rare_chunks():
    calls = []

    def encode(chunks):
        calls.extend(chunks)
        own = [[ord(c) for c in x] for x in chunks]
        return np.array([t for x in own for t in x], np.int32), np.array([len(x) for x in own])

    r = random.Random(2)
    cache = Chunks(encode, 30)
    for _ in range(60):
        texts = [[r.choice(["a", "bb", "ccc", f"rare{r.randint(0, 500)}", f"rare{r.randint(0, 500)}"]) for _ in range(r.randint(0, 9))] for _ in range(4)]
        ids, at = cache.ids(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[ord(c) for x in t for c in x] for t in texts]
    assert len(cache) < 70 and calls.count("a") == 1 and len(calls) > 40
    assert cache.ids([])[0].tolist() == []
