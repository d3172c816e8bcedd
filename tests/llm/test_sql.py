"""SQL of repeated byte strings beside plain loops, over odd texts."""

import hashlib
import random
from collections import Counter

import duckdb
import pandas as pd

from pathloom.llm.oracles import ORACLES

WIDTH = 400


def test_sql_of_repeated_bytes():
    r = random.Random(1)
    p = "".join(r.choice("abcé🙂") for _ in range(500))
    texts = [None, "", "x" * 399, "x" * 400, "x" * 401, p, p, "z" + p + "y" + p, p[:300], p[200:] + "q" * 1000]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    own = [(t or "").encode() for t in texts]
    times = Counter(x[i : i + WIDTH] for x in own for i in range(len(x) - WIDTH + 1))
    want = []
    for doc_id, x in enumerate(own):
        gone = [False] * len(x)
        for i in range(len(x) - WIDTH + 1):
            if times[x[i : i + WIDTH]] > 1:
                gone[i : i + WIDTH] = [True] * WIDTH
        kept = bytes(v for v, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((doc_id, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest(), len(kept)))
    assert sorted(con.execute(ORACLES["op8_suffix_array"]).fetchall()) == want
