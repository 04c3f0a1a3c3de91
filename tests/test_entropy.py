"""Character entropy takes one pass over a text, however many different characters it has."""

import math
import time
from collections import Counter

from packetloom.operators import behavior as bh


def test_entropy_of_odd_texts(spark):
    wide = "".join(map(chr, range(0x4E00, 0x9E00))) * 12 + "\U0001F600"  # 20,480 different characters and one beyond 16 bits
    texts = {1: "aab", 2: "x" * 9, 3: "naïve \U0001F600\n\t\x00", 4: wide}
    df = spark.createDataFrame([*texts.items(), (5, ""), (6, None)], "k int, t string")
    began = time.monotonic()
    got = {row.k: row.entropy for row in bh.string_entropy(df, "k", "t").collect()}
    assert time.monotonic() - began < 30
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        want = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
        assert abs(got[k] - want) < 1e-4
