"""Texts of many megabytes stay within a worker's memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tickloom.llm import lang_id


def test_language_of_a_long_text_in_many_letters():
    rng = random.Random(1)
    long = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(6_700_000))  # 20 MB
    models = {k: v / np.linalg.norm(v) for k, v in ((k, np.random.default_rng(i).standard_normal(lang_id.DIM)) for i, k in enumerate("ab"))}
    run = lang_id.judge(models)
    run(pa.array(["warm"]))
    column = pa.array([long])
    tracemalloc.start()
    (pred,), (score,) = run(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pred in models and 0 <= score <= 1 and peak < 500e6


def test_parts_sum_to_the_whole():
    texts = ["a plain text", "Ünïcode " * 400, "".join(chr(0x4E00 + i) for i in range(9000))]
    models = {k: np.random.default_rng(i).standard_normal(lang_id.DIM) for i, k in enumerate("abc")}
    pred, score = lang_id.judge(models)(pa.array(texts))
    for text, p, s in zip(lang_id.trigrams(pa.array(texts)), pred, score):
        v = text[1].astype(float) @ lang_id.bound(text[0], lang_id.DIM).astype(float)
        cos = {k: float(v @ m) / np.linalg.norm(v) for k, m in models.items()}
        best = max(cos, key=cos.get)
        assert p == best and abs(s - min(1.0, max(0.0, cos[best]))) < 1e-4
