"""Columns whose names clash, repeated rows, null ids, empty tables and a long text give what the bare table gives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tickloom.llm import license_scan, packing, quality, sentencepiece_codec

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
NAMES = ("ids", "begins", "ends", "decoded", "kept", "base_failed", "n_words", "content_words", "spans", "found", "sequence_id", "offset", "piece", "held_out", "licenses", "matches", "n_matches", "word", "form", "root", "n", "near", "component_id", "n_shingles", "h", "k", "key", "x", "y", "t")
OPERATORS = {
    "sentencepiece": lambda d: sentencepiece_codec.decode(sentencepiece_codec.encode(d, PIECES), PIECES), "quality": lambda d: quality.judge(d, quality.DEFAULT),
    "licenses": license_scan.scan, "packing": lambda d: packing.pack(d, BYTES).drop("sequence_id", "offset"),
}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = [a + b for a in ("ba", "ce", "di", "fo", "gu", "lo") for b in ("ran", "ten", "mi", "po", "sul", "x")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(230_000)
    assert len(long) > 1_000_000
    texts = [prose(70), prose(70), None, "", " \n", "one", long, "Licensed under the MIT License. " + prose(60), "token = 'abcDEF12345678' " + prose(60)]
    out = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(texts)]
    return [*out, out[0], out[7], (None, texts[7], None)]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names(spark, rows, name):
    bare = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    more = bare.withColumns({c: F.lit("clash") for c in NAMES})
    run = OPERATORS[name]
    said = lambda df: Counter(map(str, df.select(sorted(c for c in run(bare.limit(0)).columns)).collect()))
    want, got = said(run(bare)), said(run(more))
    assert got == want and sum(want.values()) > 0
    assert run(more.limit(0)).count() == 0
