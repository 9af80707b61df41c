"""The codec with a model whose character map replaces characters: the given pieces with the library's own rules put in their place."""

import random

import pytest
import sentencepiece

from tickloom.llm import sentencepiece_codec as codec
from tickloom.llm.queries import PIECES

TEXTS = ["ｆｕｌｌ ｗｉｄｔｈ", "①② ﬁn ﬂow", "é Ⅷ ㌀", "é ạ̈", "½ ™ ﷺ", "ｶﾞｷﾞ ﾊﾟ", "한글 한", "tab\tnew\nline　wide space", "zero​width­", "😀 ①", "", " ", "  ａ  ", "\x00\x07", "ﷺ" * 300]


@pytest.fixture(scope="module", params=["nmt_nfkc", "nfkc_cf", "nmt_nfkc squeezed"])
def model(request, tmp_path_factory):
    proto_of = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto
    proto, rules = proto_of(), proto_of()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=request.param.split()[0]).serialized_model_proto())
    assert not proto.normalizer_spec.precompiled_charsmap and rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = request.param.endswith("squeezed")
    path = tmp_path_factory.mktemp("model") / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def test_whole_codec_matches_the_library(spark, model):
    lib, rng = sentencepiece.SentencePieceProcessor(model_file=model), random.Random(7)
    letters = "ab ｃｄ①②ﬁé́㌀½ｶﾞ한하 　 \t漢😀▁A"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    encoded = codec.encode(df, model)
    coded = codec.decode(encoded, model).select("doc_id", "ids", "begins", "ends", "decoded")
    got = {r.doc_id: r for r in coded.collect()}
    assert len(got) == len(texts) + 1 and got[-1].ids == lib.encode("", add_eos=True)
    for i, t in enumerate(texts):
        r, source = got[i], t.encode()
        assert r.ids == lib.encode(t, add_eos=True), t
        assert r.decoded == lib.decode(r.ids), t
        assert len(r.ids) == len(r.begins) == len(r.ends)
        assert all(0 <= a <= b <= len(source) for a, b in zip(r.begins, r.ends)) and r.begins == sorted(r.begins) and r.ends == sorted(r.ends), t


def test_spans_are_those_of_the_library_where_pieces_stand_for_whole_characters(model):
    lib, m = sentencepiece.SentencePieceProcessor(model_file=model), codec.Model(model)
    for t in ("ｆｕｌｌ ｗｉｄｔｈ", "plain words here", "ﬁn ﬂow", "Ⅷ and ①②"):
        proto = lib.encode(t, return_type="proto")
        (ids, begins, ends), = m.encode_all([t])
        assert ids.tolist()[:-1] == [p.id for p in proto.pieces]
        assert [(p.begin, p.end) for p in proto.pieces] == [(int(a), int(b)) for a, b in zip(begins[:-1], ends[:-1])], t
