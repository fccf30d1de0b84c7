import hashlib

import pytest
import sentencepiece
from odd import odd_rows
from pyspark.sql import functions as F

from fedframe.llm import queries
from fedframe.llm import sentencepiece_codec as S

MODEL = queries.tokenizer("piece_bpe_32k.model")
PLAIN = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_query_equals_library(spark, sf, texts):
    got = {r.doc_id: r for r in queries.op2_sentencepiece(spark, sf).collect()}
    for doc_id, text in texts:
        ids = PLAIN.encode(text)
        r = got[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(PLAIN.decode(ids).encode()).hexdigest()


def test_odd_rows_and_spans(odd, empty):
    rows = S.encode(odd, MODEL, keep=("lang",)).collect()
    by_ids = sorted(tuple(r.ids) for r in rows)
    assert by_ids == sorted(tuple(PLAIN.encode(r[1] or "")) for r in odd_rows())
    assert S.encode(empty, MODEL).count() == 0
    codec = S.codec(MODEL)
    alone = {tuple(i.tolist()): (b.tolist(), e.tolist()) for i, b, e in (next(codec.encode([r[1] or ""])) for r in odd_rows())}
    assert all((r.begins, r.ends) == alone[tuple(r.ids)] for r in rows)  # empty texts shift nothing in their group
    decoded = S.decode(S.encode(odd, MODEL), MODEL).collect()
    assert sorted(r.decoded for r in S.encode(odd, MODEL, decoded=True).collect()) == sorted(r.decoded for r in decoded)
    assert sorted(r.decoded for r in decoded) == sorted(PLAIN.decode(PLAIN.encode(r[1] or "")) for r in odd_rows())


@pytest.mark.parametrize("text", ["  two  spaces ", "a\nb\tc\x00d", "漢字 éß ▁ x", "🙂🙂", " "])
def test_spans_cover_the_text(text):
    codec = S.codec(MODEL)
    ((ids, begins, ends),) = codec.encode([text])
    assert ids.tolist() == PLAIN.encode(text)
    data = text.encode()
    assert ends[-1] == len(data) and begins[0] == 0
    assert b"".join(data[a:b] for a, b in zip(begins, ends, strict=True)) == data


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_character_maps(rule):
    """The compiled maps that the library has built in, by the library's own normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
        spec = pb.ModelProto()
        spec.ParseFromString(library.serialized_model_proto())
    except (AttributeError, RuntimeError) as e:
        pytest.skip(str(e))
    codec = S.Codec.__new__(S.Codec)
    n = spec.normalizer_spec
    codec.map = S.CharacterMap(n.precompiled_charsmap)
    codec.prefix, codec.squeeze, codec.escape, codec.suffix = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces, False
    for text in ["Hello  World ", "ﬁne Ⅷ ① ｆｕｌｌ", "ＡＢＣ　が ｶﾞ", "é à", " 　 x y​z", "", "   ", "plain"]:
        got, where = codec.normalise(text)
        assert got == library.normalize(text), (rule, text)
        assert len(where) == len(got.encode()) + 1 and all(a <= b for a, b in zip(where, where[1:], strict=False))
        assert where[-1] <= len(text.encode())


def test_columns_kept(odd):
    df = S.encode(odd, MODEL, keep=("ids", "lang")) if False else S.encode(odd.drop("ids"), MODEL, keep=("lang",))
    assert df.columns == ["doc_id", "lang", "ids", "begins", "ends"]
    assert df.where(F.size("ids") != F.size("begins")).count() == 0


def test_a_model_with_a_map_over_the_whole_table(spark, sf, texts, tmp_path):
    """The dealt model's pieces behind a compiled map: the walk over the map gives the library's ids for every text."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
        spec, model = pb.ModelProto(), pb.ModelProto()
        spec.ParseFromString(library.serialized_model_proto())
    except (AttributeError, RuntimeError) as e:
        pytest.skip(str(e))
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.CopyFrom(spec.normalizer_spec)
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    assert S.Codec(str(path)).map.units
    plain = sentencepiece.SentencePieceProcessor(model_file=str(path))
    got = {r.doc_id: r for r in queries.op2_sentencepiece(spark, sf, str(path)).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = plain.encode(text)
        r = got[doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_bytes_covered <= len(text.encode())
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids).encode()).hexdigest()
