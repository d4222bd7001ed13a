import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tickspark.llm import queries, sentencepiece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(texts):
    codec = sentencepiece_codec.model(PATH)
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == LIB.encode(text), text
        assert sentencepiece_codec.piece_bytes(PATH).decode(ids.tolist()) == LIB.decode(ids.tolist()) == text.replace("▁", " "), text


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a ", "a  b   c    d     e", "▁", "▁▁x▁y", "\n\n\t\r", "漢字 éß 😀 \x00 x", "<s></s><0x41><unk>", "a" * 3000, "ab" * 999, "aaa aaaa aaaaa", " " * 99 + "x"])
def test_equals_library(text):
    check([text])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("  \n▁aehtinonsrd.,0123éß漢😀<|>!"), max_size=50), max_size=6))
def test_equals_library_on_random_batches(texts):
    check(texts)


def test_query_equals_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIB.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.round_trip) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True)


def test_nulls_repeats_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "the the", "y"), (2, "", None)], "doc_id long, text string, ids string")
    out = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(df, PATH), PATH)
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in out.collect()) == [(0, LIB.encode("the the"), "the the"), (1, [], ""), (1, [], ""), (2, [], "")]
    both = sentencepiece_codec.encode_and_decode(df, PATH)
    assert sorted(map(repr, both.select("doc_id", "ids", "decoded").collect())) == sorted(map(repr, out.select("doc_id", "ids", "decoded").collect()))
    assert sentencepiece_codec.encode_documents(df.where("false"), PATH).count() == 0


def test_cache_keeps_no_long_chunk_and_few_bytes(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "INDEX_CHARS", 500)
    monkeypatch.setattr(sentencepiece_codec, "CACHE_BYTES", 20_000, raising=False)
    codec = sentencepiece_codec.PieceModel(PATH)
    for k in range(12):
        texts = [f"{chr(0x4E00 + 7 * k + i)}漢字é{i}" * 60 for i in range(6)] + [" ".join(f"w{k}x{i}" for i in range(100))]
        for text, ids in zip(texts, codec.encode(texts)):
            assert ids.tolist() == LIB.encode(text)
        assert max(map(len, codec.chunks)) <= sentencepiece_codec.CACHE_LENGTH
        assert len(codec.chunks) <= 400


def test_other_kinds_of_models_are_refused(tmp_path):
    sentencepiece_codec.check_model(PATH)
    trainer = lambda kind: b"\x12\x02\x18" + bytes([kind])  # noqa: E731  field 2 with field 3
    normaliser = lambda name, *flags: b"\x1a" + bytes([2 + len(name) + len(flags)]) + b"\x0a" + bytes([len(name)]) + name + bytes(flags)
    plain = normaliser(b"identity", 0x18, 1, 0x20, 0)
    for model, fault in ((trainer(1) + plain, "byte pairs"), (trainer(2) + normaliser(b"nmt_nfkc", 0x18, 1, 0x20, 0), "normalises"), (trainer(2) + normaliser(b"identity", 0x18, 1, 0x20, 1), "white space"), (trainer(2) + normaliser(b"identity", 0x18, 0, 0x20, 0), "white space")):
        (tmp_path / "m.model").write_bytes(model)
        with pytest.raises(ValueError, match=fault):
            sentencepiece_codec.check_model(str(tmp_path / "m.model"))
    (tmp_path / "m.model").write_bytes(trainer(2) + plain)
    sentencepiece_codec.check_model(str(tmp_path / "m.model"))
