import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickspark.llm import queries
from tickspark.llm.token_counts import count_tokens, merger

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def lib_count(text):
    return len(LIB.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", " ", "a  b", "a \n b", " x\n\n\ny  ", "<|endoftext|>a<|endoftext|> b", "It's we'll 'S", "é" * 99, "　x  y", "1234 5½², -- ???", "ab" * 5000, "tabs\t\tand \t x"])
def test_equals_library(text):
    assert merger(PATH).count(text) == lib_count(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\tabtheion'.,0123éß漢<|>!"), max_size=60))
def test_equals_library_on_random_texts(text):
    assert merger(PATH).count(text) == lib_count(text)


def test_query_equals_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = lib_count(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)


def test_nulls_repeats_clashes_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "the the", "y"), (2, "", None)], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH).collect())
    assert got == [(0, 7, lib_count("the the")), (1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert count_tokens(df.where("false"), PATH).count() == 0
