import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from assaykit.llm import bpe
from assaykit.llm.queries import op6_bpe, tokenizer_file

BYTE, WORD = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
ODD = ["", " ", "it's  a\n\n test ", "a   b", "x\x1c y\x1f\x85z", "<|endoftext|> and<|endoftext|>  <|endoftext|>", "été    été　", "日本語 テキスト", "é ́x", "a" * 300 + " b", "12345 ::-- 'll don't 's", "ΑΣ ΑΣ. İI", "� \U0001f600\U0001f600"]


def library(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = t.encode(text, add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_certain_cuts():
    forced = bpe.forced_pairs(bpe.token_bytes(BYTE))
    assert bpe.uncertain_ends(forced) == {0xA0}  # of the no-break space, and of "à"
    assert not forced[ord("t"), ord("h")]
    assert bpe.Encoder(BYTE).fragments("a à  la  b\n") == ["a", " à  la", "  b", "\n"]


def test_odd_texts_as_the_library():
    for path, ends in ((BYTE, False), (WORD, True)):
        codec = bpe.Encoder(path, ends)
        for text in ODD * 2:
            ids = np.frombuffer(codec.encode(text), "<u4")
            expect, decoded = library(path, text)
            assert ids.tolist() == expect, text
            if not ends:
                assert codec.decode(ids) == decoded == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé\n\t\x0b\x1c\x85  ́'st1,.<|>ñ日"), max_size=40))
def test_any_text_as_the_library(text):
    for path, ends in ((BYTE, False), (WORD, True)):
        assert np.frombuffer(bpe.encoder(path, ends).encode(text), "<u4").tolist() == library(path, text)[0]


def test_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (None, "a b", 3)], "doc_id bigint, text string, ids int")
    got = bpe.encode_decode(df, BYTE).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == [("1", [], ""), ("2", [], ""), ("2", [], ""), ("None", library(BYTE, "a b")[0], "a b")]
    assert bpe.encode_decode(df.where("doc_id > 9"), BYTE).count() == 0


def test_query_as_the_library(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op6_bpe(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in docs.items():
        ids, decoded = library(BYTE, text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(decoded))
