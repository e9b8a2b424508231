import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bpe_codec, token_counts, word_bpe

TEXTS = [
    None, "", " ", "a", "Hello  World", "it's they'Ve DON'T", "naïve café Straße", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|>",
    "ends<|endoftext|> ", "<|endoftext|", "12345 6 7x8", "Ⅷ ½ ٣", "é ́x", "İstanbul ΣΑΣ", "tab\tnew\nline\r\n\x0b\x1c\x85 z", "aaaaaaaaaaaaaa" * 300,
    "🙂🙂👩‍👩‍👧 ok", "\u0000\u0001", "…—“q”", "a" * 5000 + "!" * 3000, "中文 テキスト 한국어", "''' 's's 'S", "foo_bar-baz@qux.com http://x.y/z?a=b&c=d",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe.default_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")


def test_counts_and_codec_equal_the_library(spark, library):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = TEXTS + docs + docs[:3]
    df = rows(spark, texts)
    counted = {r.doc_id: r for r in token_counts.count_tokens(df).collect()}
    coded = {r.doc_id: r for r in bpe_codec.encode(df).collect()}
    assert len(counted) == len(coded) == len(texts)
    for i, text in enumerate(texts):
        ids, said = expected(library, text)
        assert counted[i].n_tokens == len(ids), text
        assert counted[i].n_bytes == len((text or "").encode())
        assert bytes(coded[i].ids) == np.array(ids, "<u4").tobytes(), text
        assert coded[i].decoded == said


def test_empty_table(spark):
    df = rows(spark, ["x"]).limit(0)
    assert token_counts.count_tokens(df).count() == 0
    assert bpe_codec.encode(df).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    library = test_any_text.__dict__.setdefault("library", Tokenizer.from_file(word_bpe.default_path()))
    codec = bpe_codec.Codec(word_bpe.load(word_bpe.default_path()))
    (ids, said), = codec.encode_batch([text])
    want, decoded = expected(library, text)
    assert ids == np.array(want, "<u4").tobytes()
    assert said.decode() == decoded


def test_whole_tokens_are_proved_not_assumed(library):
    bpe = word_bpe.load(word_bpe.default_path())
    whole = bpe.whole_tokens()
    assert 20_000 < len(whole) < len(bpe.vocab)
    for word in list(whole)[:200]:
        assert bpe.merged(bpe.symbols(word)) == [bpe.vocab[word + bpe.suffix]]


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(word_bpe, "CACHE_BYTES", 600)
    codec = bpe_codec.Codec(word_bpe.load(word_bpe.default_path()))
    for text in ["one two three four five", "six seven one two", "three nine ten"]:
        (ids, _), = codec.encode_batch([text])
        assert ids == np.array(expected(library, text)[0], "<u4").tobytes()
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
