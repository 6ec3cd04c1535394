import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.llm import encoding as E

if not os.path.exists(E.VOCABULARY):
    pytest.skip("no vocabulary file", allow_module_level=True)

ODD = ["", " ", "\n\n  a", "x" * 5000, "<|endoftext|> it's  IT'S", "a\x00b\x7f", "日本語のテキスト👨‍👩‍👧", "▁<unk><s>", " ​﻿", "٣٤ 12345678901234567890", "Ġhello Ċ", "a\r\nb\rc", "é é", "\U0010ffff"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(E.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_texts(reference):
    for text, ids in zip(ODD, E.codec().encode(ODD), strict=True):
        assert ids == reference.encode_ordinary(text), text


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_round_trip_and_equality(text):
    import tiktoken  # noqa: F401

    ids = E.codec().encode([text])[0]
    assert E.codec().decode(ids) == text and all(0 <= i < 50256 for i in ids)


def test_every_token_is_a_piece():
    pieces, tokens = E.codec().pieces, E.read_vocabulary()
    chars = E.byte_characters()
    assert pieces.get_piece_size() == len(tokens) + 1 and pieces.unk_id() == len(tokens)
    assert all(pieces.id_to_piece(i) == "".join(chars[b] for b in t) for i, t in enumerate(tokens))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(E, "REMEMBERED", 50)
    c = E.Codec(E.serialise(E.read_vocabulary()))
    texts = [f"w{i} x{i}" for i in range(300)]
    assert c.encode(texts) == E.codec().encode(texts) and len(c.known) <= 50
    assert [c.encode([t])[0] for t in texts] == E.codec().encode(texts)


def test_columns(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None])], "doc_id long, text string, ids string").repartition(3)
    got = {r["doc_id"]: r for r in df.select("doc_id", "text", E.encode(df, "text").alias("tokens"), E.count_tokens(df, "text").alias("n")).collect()}
    for r in got.values():
        assert r["tokens"] == reference.encode_ordinary(r["text"] or "") and r["n"] == len(r["tokens"])
    ids = spark.createDataFrame([(i, r["tokens"]) for i, r in got.items()] + [(99, None)], "doc_id long, tokens array<int>")
    back = {r["doc_id"]: r["t"] for r in ids.select("doc_id", E.decode(ids, "tokens").alias("t")).collect()}
    assert all(back[i] == (r["text"] or "") for i, r in got.items()) and back[99] == ""
    assert df.limit(0).select(E.encode(df, "text").alias("tokens")).count() == 0
    assert dict(df.select(E.encode(df, "text").alias("ids")).dtypes)["ids"] == "array<int>"


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT CAST(X'61FF62' AS STRING) AS text")
    assert df.select(E.encode(df, "text").alias("i")).first()["i"] == E.codec().encode(["a�b"])[0]
