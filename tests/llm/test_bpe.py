import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from martwright.llm import queries
from martwright.llm.bpe import ForcedBoundaryCodec, decode_documents, encode_documents, slices

PATH = queries.tokenizer()


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return ForcedBoundaryCodec(PATH)


def check(tok, codec, text):
    want = tok.encode(text, add_special_tokens=False).ids
    got = codec.encode_all([text])[0].tolist()
    assert got == want, text
    assert codec.decode(got) == tok.decode(want, skip_special_tokens=False)


PIECES = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", "'", "'s", "'ll", "'re", "'S", "''", "don't", "\u2019t", "a", "Z",
                          "the", "tion", "9", "2024", "!", "...", "!'s", "-", "\u00e9", "\u00f1", "\u00df", "\u00c8", "\u4e2d\u6587",
                          "\u0301", "\u00a0", "\u2003", "\u2028", "\u3000", "\u1680", "\x85", "\x1c", "\x00", "\U0001f600", "\u200b",
                          "<|endoftext|>", "<|endof", "text|>", "\u00b2", "\u2167", "_", "\x7f", "\ufdfd", "\u06a9"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_pieces(tok, codec, text):
    check(tok, codec, text)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_text(tok, codec, text):
    check(tok, codec, text)


def test_cuts_are_used(codec):
    parts = codec.fragments("The quick brown fox, jumping over 12 dogs.")
    assert len(parts) >= 8 and b"".join(parts) == b"The quick brown fox, jumping over 12 dogs."


def test_query_against_the_library(spark, small, documents, tok):
    got = {r.doc_id: r for r in queries.op3(spark, small).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        x = got[r.doc_id]
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, empty, tok):
    got = encode_documents(odd, PATH).collect()
    want = sorted(str(tok.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect())
    assert sorted(str(list(r.ids)) for r in got) == want
    assert sorted(r.decoded for r in got) == sorted(r.text or "" for r in odd.collect())
    assert encode_documents(empty, PATH).count() == 0


def test_decode_alone(spark, tok):
    df = spark.createDataFrame([(1, [464, 2068]), (2, []), (3, None), (4, [140])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in decode_documents(df, PATH).collect()}
    assert got == {1: tok.decode([464, 2068], skip_special_tokens=False), 2: "", 3: "",
                   4: tok.decode([140], skip_special_tokens=False)}


def test_a_task_holds_about_a_megabyte_of_text_at_a_time():
    import pyarrow as pa
    texts = ["a" * 400_000] * 5 + ["b" * 3_000_000, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = [p.column("t").to_pylist() for p in slices(batch, "t")]
    assert [t for p in parts for t in p] == texts
    lengths = [[len(t or "") for t in p] for p in parts]
    assert all(sum(n) - max(n) <= 1 << 20 for n in lengths)     # beyond that, one longer text


class Counting:
    """The library's tokenizer, with the texts it was given."""

    def __init__(self, tok):
        self.tok, self.given = tok, []

    def encode_batch_fast(self, texts, add_special_tokens):
        self.given += texts
        return self.tok.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_what_keeps_coming_back_is_encoded_once(tok, monkeypatch):
    from martwright.llm import bpe
    monkeypatch.setattr(bpe, "REMEMBER", 60)
    codec = ForcedBoundaryCodec(PATH)
    codec.tok = Counting(codec.tok)
    for i in range(40):
        text = "common commonly " + " ".join(f"x{i}y{j}" for j in range(10)) + "<|endoftext|>"
        assert codec.encode_all([text, ""])[0].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(codec.known) + len(codec.before) <= 120
    assert sum(t.count(" commonly") for t in codec.tok.given) == 1      # the memory was renewed several times


def test_fragments_together_are_encoded_as_each_alone(tok, codec):
    parts = [b" the", b"  ", b"\n\n", b"'", b"s", " é中".encode(), b"<|endof", b"text|>", b"\x00", b" <|", b"|>", b"<"]
    want = [tok.encode(p.decode(), add_special_tokens=False).ids for p in parts]
    assert [list(memoryview(x).cast("I")) for x in codec._encode_each(parts)] == want
    assert [list(memoryview(x).cast("I")) for x in codec._encode_each(parts[:1])] == want[:1]


def test_another_special_token_over_the_mark(tmp_path):
    import json
    with open(PATH, encoding="utf-8") as f:
        conf = json.load(f)
    more = dict(conf["added_tokens"][0], id=conf["added_tokens"][0]["id"] + 1, content="a<|endoftext|>")
    conf["added_tokens"].append(more)
    (path := tmp_path / "two.json").write_text(json.dumps(conf), encoding="utf-8")
    tok, codec = Tokenizer.from_file(str(path)), ForcedBoundaryCodec(str(path))
    for text in ("a banana a<|endoftext|> b", "panda sofa\n"):
        assert codec.encode_all([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_each_distinct_fragment_is_looked_up_once(tok, codec):
    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    text = "the cat sat on the mat, and the cat's hat sat too. " * 400
    codec.known = Counted(codec.known)
    assert [x.tolist() for x in codec.encode_all([text, "", text])] == [tok.encode(t, add_special_tokens=False).ids for t in (text, "", text)]
    assert Counted.asked <= len(set(codec.fragments(text)))
