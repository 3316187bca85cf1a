import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from plumbline.llm import encoding
from plumbline.llm.encoding import SentencePieceCodec, decode, encode
from plumbline.llm.sentencepiece_model import BYTE, CONTROL, UNKNOWN

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "   ", " " * 7, " " * 15, " " * 40, "\n", "\t", "é", "日本", "😀", "\x00", "▁", "<s>", "<0x0A>", "<unk>", "the", "ing", ".", "́", "ﬁ", "Ａ", "\xa0", "\r"]


def field(number, value):
    key = lambda kind: bytes([*varint(number << 3 | kind)])
    if isinstance(value, float):
        return key(5) + struct.pack("<f", value)
    if isinstance(value, int):
        return key(0) + varint(value)
    return key(2) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram_file(path, squeeze=0, dummy=1):
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL)] + [(f"<0x{i:02X}>", 0.0, BYTE) for i in range(256)]
    pieces += [(p, -float(3 + k * 0.37), 1) for k, p in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "▁th", "the", "▁the", "in", "ing", "t", "h", "e", "i", "n", "g", ".", "é", "▁▁"])]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    body += field(2, field(3, 1) + field(35, 1) + field(40, 0)) + field(3, field(1, b"identity") + field(3, dummy) + field(4, squeeze))
    path.write_bytes(body)
    return str(path)


def texts(n, seed=1, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "▁", "a" * 5000, " " * 300, "<s>"]


def test_ids_and_texts_are_those_of_the_library():
    other, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), SentencePieceCodec(MODEL)
    given = texts(2000)
    ids = [x.tolist() for x in codec.encode(given)]
    assert ids == other.encode(given) and codec.differing(given, ids) == []
    assert codec.decode(ids) == [other.decode(x) for x in ids] == [codec.normal(t) for t in given]
    assert [e.ids for e in codec.whole.encode_batch(given, add_special_tokens=False)] == ids


def test_long_texts_are_cut_at_word_ends(monkeypatch):
    monkeypatch.setattr(encoding, "PART_CHARS", 7)
    other, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), SentencePieceCodec(MODEL)
    given = texts(300, 2) + ["word " * 2000, "x" * 3000 + " y"]
    assert [x.tolist() for x in codec.encode(given)] == other.encode(given)


@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("dummy", [0, 1])
def test_unigram_models(tmp_path, squeeze, dummy):
    path = unigram_file(tmp_path / "tiny.model", squeeze, dummy)
    other, codec = sentencepiece.SentencePieceProcessor(model_file=path), SentencePieceCodec(path)
    parts = ["a", "b", "ab", "the", "thing", " ", "é", "日", ".", "in", "   ", "z"]
    given = [t for t in texts(500, 3, parts) if "<" not in t and "▁" not in t]
    assert codec.differing(given, codec.encode(given)) == []


def test_documents_round_trip(make_docs):
    rows = [(i, t) for i, t in enumerate(texts(200, 4))] + [(900, None), (None, "null id"), (3, "again"), (901, "long words " * 20_000)]
    frame = make_docs(rows)
    got = encode(frame, MODEL, restore=True, verify_every=1)
    back = sorted((tuple(r) for r in decode(got, MODEL).collect()), key=repr)
    codec = SentencePieceCodec(MODEL)
    assert back == sorted(((i, None if t is None else codec.normal(t)) for i, t in rows), key=repr)
    assert {(r["restored"], r["ids"] is None) for r in got.collect()} == {(True, False), (None, True)}
    assert encode(make_docs([]), MODEL, restore=True).collect() == []


def test_other_ids_fail_the_job(make_docs, monkeypatch):
    monkeypatch.setattr(SentencePieceCodec, "encode", lambda self, given: [np.array([5], dtype=np.int32) for _ in given])
    with pytest.raises(Exception, match="ids differ"):
        encode(make_docs([(1, "some text")]), MODEL).collect()
