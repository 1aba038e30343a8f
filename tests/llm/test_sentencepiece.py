import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from sparkloom.llm import sentencepiece_codec
from sparkloom.llm.sentencepiece_codec import MODEL, PieceModel, decode_documents, encode_documents, load


@pytest.fixture(scope="module")
def model():
    return load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def noise(seed, n):
    r = random.Random(seed)
    signs = "abcdefgh  ▁eint  THES.,\n\t-—日本語é😀0123456789==//##"
    odd = [" ", "   a", "a   ", "▁", "<s>", "</s> x", "<0x0A>", "<unk>", "aaaa" * 300, "-" * 50, "=" * 33, " " * 40 + "x", "International   representation" * 3, "x" * 5000]
    return odd + ["".join(r.choice(signs) for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_equals_library_on_noise(model, library):
    texts = noise(1, 1500)
    assert [x.tolist() for x in model.encode(texts)] == library.encode(texts)
    whole = model.encode_batch(texts)[1]
    for t, w in zip(texts, whole):
        ids = model.encode([t])[0].tolist()
        assert model.decode(ids) == library.decode(ids) and w == (model.decode(ids) == t), t
    decoded = model.decode_batch([x.tolist() for x in model.encode(texts)])
    assert decoded == [model.decode(x.tolist()) for x in model.encode(texts)]


def test_words_are_forgotten(model, library, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 50)
    texts = noise(4, 300)
    for a in range(0, len(texts), 20):
        assert [x.tolist() for x in model.encode(texts[a : a + 20])] == library.encode(texts[a : a + 20])


def test_equals_library_on_documents(spark, sf_dir, model, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = encode_documents(docs, model).join(docs, "doc_id").collect()
    assert all(r.ids == library.encode(r.text) and r.round_trip and r.n_ids == len(r.ids) for r in rows)


def test_frames(spark, model):
    docs = spark.createDataFrame([(1 << 60, None, 1), (None, "", 1), (2, "a b", 1), (2, "a b", 1)], "doc_id long, text string, ids int")
    got = encode_documents(docs, model)
    rows = sorted(got.collect(), key=lambda r: str(r.doc_id))
    assert [(str(r.doc_id), r.n_ids, r.round_trip) for r in rows] == [("1152921504606846976", 0, None), ("2", 2, True), ("2", 2, True), ("None", 0, True)]
    assert {r.text for r in decode_documents(got, model).collect()} == {"", "a b"}
    assert encode_documents(docs.where("false"), model).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (2, [], 0), (3, [model.ids["a"], None, 10**6, -5], 0)], "doc_id long, ids array<int>, text int")
    texts = {r.doc_id: r.text for r in decode_documents(odd, model).collect()}
    assert texts == {1: None, 2: "", 3: "a" + " ⁇ " * 3} and decode_documents(odd.where("false"), model).count() == 0


def test_unigram_model(library):
    """A unigram model made by hand: the same pieces found as the library's."""
    m = proto.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix = "identity", True
    m.normalizer_spec.remove_extra_whitespaces = False
    for piece, score, kind in (("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)):
        m.pieces.add(piece=piece, score=score, type=kind)
    r = random.Random(3)
    names = {"▁", *"abcd"} | {"".join(r.choice("abcd") for _ in range(r.randint(2, 4))) for _ in range(40)} | {"▁" + "".join(r.choice("abcd") for _ in range(r.randint(1, 3))) for _ in range(30)}
    for i, x in enumerate(sorted(names)):
        m.pieces.add(piece=x, score=-1.0 - r.random() * 8 - i * 1e-5, type=1)
    data = m.SerializeToString()
    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=data), PieceModel(data)
    texts = ["".join(r.choice("abcd  ") for _ in range(r.randint(1, 60))) for _ in range(500)] + ["aze bb"]
    assert [x.tolist() for x in ours.encode(texts)] == theirs.encode(texts)
