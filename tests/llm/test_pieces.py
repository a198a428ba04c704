import os
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
from sentencepiece import sentencepiece_model_pb2 as pb  # noqa: E402

from courtfold.llm.pieces import Encoder, PieceModel, Steps, decode_documents, encode_documents, merge_viterbi, merges  # noqa: E402

PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
TEXTS = [
    "", " ", "   ", "Hello  world", " lead", "tail  ", "a\nb\tc", "é漢x\x00y", "<s></s><0x41>", " nb", "ünïcödé straße 你好",
    "word " * 3000, "x" * 3000, "the quick brown fox " * 5 + "\n\n jumps", "http://a.b/c?d=e&f#g", "😀😀 ok",
]


def random_texts(n, seed=0):
    rng = random.Random(seed)
    alphabet = "aaabcdeeefghiinostt    \n.,-é漢0123ABC"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def unigram_model(path, byte_fallback):
    """A small unigram model with scores of our own; nothing is trained."""
    rng = random.Random(4)
    m = pb.ModelProto()

    def add(piece, score, kind):
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind

    add("<unk>", 0, 2)
    add("<s>", 0, 3)
    if byte_fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", 0, 6)
    seen = set()
    for _ in range(400):
        p = rng.choice(["", "▁"]) + "".join(rng.choice("abcdeinost") for _ in range(rng.randint(1, 4)))
        if p not in seen:
            seen.add(p)
            add(p, -rng.uniform(2, 12) * len(p) ** 0.5, 1)
    add("▁", -3.5, 1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, byte_fallback
    n = m.normalizer_spec
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", True, False, True
    path.write_bytes(m.SerializeToString())
    return str(path)


def ids(encoder, texts):
    import numpy as np

    return [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)]


@pytest.mark.skipif(not os.path.exists(PATH), reason="no model file")
def test_merge_model_gives_the_library_ids_and_texts():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), Encoder(PieceModel.load(PATH))
    texts = TEXTS + random_texts(300)
    got = ids(own, texts)
    assert got == [library.encode(t) for t in texts]
    assert [own.decode(x) for x in got] == [library.decode(x) for x in got]
    assert [own.decode(x) for x in got] == texts
    for word in ("▁internationalisation" * 4, "▁aaaaaaaaaaaaaaaaaaaaaab", "▁thethethethe", "▁éèàééé漢字"):
        assert all((a == b).all() for a, b in zip(merge_viterbi([word], own.model, Steps(own.model)), merges([word], own.model)))


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_viterbi_gives_the_library_ids(tmp_path, fallback):
    path = unigram_model(tmp_path / "u.model", fallback)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), Encoder(PieceModel.load(path))
    texts = TEXTS + random_texts(300, 1)
    assert ids(own, texts) == [library.encode(t) for t in texts]


@pytest.mark.skipif(not os.path.exists(PATH), reason="no model file")
def test_frames_with_nulls_repeats_and_clashing_names(spark):
    model = PieceModel.load(PATH)
    rows = [(1, "a b", [5]), (1, "a b", None), (None, "c", None), (2, None, None), (3, "", None), (4, "▁x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = encode_documents(frame, model)
    assert sorted((r.doc_id or 0, r.n_tokens, r.round_trip) for r in got.collect()) == [(0, 1, True), (1, 2, True), (1, 2, True), (2, 0, None), (3, 0, True), (4, 2, False)]
    back = {r.doc_id: r.text for r in decode_documents(got, model).collect()}
    assert back == {None: "c", 1: "a b", 2: "", 3: "", 4: " x"}
    assert encode_documents(frame.limit(0), model).count() == 0
