"""Quality rules by pieces of the supplied tokenizer, against its own library and dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import pyarrow as pa

import corpus_pipeline
from courtfold.llm import pieces as P
from courtfold.llm import quality
from courtfold.llm.pieces import PieceModel
from courtfold.llm.quality import UNIT, build_model, costs_of, encoded, piece_bits, quality_filter, quality_rules, read_model
from courtfold.llm.queries import PIECE_MODEL, op5_quality_rules

sentencepiece = pytest.importorskip("sentencepiece")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
PIECES = PieceModel.load(PIECE_MODEL)
SCHEMA = "doc_id long, text string, lang string"


def documents(n=60, seed=2):
    rng = random.Random(seed)
    vocab = {"en": "the of running sea shore ship sails ÿes".split(), "ru": "река море и берег корабль плывёт".split(), "zh": "海 船 岸 河流 石头".split()}
    rows = [(900, None, "en"), (901, "", None), (902, "x", "en"), (903, "a b c d e f g h " * 40, "en"), (904, "\n", "ru")]
    for i in range(n):
        lang = rng.choice(list(vocab))
        words = [rng.choice(vocab[lang]) + rng.choice(["", "", ".", "#", str(rng.randint(0, 99))]) for _ in range(rng.randint(20, 90))]
        if i % 9 == 0:
            words = ["".join(rng.choice("qxzjkvw0123") for _ in range(9)) for _ in words]
        rows.append((i, " ".join(words), lang))
    return rows + rows[-1:]


def grams(text, order):
    x = [0] * (order - 1) + [i + 1 for i in LIBRARY.encode(text or "")]
    return [tuple(x[i : i + order]) for i in range(len(x) - order + 1)]


def model_by_hand(texts, order):
    """Modified Kneser-Ney cost of the last piece of a gram, in 1/UNIT bit."""
    counts = {order: Counter(g for t in texts for g in grams(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    held = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            held[k][g[:-1]].append(c)
    size = LIBRARY.get_piece_size()
    numbers = {k: Counter(v.values()) for k, v in counts.items()}

    def discount(k, c):
        n, i = numbers[k], min(c, 3)
        return min(max(i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i], 0.1), i) if n[i] and n[1] + 2 * n[2] else 0.5

    def gamma(k, context):
        c = held[k][context]
        return sum(discount(k, x) for x in c) / sum(c)

    def p(g):
        k = len(g)
        return (counts[k][g] - discount(k, counts[k][g])) / sum(held[k][g[:-1]]) + gamma(k, g[:-1]) * p(g[1:]) if g else 1 / size

    def cost(g):
        if not g:
            return round(UNIT * math.log2(size))
        if counts[len(g)][g]:
            return round(-UNIT * math.log2(p(g)))
        return (round(-UNIT * math.log2(gamma(len(g), g[:-1]))) if g[:-1] in held[len(g)] else 0) + cost(g[1:])

    return cost


def coded(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"half": F.lit(0), "lang": F.lit("en")})
    return encoded(frame.select("doc_id", "lang", "half", "text"), PIECES)


@pytest.mark.parametrize("order", [2, 3])
def test_model_of_pieces_matches_dictionaries(spark, order):
    rows = [r for r in documents() if r[0] < 900]
    tables = read_model(bytes(build_model(coded(spark, rows), order, 0, PIECES).first().model), order)
    bits, cost = piece_bits(PIECES), model_by_hand([r[1] for r in rows], order)
    own = [g for t in (rows[3][1], "the ship sails to 東京, unseen ?") for g in grams(t, order)]
    got = costs_of(np.array([sum(x << bits * (order - 1 - i) for i, x in enumerate(g)) for g in own]), tables, bits, len(PIECES.pieces))
    assert np.abs(got - [cost(g) for g in own]).max() <= 1


def test_bits_are_the_cost_of_pieces_by_word_for_any_partitioning(spark, monkeypatch):
    rows = documents()
    frame = spark.createDataFrame(rows, SCHEMA)
    halves = [r.h for r in frame.select(F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()]
    base = {r.doc_id: r.base_failed for r in quality_rules(frame).collect()}
    runs = {r.doc_id: r.runs for r in coded(spark, rows).collect()}
    models = {}
    for lang in {r[2] for r in rows}:
        for half in (0, 1):
            models[lang, half] = model_by_hand([r[1] for r, h in zip(rows, halves) if (r[2], h) == (lang, half) and not base[r[0]]], 2)
    want = {r[0]: sum(map(models[r[2], 1 - h], grams(r[1], 2))) / UNIT / runs[r[0]] if runs[r[0]] else None for r, h in zip(rows, halves) if r[2]}
    for n in (1, 5):
        monkeypatch.setattr(quality, "STEP", 1 << 20 if n == 1 else 100)
        got = quality_rules(frame.repartition(n), pieces=PIECES).collect()
        assert len(got) == len(rows)
        for r in got:
            if want.get(r.doc_id) is None:
                assert r.bits is None
            else:  # costs are rounded to 1/UNIT bit for each piece
                assert abs(r.bits - want[r.doc_id]) < 0.05
        assert all(not r.kept for r in got if r.doc_id % 9 == 0) and sum(r.kept for r in got) > 30


def test_query_and_stage_take_pieces(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(repr, quality_rules(docs, pieces=PIECES).collect()))
    assert sorted(map(repr, op5_quality_rules(spark, "/root/testdata/sf0.001").collect())) == want != sorted(map(repr, quality_rules(docs).collect()))
    kept = sorted(r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect())
    assert kept == sorted(r.doc_id for r in quality_filter(docs, pieces=PIECES).collect()) == sorted(r.doc_id for r in quality_rules(docs, pieces=PIECES).filter("kept").collect())


def test_stage_counts_no_symbols(spark, monkeypatch):
    def symbols(*_):
        raise AssertionError("n-grams of symbols")

    monkeypatch.setattr(quality, "count_grams", symbols)
    frame = spark.createDataFrame(documents(30), SCHEMA)
    assert 0 < corpus_pipeline.quality(spark, frame, "").count() < 36


def test_words_make_their_merges_once_without_a_viterbi(spark, monkeypatch):
    """A worker's tasks encode by the library's ids, and no step between pieces is learnt for a word that isn't long."""
    rng = random.Random(4)
    texts = [t for _, t, _ in documents() if t] + ["".join(rng.choice("abcdefgh ") for _ in range(900)), "東京都と大阪" * 30, "ab" * 500, "  x  \n\ty ", "\u2581 a\u2581b", "naïve \U0001f600\U00010348 q" * 9]
    rows, taken = pa.table({"lang": ["en"] * len(texts), "half": pa.array([0] * len(texts), pa.int32()), "text": texts}), []
    docs = spark.createDataFrame([], "lang string, half int, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, ddl: taken.append(run))
    encoded(docs, PIECES)
    own = {len(w) for t in texts for w in PIECES.encoder()._units(t) if len(w) <= P.LONG}
    real = P.merge_viterbi
    monkeypatch.setattr(P, "merge_viterbi", lambda words, *more: real(words, *more) if len(words[0]) > P.LONG else pytest.fail("a Viterbi of words"))
    out = pa.Table.from_batches(taken[0](iter(rows.to_batches())))
    assert [np.frombuffer(b.as_py(), np.uint16).tolist() for b in out.column("ids")] == [LIBRARY.encode(t) for t in texts]
    assert len(own) > 10
