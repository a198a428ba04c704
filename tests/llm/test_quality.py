import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtfold.llm import quality
from courtfold.llm.quality import BITS, CELLS, SYMBOL, UNIT, HashArray, build_model, costs_of, failed, quality_filter, quality_rules, read_model

SCHEMA = "doc_id long, text string, lang string, g int, c string, kept int"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(wins), set()
    for i, w in enumerate(wins):
        if count[w] > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def documents(n=120, seed=1):
    rng = random.Random(seed)
    vocab = {"en": "the of and running sea shore ship sails ÿes".split(), "fr": "le la été naïve ou et chanson".split()}
    rows = [(900, None, "en"), (901, "", None), (902, " \n\t", "fr"), (903, "x", "en"), (904, "é" * 4000 + "\n", "fr"), (905, "a b c d e f g h " * 40, "en")]
    for i in range(n):
        lang = rng.choice(["en", "fr", None])
        lines = [" ".join(rng.choice(vocab[lang or "en"]) + rng.choice(["", "", ".", "#"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        rows.append((i, "\n".join(lines + lines[: rng.randint(0, 2)]), lang))
    rows.append(rows[-1])
    return [(*r, 1, "x", 2) for r in rows]


def symbols(text, order):
    return [0] * (order - 1) + [int(SYMBOL[b]) for b in text.encode()]


def model_by_hand(texts, order):
    """Modified Kneser-Ney costs of the last symbols of grams, in 1/UNIT bit, by dictionaries."""
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for t in texts:
        x = symbols(t, order)
        counts[order].update(tuple(x[i : i + order]) for i in range(len(x) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    contexts = [None, *(defaultdict(list) for _ in range(order))]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            contexts[k][g[:-1]].append(c)

    def discount(k, c):
        n = Counter(counts[k].values())
        i = min(c, 3)
        if not n[i] or not n[1] + 2 * n[2]:
            return 0.5
        return min(max(i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i], 0.1), i)

    def gamma(g):
        held = contexts[len(g)][g[:-1]]
        return sum(discount(len(g), c) for c in held) / sum(held)

    def p(g):
        if not g:
            return 1 / 48
        c = counts[len(g)][g]
        return (c - discount(len(g), c)) / sum(contexts[len(g)][g[:-1]]) + gamma(g) * p(g[1:])

    known, skipped = {}, {}

    def cost(g):
        if not g:
            return round(UNIT * math.log2(48))
        if counts[len(g)][g]:
            if g not in known:
                known[g] = round(-UNIT * math.log2(p(g)))
            return known[g]
        if contexts[len(g)].get(g[:-1]):
            if g[:-1] not in skipped:
                skipped[g[:-1]] = round(-UNIT * math.log2(gamma(g)))
            return skipped[g[:-1]] + cost(g[1:])
        return cost(g[1:])

    return cost


def test_base_counts_match_the_definition(spark):
    rows = documents()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for r in rows:
        b = base(r[1])
        want.append((r[0], *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert got == sorted(want)


def frame_of(spark, texts):
    return spark.createDataFrame([("en", 0, t) for t in texts], "lang string, half int, text string")


@pytest.mark.parametrize("order", [2, 4])
def test_model_matches_dictionaries(spark, order):
    texts = [r[1] for r in documents(40) if r[2] == "en" and r[1] and not failed(base(r[1])[0], base(r[1])[4], 20)]
    tables = read_model(bytes(build_model(frame_of(spark, texts), order).first().model), order)
    cost, text = model_by_hand(texts, order), texts[-1] + " unseen ?"
    x = symbols(text, order)
    grams = [tuple(x[i : i + order]) for i in range(len(x) - order + 1)]
    got = costs_of(np.array([sum(s << BITS * (order - 1 - i) for i, s in enumerate(g)) for g in grams]), tables)
    assert np.abs(got - [cost(g) for g in grams]).max() <= 1


def test_probabilities_of_any_context_sum_to_one(spark):
    tables = read_model(bytes(build_model(frame_of(spark, [r[1] for r in documents(30) if r[1]])).first().model))
    for context in ([1, 2, 3], [0, 0, 0], [28, 5, 47], [44, 36, 36]):
        grams = np.array([sum(s << BITS * (3 - i) for i, s in enumerate([*context, x])) for x in range(48)])
        assert abs((2.0 ** (-costs_of(grams, tables) / UNIT)).sum() - 1) < 5e-3


def test_hash_array_finds_what_it_holds():
    assert HashArray(np.array([5, 7]), np.array([1, 2])).find(np.array([7, 6, 5]))[0].tolist() == [2, 0, 1]


def by_hand(rows, halves):
    """(doc_id, kept) by dictionaries: models of halves, bits by word runs, median of cells, bands."""
    known = {}
    for i, r in enumerate(rows):
        lang, text = r[2] or "und", r[1] or ""
        b = base(text)
        known[i] = (lang, halves[i], text, b[0] < 20 or 100 * b[4] > 30 * b[0])
    models = {}
    for lang in {k[0] for k in known.values()}:
        for half in (0, 1):
            models[lang, half] = model_by_hand([t for g, h, t, bad in known.values() if g == lang and h == half and not bad], 4)
    bits = {}
    for i, (lang, half, text, _) in known.items():
        x = symbols(text, 4)
        raw = text.encode()
        letter = [bool(re.match(rb"[0-9A-Za-z\x80-\xff]", raw[k : k + 1])) for k in range(len(raw))]
        runs = sum(x and (not k or not letter[k - 1] or raw[k] >= 0xE3) for k, x in enumerate(letter))
        cost = models[lang, 1 - half]
        bits[i] = sum(cost(tuple(x[k : k + 4])) for k in range(len(x) - 3)) / UNIT / runs if runs else None
    out = []
    for i, r in enumerate(rows):
        lang, _, _, bad = known[i]
        cells = sorted(math.floor(math.log2(bits[k]) * CELLS) for k, v in known.items() if v[0] == lang and not v[3] and bits[k] is not None)
        middle = 2 ** ((cells[(len(cells) - 1) // 2] + 0.5) / CELLS) if cells else 0
        out.append((r[0], not bad and bits[i] is not None and 0.6 * middle <= bits[i] <= 1.25 * middle))
    return out


def test_verdicts_match_brute_force_for_any_partitioning(spark):
    rows = documents(60)
    frame = spark.createDataFrame(rows, SCHEMA)
    halves = [r.h for r in frame.select(F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()]
    want = sorted(by_hand(rows, halves), key=repr)
    assert 0 < sum(kept for _, kept in want) < len(want)
    for n in (1, 7):
        assert sorted(((r.doc_id, r.kept) for r in quality_rules(frame.repartition(n)).collect()), key=repr) == want


def test_rounds_of_languages_change_nothing(spark, monkeypatch):
    frame = spark.createDataFrame(documents(40), SCHEMA)
    want = sorted(map(repr, quality_rules(frame).collect()))
    monkeypatch.setattr(quality, "ROUND_ENTRIES", 1)
    assert sorted(map(repr, quality_rules(frame).collect())) == want


def test_grams_of_stretches_are_those_of_the_whole(monkeypatch):
    texts = [(r[1] or "").encode() for r in documents(30)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = quality.grams(data, offsets)
    monkeypatch.setattr(quality, "STEP", 50)
    assert (np.concatenate([g for _, g in quality._pieces(data, offsets, 4)]) == whole).all()


def test_bands_reject_odd_texts_and_keep_clean_ones(spark):
    rng = random.Random(5)
    syllables = "the re in on at sto ri es al ne wor ld".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    clean = [(i, " ".join(word() for _ in range(100)) + ".", "en", 0, "", 0) for i in range(200)]
    odd = [(900 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzQWXZJ0123#%!") for _ in range(7)) for _ in range(100)), "en", 0, "", 0) for i in range(8)]
    frame = spark.createDataFrame(clean + odd, SCHEMA)
    kept = quality_filter(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    assert quality_rules(frame.limit(0)).count() == 0


def test_filter_keeps_clean_documents_with_a_null_id(spark):
    rng = random.Random(7)
    clean = [(i or None, " ".join(rng.choice("sea shore ship sails river stone".split()) + str(rng.randint(0, 9)) for _ in range(60)), "en", 0, "", 0) for i in range(20)]
    assert sum(r.doc_id is None for r in quality_filter(spark.createDataFrame(clean, SCHEMA)).collect()) == 1


def unspaced(n, length, seed=3):
    rng = random.Random(seed)
    return [(i, "\n".join("".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(rng.randint(length // 2, length))) for _ in range(25)), "zh", 0, "", 0) for i in range(n)]


def test_unspaced_lines_of_any_length_have_a_band_around_their_median(spark):
    for length in (80, 600):
        rows = unspaced(30, length) + [(100, "\n".join(["qxzj " * 90 + str(i) for i in range(25)]), "zh", 0, "", 0)]
        frame = spark.createDataFrame(rows, SCHEMA)
        halves = [r.h for r in frame.select(F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()]
        got = {r.doc_id: r for r in quality_rules(frame).collect()}
        assert [got[i].kept for i, _ in sorted(by_hand(rows, halves))] == [kept for _, kept in sorted(by_hand(rows, halves))]
        assert all(got[i].kept and got[i].low_bits < got[i].bits < got[i].high_bits for i in range(30))


def pattern(n, flip):
    """The words over a and b whose polynomial hashes modulo 2**64 agree for every odd base."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


def test_long_lines_and_words_of_one_pattern_are_told_apart(spark):
    words = [pattern(n, f) for n in (1024, 2048) for f in (0, 1)]
    text = "\n".join(words) + "\n" + " ".join(f"w{i}" for i in range(30))
    window = " ".join(f"x{i}" for i in range(7))
    text += "\n" + "\n".join(f"{window} {w}" for w in words)
    got = quality_rules(spark.createDataFrame([(1, text, "en", 0, "", 0)], SCHEMA)).first()
    assert (got.n_dup_lines, got.n_repeat_words) == base(text)[3:] == (0, 0)


def test_a_long_text_counts_right(spark):
    rng = random.Random(11)
    lines = ["".join(rng.choice("ab c") for _ in range(2_000_000)), "word " * 400_000, "z" * 3_000_000]
    text = "\n".join(lines + lines)
    got = quality_rules(spark.createDataFrame([(1, text, "en", 0, "", 0)], SCHEMA)).first()
    assert (got.n_words, got.word_chars, got.n_dup_lines) == (len(text.split()), len("".join(text.split())), 3)
