import hashlib
import random
import re
from collections import Counter

import pytest

from courtfold.llm import substrings
from courtfold.llm.substrings import substring_dedup

SCHEMA = "doc_id long, text string, key string, places int, n_words string"


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(ws[i : i + width]) for ws in words for i in range(len(ws) - width + 1))
    out = []
    for (doc_id, _), ws in zip(rows, words):
        gone = set()
        for i in range(len(ws) - width + 1):
            if count[tuple(ws[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def documents(seed, n=80, vocabulary=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkléß"[:vocabulary]) * rng.randint(1, 2)
    passages = [[word() + str(rng.randint(0, 99)) for _ in range(rng.randint(5, 90))] for _ in range(6)]
    rows = [(900, None), (901, ""), (902, " \n\t "), (None, "x y"), (903, "w " * 200), (904, "é ü\x1c z")]
    for i in range(n):
        ws = [word() + str(rng.randint(0, 999)) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            at = rng.randint(0, len(ws))
            ws[at:at] = p[a : rng.randint(a, len(p))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(ws)))
    return rows + [rows[-1], (500, rows[-2][1]), (501, rows[-3][1])]


@pytest.mark.parametrize("width,flush", [(35, 1 << 21), (7, 300), (2, 50)])
def test_matches_brute_force(spark, monkeypatch, width, flush):
    monkeypatch.setattr(substrings, "FLUSH_WORDS", flush)
    rows = documents(width)
    got = sorted((tuple(r) for r in substring_dedup(spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA), width=width).collect()), key=repr)
    assert got == brute(rows, width)


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_one_pattern_are_told_apart(spark):
    """Polynomial hashes modulo 2**64 of these words agree for every odd base."""
    words = ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n)) for n in (1024, 2048) for flip in (0, 1)]
    common = [f"w{i}" for i in range(34)]
    rows = [(i, " ".join([*common[:17], w, *common[17:]])) for i, w in enumerate(words)] + [(9, " ".join([*common[:17], words[0], *common[17:]]))]
    got = sorted((tuple(r) for r in substring_dedup(spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA)).collect()), key=repr)
    assert got == brute(rows, 35)
    assert [r[2] for r in got] == [35, 0, 0, 0, 35]


def test_a_long_text(spark):
    rng = random.Random(4)
    long = [str(rng.randint(0, 10**6)) for _ in range(600_000)]
    rows = [(1, " ".join(long)), (2, "a " + " ".join(long[1000:2000])), (3, "x" * 5_000_000)]
    got = sorted((tuple(r) for r in substring_dedup(spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA)).collect()), key=repr)
    assert got == brute(rows, 35) and got[0][2] == got[1][2] - 0 == 1000
