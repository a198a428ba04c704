import hashlib
import random

import numpy as np
import pytest

from courtfold.llm import suffixes
from courtfold.llm.suffixes import parse, suffix_dedup, suffix_ranks

SCHEMA = "doc_id long, text string, key string, places int, kept string"


def brute(rows, width):
    data = [(t or "").encode() for _, t in rows]
    first = {}
    for (i, _), b in zip(rows, data):
        for p in range(len(b) - width + 1):
            at = (i is not None, i or 0, p)
            first[b[p : p + width]] = min(first.get(b[p : p + width], at), at)
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < (i is not None, i or 0, p):
                gone[p : p + width] = True
        kept = bytes(c for c, g in zip(b, gone.tolist()) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone.tolist()))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def documents(seed, n=60):
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    passages = [some(rng.randint(20, 400)) for _ in range(5)]
    rows = [(900, None), (901, ""), (None, passages[0]), (902, "a" * 500), (903, "ab" * 300), (904, "é" * 200), (905, "a" * 101)]
    for i in range(n):
        t = some(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            at = rng.randint(0, len(t))
            t = t[:at] + p[a : rng.randint(a, len(p))] + t[at:]
        rows.append((rng.randint(0, 10**9), t))
    return rows + [rows[-1], (1, rows[-2][1]), (rows[-3][0], rows[-4][1])]


@pytest.mark.parametrize("width,gram,flush,segment", [(100, 32, 8 << 20, 1 << 23), (100, 32, 3000, 700), (24, 8, 900, 100), (5, 2, 400, 50)])
def test_matches_brute_force(spark, monkeypatch, width, gram, flush, segment):
    monkeypatch.setattr(suffixes, "FLUSH_BYTES", flush)
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    rows = documents(width + flush)
    frame = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA)
    got = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in suffix_dedup(frame, width=width, gram=gram).collect()), key=repr)
    assert got == brute(rows, width)


def test_ranks_order_prefixes():
    data = np.frombuffer(b"banana-bandana-banana" * 3, np.uint8)
    for width in (3, 8, 13, 20):
        ranks = suffix_ranks(data, width)
        texts = [bytes(data[i : i + width]).ljust(width, b"\0") for i in range(len(data) - width)]
        for i in range(len(texts)):
            for j in range(i):
                assert (ranks[i] < ranks[j]) == (texts[i] < texts[j]) and (ranks[i] == ranks[j]) == (texts[i] == texts[j])


def test_every_window_has_the_trigger_of_its_content():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[2000:2400] = data[300:700]
    row, start, length, trigger = parse(data, np.array([0, 1500, 1500, 4000]), 100, 32)
    offset = {}
    for s, n, t in zip(start, length, trigger):
        for i in range(s, s + n):
            offset[i] = t - i
    assert sorted(offset) == [*range(0, 1401), *range(1500, 3901)] and all(0 <= o <= 68 for o in offset.values())
    assert all(offset[300 + i] == offset[2000 + i] for i in range(301))


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("refined_from,ranked", [(2, 1 << 20), (1024, 300), (2, 300)])
def test_hot_triggers_are_refined_and_lose_nothing(spark, monkeypatch, refined_from, ranked):
    monkeypatch.setattr(suffixes, "REFINED_FROM", refined_from)
    monkeypatch.setattr(suffixes, "RANKED_BYTES", ranked)
    monkeypatch.setattr(suffixes, "FLUSH_BYTES", 3000)
    rng = random.Random(3)
    some = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    common = some(60)  # one trigger for very many different phrases
    rows = [(i, some(rng.randint(0, 80)) + common + some(rng.randint(0, 80))) for i in range(150)]
    rows += [(200 + i, rows[i][1][rng.randint(0, 10) :] + "tail") for i in range(0, 40, 3)] + documents(8, 20)
    frame = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SCHEMA)
    got = sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in suffix_dedup(frame).collect()), key=repr)
    assert got == brute(rows, 100)


def test_one_text_of_many_megabytes(spark):
    rng = np.random.default_rng(1)
    long = bytes(rng.integers(97, 123, 20 << 20).astype(np.uint8)).decode()
    rows = [(1, long), (2, "start " + long[5_000_000:5_000_300] + " end"), (3, long[-150:])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep_bytes=False).collect()}
    assert got == {1: (0, 0), 2: (300, 1), 3: (150, 1)}
