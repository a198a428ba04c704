"""Ranked search, fill-in-middle and exact dedup against plain Python, and against their SQL over given tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from courtfold.llm import exactdup, infill, search
from courtfold.llm.exactdup import exact_dedup, exact_groups
from courtfold.llm.infill import fill_in_middle
from courtfold.llm.queries import ORACLES, QUERIES
from courtfold.llm.search import ranked_search

DATA = "/root/testdata/sf0.001"
#: Columns named like those that the operators make.
SCHEMA = "doc_id long, text string, n int, row string, key int, score string, rank int, item_id string, full int, recurs string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", 2, "s", 3, "i", 4, "c") for r in rows], SCHEMA)


def rows(seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "of", "naïve", "NAÏVE", "x9", "日本", "end.", "a-b", "zz\x1cz", "<P", "S>", "\x85", "\xa0q"]
    out = [(rng.randint(0, 300), rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", "  ", "\n\t", "\r\n", "\x0b", "\x0c"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    out += [(1000, None), (1001, ""), (1002, " \n "), (None, "the end"), (None, "the  end"), (1003, "<S> here"), (1004, "th eend"), (1005, long), (1006, long + " "), (7, "the end"), (7, "the end")]
    return out + [(2000 + i, "copy of a copy " + " " * (i % 3)) for i in range(150)]


def brute_exact(docs):
    plain = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in docs]
    groups = defaultdict(list)
    for i, p in enumerate(plain):
        groups[p].append(i)
    keep = {p: min(at, key=lambda i: (-len(docs[i][1] or ""), docs[i][0] is None, docs[i][0] or 0)) for p, at in groups.items()}
    return [(docs[i][0], docs[keep[p]][0], len(groups[p]), i == keep[p], hashlib.sha256(p.encode()).hexdigest()) for i, p in enumerate(plain)]


@pytest.mark.parametrize("hot,small", [(4096, 1_000_000), (10, 1_000_000), (10, 3)])
def test_exact_dedup_equals_brute_force(spark, monkeypatch, hot, small):
    monkeypatch.setattr(exactdup, "HOT", hot)
    monkeypatch.setattr(exactdup, "BROADCAST_IDS", small)
    docs = rows()
    got = exact_groups(frame(spark, docs))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = brute_exact(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    without = exact_groups(frame(spark, docs).repartition(7), digest=False)
    assert sorted(map(tuple, without.collect()), key=repr) == sorted((w[:4] for w in want), key=repr)


def test_exact_dedup_keeps_rows_and_columns(spark):
    docs = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, "c"), (6, "c")]
    out = exact_dedup(frame(spark, docs))
    assert out.columns == frame(spark, docs).columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(3, "a  b"), (4, None), (6, "c"), (6, "c")]
    assert exact_dedup(frame(spark, docs).limit(0)).count() == exact_groups(frame(spark, docs).limit(0)).count() == 0


def brute_infill(docs):
    out = []
    for doc_id, text in docs:
        t = text or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        made = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        chars = (None, None) if form == "plain" else (len(p), len(m))
        out.append((doc_id, len(units), form, *chars, *(hashlib.sha256(x.encode()).hexdigest() for x in (made, t)), made))
    return out


@pytest.mark.parametrize("size", [4 << 20, 2000])
def test_fill_in_middle_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(infill, "BYTES", size)
    docs = rows(2)
    got = fill_in_middle(frame(spark, docs))
    want = brute_infill(docs)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_fill_in_middle_edge_cases(spark):
    assert fill_in_middle(frame(spark, rows()).limit(0)).count() == 0
    assert {r.form for r in fill_in_middle(frame(spark, [(i, "a b c") for i in range(50)]), rate=100, spm_rate=0).collect()} == {"psm"}
    with pytest.raises(ValueError):
        fill_in_middle(frame(spark, rows()), rate=101)


def brute_search(docs, items, k=10):
    lower = {c: c + 32 for c in range(65, 91)}
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    held = [(i, Counter(terms(t))) for i, t in docs]
    some = [c for _, c in held if c]
    n_docs, n_terms, df = len(some), sum(c.total() for c in some), Counter(t for c in some for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in held:
            m = 25 + 75 * c.total() * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return out


ITEMS = [(1, "The naïve 日本 of the x9"), (2, "zz"), (3, None), (4, "--"), (5, "copy of copies"), (5, "copy of copies"), (6, "unknown words"), (None, "a b the the the")]


@pytest.mark.parametrize("impacts,block", [(1 << 20, 8 << 20), (50, 20)])
def test_search_equals_brute_force(spark, monkeypatch, impacts, block):
    monkeypatch.setattr(search, "IMPACTS", impacts)
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    docs = rows(3)
    items = spark.createDataFrame([(*i, 1, "s") for i in ITEMS], "item_id long, text string, row int, score string")
    got = ranked_search(frame(spark, docs), items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_search(docs, ITEMS), key=repr)


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search(frame(spark, rows()).limit(0), items).count() == 0
    assert ranked_search(frame(spark, [(1, "--"), (2, None)]), items).count() == 0
    assert ranked_search(frame(spark, [(1, "the")]), items.limit(0)).count() == 0


def test_radix_order_is_stable():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000) // 7 * 7 % (1 << 33)
    assert (search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    best = search.Best(2)
    best.add(np.array([1, 1, 1, 1]), np.array([5, 5, 5, 0]), [None, 9, 3, 1])
    assert sorted(best.rows()) == [(1, 5, 3), (1, 5, 9)]
    assert search.terms_of(np.frombuffer(b"", np.uint8), np.array([0, 0]))[0] == pa.array([], pa.large_binary())


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_fill_in_middle", "op13_exact_dedup"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    theirs = con.sql(ORACLES[name])
    at = [theirs.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr)
