"""Line dedup and mixing against plain Python, edge cases, and the stages of the pipeline on a small corpus."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from courtfold.llm import mixing
from courtfold.llm.linededup import line_dedup
from courtfold.llm.quality import quality_rules
from test_neardup import brute as brute_groups

DDL = "doc_id long, text string, lang string, source string, n_lines string"


def rows(spark):
    out = [(i, f"menu\npage {i}\n\nmenu\nlast {i % 4}", "en", "a", "x") for i in range(20)]
    out += [(100 + i, f"menu\nonly {i}", None, "b", None) for i in range(4)]
    return spark.createDataFrame([*out, (200, None, "en", None, "x"), (201, "", "en", None, "x"), (None, "menu", "de", "a", "x"), (3, "menu", "en", "a", "x")], DDL)


def brute_lines(docs, ratio=0.1, least=5):
    pages, on = Counter(r.source for r in docs), defaultdict(int)
    for r in docs:
        for line in set((r.text or "").split("\n")):
            if line.strip(" "):
                on[r.source, line] += 1
    common = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    return [(r.doc_id, "\n".join(x for x in (r.text or "").split("\n") if (r.source, x) not in common)) for r in docs]


def test_line_dedup_equals_brute_force(spark):
    docs = rows(spark)
    found = line_dedup(docs)
    assert sorted(((r.doc_id, r.kept_text) for r in found.collect()), key=repr) == sorted(brute_lines(docs.collect()), key=repr)
    assert found.filter("doc_id = 100").first().kept_text == "menu\nonly 0"  # frequent elsewhere only
    assert dict(found.dtypes)["n_lines"] == "int"  # the clashing column is replaced
    assert line_dedup(docs.limit(0)).count() == 0


def test_mixing_spends_the_budget_in_whole_documents(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "en" if i % 3 else "de", f"src{i % 4}") for i in range(400)], "doc_id long, text string, lang string, source string")
    used = mixing.mix_sources(docs, mixing.domain_of(), mixing.WEIGHTS, budget_share=0.5, max_epochs=2, seed=1).collect()
    assert len(used) == 400
    total, leaves = sum(r.n_tokens for r in used), defaultdict(list)
    for r in used:
        leaves[r.domain, r.lang, r.source].append(r)
    spent = sum(r.n_tokens * r.epochs for r in used)
    assert 0.5 * total - len(leaves) <= spent <= 0.5 * total + 5 * len(leaves)  # each leaf ends with the document that reaches its budget
    assert all(max(r.epochs for r in leaf) - min(r.epochs for r in leaf) <= 1 for leaf in leaves.values())
    again = mixing.mix_sources(docs.repartition(5), mixing.domain_of(), mixing.WEIGHTS, budget_share=0.5, max_epochs=2, seed=1).collect()
    assert sorted(map(tuple, used)) == sorted(map(tuple, again))


def test_mixing_gives_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "src0", 10), ("web", "en", "src3", 1000), ("books", "en", "src1", 1000)], "domain string, lang string, source string, tokens long")
    budgets = {r.source: r.budget for r in mixing.leaf_budgets(leaves, {}, 400.0, 1.0, 1).collect()}
    assert budgets == {"src0": 10, "src3": 190, "src1": 200}


def test_mixing_edge_cases(spark):
    used = {r.doc_id: r for r in mixing.mix_sources(rows(spark), mixing.domain_of(), {}, budget_share=1.0, max_epochs=1).collect()}
    assert used[200].n_tokens == used[201].n_tokens == 0 and None in used
    assert mixing.mix_sources(rows(spark).limit(0), mixing.domain_of(), {}).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_stages_do_what_their_operators_decide(spark, corpus):
    docs = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "quality rules":
            assert set(after) == {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
        elif name == "line dedup":
            assert {k: r.text for k, r in after.items()} == dict(brute_lines(docs.collect())) and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "SimHash near-dedup":
            # five-word shingles at Jaccard 0.8, as stages on word shingles take
            assert set(after) == {least for _, least in brute_groups([(r.doc_id, r.text) for r in docs.collect()])}
        else:
            tokens = lambda rs: sum(len(r.text.split()) for r in rs)
            assert tokens(after.values()) >= 0.6 * tokens(before.values()) and all(before[k] == r for k, r in after.items())
        docs = out
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert coded.count() == docs.count() and coded.filter(~F.col("round_trip")).count() == 0


def test_mixing_passes_on_what_branches_of_weight_zero_leave(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 500), ("web", "de", "b", 10), ("books", "en", "c", 1000)], "domain string, lang string, source string, tokens long")
    budgets = {r.source: r.budget for r in mixing.leaf_budgets(leaves, {("web", "en"): 0.0}, 200.0, 1.0, 1).collect()}
    assert budgets == {"a": 0, "b": 10, "c": 190}


def fill_by_hand(children, budget):
    """{name: share} of a budget among {name: (weight, cap)}: by weight, and again by weight among those with room for what full ones can't take."""
    out, open_ = dict.fromkeys(children, 0.0), {k for k, (w, cap) in children.items() if w > 0}
    while open_ and budget > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] - out[k] <= budget * children[k][0] / total}
        if not full:
            for k in open_:
                out[k] += budget * children[k][0] / total
            break
        given = {k: children[k][1] - out[k] for k in full}
        for k, x in given.items():
            out[k] += x
        budget -= sum(given.values())
        open_ -= full
    return out


def test_budgets_equal_a_plain_descent(spark):
    import random

    rng = random.Random(9)
    leaves = [(d, g, s, rng.choice([0, 10, 200, 3000])) for d in ("web", "books", "x") for g in ("en", "de") for s in ("a", "b", "c") if rng.random() < 0.8]
    weights = {("web",): 0.6, ("books",): 0.1, ("*", "de"): 2.0, ("web", "en", "a"): 0.0, ("x", "en"): 0.0}

    def weight(*path):
        fits = [w for rule, w in weights.items() if len(rule) == len(path) and all(a in ("*", b) for a, b in zip(rule, path))]
        return fits[-1] if fits else 1.0

    cap = {x[:3]: 2 * x[3] if all(weight(*x[: i + 1]) > 0 for i in range(3)) else 0 for x in leaves}
    under = lambda *path: sum(c for k, c in cap.items() if k[: len(path)] == path)
    for budget in (0, 50, 900, 6000, 10**6):
        want = {}
        for d, x in fill_by_hand({d: (weight(d), under(d)) for d in {k[0] for k in cap}}, budget).items():
            for g, y in fill_by_hand({g: (weight(d, g), under(d, g)) for g in {k[1] for k in cap if k[0] == d}}, x).items():
                for s, z in fill_by_hand({s: (weight(d, g, s), cap[d, g, s]) for s in {k[2] for k in cap if k[:2] == (d, g)}}, y).items():
                    want[d, g, s] = int(z + 1e-6)
        frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
        assert {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(frame, weights, float(budget), 1.0, 2).collect()} == want


def test_rows_are_mixed_in_place_as_the_plan_says_whatever_columns_are_called(spark):
    rows = [(i if i % 7 else None, "w " * (1 + i % 5) + str(i), "en" if i % 3 else "de", f"src{i % 4}", "t", i, "e") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, turn string, whole int, epochs string")
    args = (mixing.domain_of(), mixing.WEIGHTS)
    uses = Counter(r.doc_id for r in mixing.mix_sources(docs, *args, budget_share=0.7, max_epochs=2, seed=3).collect() for _ in range(r.epochs))
    mixed = mixing.mixed_documents(docs, *args, budget_share=0.7, max_epochs=2, seed=3)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == uses
    assert mixing.mixed_documents(docs.limit(0), *args).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "menu\nx" + str(i), "a", "h", "k", "r") for i in range(9)], "doc_id long, text string, source string, known_host string, kept string, row string")
    got = line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped", "kept_text"] and got.filter("kept = 'k' and row = 'r' and kept_text like 'x%'").count() == 9


def test_stages_take_empty_tables_and_nulls(spark, corpus):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, corpus.limit(0), "").count() == 0, name
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "src1", 0), (1, "", "en", "src1", 0), (None, "x " * 30, None, None, 60)], corpus.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and out.count() <= 4, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() == 4
