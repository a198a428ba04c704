import random
import re

import corpus_pipeline
from courtfold.llm.neardup import near_groups
from courtfold.llm.simhash import simhash_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    words = [w for w in re.split("[ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= threshold:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {(k, least[find(i)]) for i, (k, _) in enumerate(rows)}


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"changed{rng.random()}"
    return words


def documents(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [None, "", " \t\n", "one", "ONE", "one two three", "One two three four five"]
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randint(150, 250))
        rows.append(" ".join(words))
        rows.extend(" ".join(changed(rng, words, k)) for k in (1, 3, rng.randint(3, 9), 20))
    return list(enumerate(rows, 1))


def test_groups_match_brute_force(spark):
    rows = documents(4, 40)
    frame = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], SCHEMA)
    assert {tuple(r) for r in near_groups(frame).collect()} == brute(rows)
    assert near_groups(frame.limit(0)).count() == 0


def test_the_stage_drops_near_copies_that_simhash_leaves(spark):
    rng = random.Random(6)
    rows = []
    for i in range(30):
        words = rng.choices([f"w{i}" for i in range(500)], k=200)
        copy = changed(rng, words, 3)
        assert 0.8 <= jaccard(shingles(" ".join(words)), shingles(" ".join(copy))) < 0.9
        rows += [(2 * i, " ".join(words), "en", "a", 0), (2 * i + 1, " ".join(copy), "en", "a", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    stage = corpus_pipeline.STAGES[2][1]
    assert sorted(r.doc_id for r in stage(spark, frame, "").collect()) == list(range(0, 60, 2))
    assert len({r.component_id for r in simhash_groups(frame).collect()}) > 40


def test_null_ids_repeats_and_large_groups(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (5, text), (7, text + " end"), (None, "alone here"), *((100 + i, f"{text} end{i}") for i in range(300))]
    got = [tuple(r) for r in near_groups(spark.createDataFrame([(*r, "en", "a", 0) for r in rows], SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(k, None if t == "alone here" else 5) for k, t in rows], key=str)


def test_buckets_cut_by_shingles_give_the_same_groups(spark, monkeypatch):
    from courtfold.llm import neardup

    rng = random.Random(8)
    bases = [[f"w{rng.randint(0, 99)}" for _ in range(rng.randint(60, 200))] for _ in range(6)]
    rows = [(i, " ".join(changed(rng, rng.choice(bases), rng.randint(0, 4)))) for i in range(60)]
    frame = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", 300)
    assert {tuple(r) for r in near_groups(frame).collect()} == brute(rows)
