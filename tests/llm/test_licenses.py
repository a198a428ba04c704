import random
import re

from courtfold.llm.licenses import TEMPLATES, bands_for, license_scan

SCHEMA = "doc_id long, text string, template string, n int, words string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(ws):
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows, threshold=0.8):
    out = {}
    for doc_id, text in rows:
        ws = words(text)
        for name, notice in TEMPLATES.items():
            want, n = shingles(words(notice)), len(words(notice))
            best = max((len(shingles(ws[s : s + n]) & want) / len(want) for s in range(len(ws))), default=0)
            if best >= threshold:
                out[doc_id, name] = max(best, out.get((doc_id, name), 0))
    return out


def documents():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "Released under the MIT License."), (3, "released under the mit"), (None, "x Released under the MIT License")]
    notices = list(TEMPLATES.values())
    for i in range(10, 130):
        ws = [rng.choice("licensed under the work is a of software b c d".split()) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(notices).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                notice[rng.randrange(len(notice))] = "changed"
            for _ in range(rng.choice([0, 0, 0, 1, 2])):  # the best span then begins between two alignments
                at = rng.randrange(len(notice))
                notice[at:at] = ["added"] * rng.randint(1, 9)
            if rng.random() < 0.2:
                del notice[: len(notice) // 8]
            at = rng.randint(0, len(ws))
            ws[at:at] = notice
        rows.append((i, " ".join(ws)))
    return rows


def test_matches_brute_force_containment(spark):
    rows = documents()
    frame = spark.createDataFrame([(*r, "t", 1, "w") for r in rows + rows[-3:]], SCHEMA)
    got = {(r.doc_id, r.template): r.containment for r in license_scan(frame).collect()}
    assert got == brute(rows)
    assert license_scan(frame.limit(0)).count() == 0


def test_bands_follow_the_bound():
    assert bands_for(0.001) == 25 and 0.75 ** bands_for(1e-6) <= 1e-6


def test_runs_no_python(spark):
    frame = spark.createDataFrame([(1, "a", "t", 1, "w")], SCHEMA)
    plan = license_scan(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_texts_of_one_id_are_checked_each(spark):
    true = " ".join(f"t{i}" for i in range(12))
    near = " ".join(f"t{i}" for i in range(8)) + " other words stand here"  # hits at every alignment that the notice has
    for texts in ([true, near], [near, true]):
        rows = [(k, t, "t", 1, "w") for k in (5, None) for t in texts]
        got = {(r.doc_id, r.containment) for r in license_scan(spark.createDataFrame(rows, SCHEMA).coalesce(1), {"notice": true}).collect()}
        assert got == {(5, 1.0), (None, 1.0)}


def test_separate_places_are_counted_and_the_first_is_the_start(spark):
    notice = " ".join(f"t{i}" for i in range(12))
    gap = " other" * 30
    rows = [(1, f"a b {notice}{gap} {notice}{gap} {notice}", "t", 1, "w"), (2, f"{notice} {notice}", "t", 1, "w"), (3, f"x {notice}", "t", 1, "w")]
    got = {r.doc_id: (r.containment, r.start_word, r.n_places) for r in license_scan(spark.createDataFrame(rows + rows[-1:], SCHEMA), {"notice": notice}).collect()}
    assert got == {1: (1.0, 2, 3), 2: (1.0, 0, 2), 3: (1.0, 1, 1)}
