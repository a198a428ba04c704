import random

import xxhash

from courtfold.llm.simhash import fingerprint, fingerprint_links, simhash_dedup, simhash_groups

SCHEMA = "doc_id long, text string, u int, fp string, node string"


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(rows, most=4):
    parent = {i: i for i in range(len(rows))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {(k, f"{fp:016x}", least[find(i)]) for i, (k, fp) in enumerate(rows)}


def texts(rng, n):
    base = [" ".join(rng.choice("alpha Beta gamma delta eps Étude zeta".split()) for _ in range(rng.randint(0, 90))) for _ in range(n // 3)]
    out = [None, "", " \t\n", "one", "one two three", "x y z\x1cw four five six", "word " * 5000]
    for _ in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return out


def test_fingerprint_matches_the_definition():
    for text in texts(random.Random(1), 60):
        assert fingerprint((text or "").encode()) == plain(text)


def test_groups_match_brute_force(spark):
    rows = [(i * 3 + 1, t, 1, "x", "y") for i, t in enumerate(texts(random.Random(2), 150))]
    got = {tuple(r)[:3] for r in simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_groups([(r[0], plain(r[1])) for r in rows])


def test_links_lose_nothing_in_dense_and_spread_prints(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(20)]
    prints = {c for c in centres}
    for c in centres:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            prints.add(x)
    prints |= {centres[0] ^ (x << 43) for x in range(0, 1 << 12, 2)}
    rows = [(x, x) for x in sorted(prints)]
    want = {}
    for k, h, c in brute_groups(rows):
        want.setdefault(c, set()).add(k)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    got = {}
    for node, c in fingerprint_links(frame).collect():
        got.setdefault(c, set()).add(node % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_nulls_repeats_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a b", 1, "", ""), (2, "a b", 1, "", ""), (2, "a b", 1, "", ""), (3, None, None, None, None)], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash_groups(frame).collect())
    assert got == [(-1, 2), (2, 2), (2, 2), (3, 3)]
    assert simhash_groups(frame.limit(0)).count() == 0
    kept = simhash_dedup(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]
