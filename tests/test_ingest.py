"""Deliveries twice, merges over chains and cycles, partitions switched by manifest, and cases of parsers and repairs as literal rows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from courtfold.operators import identity as D
from courtfold.operators import ingest as I
from courtfold.operators import merges as M
from courtfold.operators import store as S
from courtfold.sources import feeds, files, wiki

GAMES = "game_id string, source string, source_game_id string, competition_id long, season string, game_ts timestamp, home_id long, away_id long, home_score int, away_score int, status string, round_name string, eligible boolean, exclusion_reason string, manual boolean"
DELIVERY = "source string, source_game_id string, competition_id long, season string, game_ts timestamp, home_id long, away_id long, home_score int, away_score int, status string, round_name string, exclusion_reason string, row_no int"
NOON = datetime(2024, 3, 5, 12)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def stored(spark):
    game = lambda i, source, ts, h, a, hs, as_, status, manual=False: (i, source, i, 1, "2023-2024", ts, h, a, hs, as_, status, "r", True, None, manual)
    return spark.createDataFrame([
        game("own", "off", NOON, 1, 2, 80, 70, "finished"), game("hand", "off", NOON, 3, 4, 60, 50, "finished", True), game("live1", "live", NOON, 5, 6, 90, 80, "finished"),
        game("live2", "live", NOON - timedelta(hours=3), 7, 8, None, None, "scheduled"), game("live3", "live", NOON + timedelta(hours=3), 7, 8, None, None, "scheduled"),
        game("far", "live", NOON + timedelta(hours=37), 9, 10, None, None, "scheduled"), game("other", "oth", NOON, 11, 12, 75, 74, "finished"),
    ], GAMES)


def delivery(spark):
    game = lambda i, h, a, hs, as_, status="finished", n=1, ts=NOON: ("off", i, 1, "2023-2024", ts, h, a, hs, as_, status, "q", None, n)
    return spark.createDataFrame([
        game("own", 1, 2, 81, 70), game("own", 1, 2, 82, 70, n=2), game("hand", 3, 4, 1, 2), game("a", 5, 6, None, None, "scheduled"), game("b", 7, 8, 66, 65), game("c", 9, 10, 66, 65),
        game("d", 11, 13, 75, 74), game("e", 14, 12, 75, 74),
    ], DELIVERY)


TEAMS = [(i, "ES" if i in (12, 13) else f"C{i}") for i in range(1, 15)]


def test_backfill_by_precedence_and_twice(spark):
    teams, seasons = spark.createDataFrame(TEAMS, "team_id long, country string"), spark.createDataFrame([], "competition_id long, season string")
    done = I.backfill(stored(spark), delivery(spark), teams, seasons)
    outcome = {r.source_game_id: r.outcome for r in done["outcomes"].collect()}
    assert outcome == {"own": "updated", "hand": "updated", "a": "reconciled", "b": "ambiguous", "c": "inserted", "d": "duplicate", "e": "inserted"}
    games = {r.source_game_id: r for r in done["games"].collect()}
    assert (games["own"].home_score, games["hand"].home_score) == (82, 60)
    assert (games["a"].game_id, games["a"].source, games["a"].home_score, games["a"].status) == ("live1", "off", 90, "finished")
    assert rows_of(done["seasons"]) == [(1, "2023-2024")]
    kept = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in done.items()}
    again = I.backfill(kept["games"], delivery(spark), teams, kept["seasons"])
    # the schedule that was reconciled is its own game now, so its result is the delivery's
    same = lambda df: rows_of(df.filter("source_game_id <> 'a'"))
    assert same(again["games"]) == same(kept["games"]) and rows_of(again["seasons"]) == rows_of(kept["seasons"])
    third = I.backfill(spark.createDataFrame(again["games"].collect(), again["games"].schema), delivery(spark), teams, kept["seasons"])
    assert rows_of(third["games"]) == rows_of(again["games"])


def test_daily_candidates_twice_change_nothing(spark):
    planned = stored(spark).withColumns({"source": F.lit("plan"), "home_score": F.lit(None).cast("int"), "away_score": F.lit(None).cast("int"), "status": F.lit("scheduled")}).filter("game_id <> 'far'")
    known = spark.createDataFrame([(1, "League", "ES", True), (2, "Old", "ES", False)], "competition_id long, competition_name string, country string, active boolean")
    aliases = spark.createDataFrame(
        [(i, "day", f"t{i}", f"Team {i}", "ES") for i in range(1, 15)] + [(99, "x", "q", "team  5", "ES")], "team_id long, source string, source_team_id string, alias_name string, country string")
    c = lambda i, h, a, hs, status="finished", comp=" league ", ids=(None, None): (i, "es", comp, NOON + timedelta(hours=int(i != "unclear")), h, a, *ids, hs, 50 if hs else None, status, "s", 1)
    candidates = spark.createDataFrame([
        c("fix", "Team 1", "Team 2", 77), c("unclear", "Team 7", "Team 8", 60), c("new", "Team 13", "Team 14", 70), c("twins", "Team 5", "Nobody", None), c("named", "Team 5", "Team 6", 71, ids=("t5", "t6")),
        c("lost", "Team 1", "Team 2", 70, comp="Cup"), c("old", "Team 1", "Team 2", 70, comp="Old"), c("never", "Team 3", "Team 4", 70), c("next", "Team 9", "Team 10", None, "scheduled"), c("off", "Team 9", "Team 11", None, "postponed"),
    ], "source_game_id string, country string, competition string, game_ts timestamp, home string, away string, home_source_id string, away_source_id string, home_score int, away_score int, status string, stage string, row_no int")
    reviews = spark.createDataFrame([("never", "ignored", "x", None), ("new", "open", "x", None)], "source_game_id string, status string, reasons string, assigned_game_id string")
    seasons = spark.createDataFrame([], "competition_id long, season string")
    done = I.daily(planned, candidates, reviews, known, aliases, seasons, "day")
    assert {r.source_game_id: (r.outcome, r.reasons) for r in done["outcomes"].collect()} == {
        "fix": ("reconciled", None), "unclear": ("review", "ambiguous_planned_fixture"), "new": ("inserted", None), "twins": ("review", "ambiguous_home_team,unresolved_away_team,invalid_result"),
        "named": ("reconciled", None), "lost": ("review", "unknown_competition"), "old": ("skipped", None), "never": ("ignored", None), "next": ("inserted", None), "off": ("inserted", None)}
    games = {r.source_game_id: r for r in done["games"].collect()}
    assert (games["own"].source, games["own"].home_score, games["own"].eligible) == ("plan", 77, True)
    assert (games["off"].eligible, games["off"].exclusion_reason, games["next"].exclusion_reason) == (False, "current_result_not_final", None)
    told = {r.source_game_id: (r.status, r.assigned_game_id) for r in done["reviews"].collect()}
    assert told == {"never": ("ignored", None), "new": ("resolved", None), "fix": ("resolved", "own"), "named": ("resolved", "live1"), "unclear": ("open", None), "twins": ("open", None), "lost": ("open", None)}
    kept = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in done.items()}
    again = I.daily(kept["games"], candidates, kept["reviews"], known, aliases, kept["seasons"], "day")
    for k in ("games", "reviews", "seasons"):
        assert rows_of(again[k]) == rows_of(kept[k]), k
    assert {k: v.count() for k, v in I.daily(planned, candidates.limit(0), reviews, known, aliases, seasons, "day").items()} == {"games": planned.count(), "seasons": 0, "reviews": 2, "outcomes": 0}


def test_chains_end_and_cycles_are_refused(spark):
    moves = spark.createDataFrame([(i, i - 1) for i in range(2, 40)] + [(50, 51), (51, 52), (52, 50), (60, 50), (70, 71), (70, 72), (80, 80)], "source_id long, target_id long")
    closed, cyclic = M.closed_moves(moves)
    assert rows_of(closed) == sorted(((i, 1) for i in range(2, 40)), key=repr)
    assert sorted(r.source_id for r in cyclic.collect()) == [50, 51, 52, 60, 70, 80]
    assert M.closed_moves(moves.limit(0))[0].count() == 0


def test_moves_are_refused_with_a_reason(spark):
    moves = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (6, 4), (7, 99), (8, 1), (9, 10), (10, 9)], "source_id long, target_id long")
    teams = spark.createDataFrame([(i,) for i in range(1, 11)], "team_id long")
    games = spark.createDataFrame([(2, 4), (3, 5), (5, 6), (7, 1)], "home_id long, away_id long")
    good, refused = M.guarded_moves(moves, teams, games, [])
    assert rows_of(good) == [(2, 1), (3, 1)]
    assert {r.source_id: r.reason for r in refused.collect()} == {5: "met", 6: "met", 7: "missing target", 8: "nothing to move", 9: "cycle", 10: "cycle"}


def test_a_merge_keeps_the_targets_own_rows(spark):
    moves = spark.createDataFrame([(2, 1), (3, 1)], "source_id long, target_id long")
    tables = {
        "teams": spark.createDataFrame([(1, 2, None), (2, None, 1), (3, None, None), (4, 3, 2)], "team_id long, predecessor_id long, successor_id long"),
        "aliases": spark.createDataFrame([(1, 2, "s", "x", "A"), (2, 1, "s", "x", "A"), (3, 3, "s", "y", "B")], "alias_id long, team_id long, source string, source_team_id string, alias_name string"),
        "games": spark.createDataFrame([(1, 2, 4), (2, 4, 3)], "game_id long, home_id long, away_id long"),
        "history": spark.createDataFrame([("p", "r", 1, 3, 4, 1.0), ("p", "r", 1, 2, 4, 2.0), ("p", "r", 2, 1, 3, 3.0), ("p", "r", 2, 2, 3, 4.0)], "pool string, ruleset string, game_id long, team_id long, opponent_id long, post double"),
        "ratings": spark.createDataFrame([("p", "r", 2, 5), ("p", "r", 3, 9), ("q", "r", 1, 1), ("q", "r", 2, 8)], "pool string, ruleset string, team_id long, games long"),
        "findings": spark.createDataFrame([(1, 1, 2, "names", "open"), (2, 2, 4, "names", "open"), (3, 4, 3, "names", "open")], "finding_id long, left_id long, right_id long, finding_type string, status string"),
    }
    out = {k: rows_of(v) for k, v in M.merge_all(tables, moves).items()}
    assert out["teams"] == [(1, None, None), (4, 1, 1)]
    assert [(r[0], r[1]) for r in out["aliases"]] == [(2, 1), (3, 1)]
    assert out["games"] == [(1, 1, 4), (2, 4, 1)]
    assert [(r[2], r[3], r[5]) for r in out["history"]] == [(1, 1, 2.0), (2, 1, 3.0)]
    assert out["ratings"] == [("p", "r", 1, 9), ("q", "r", 1, 1)]
    assert [r[0] for r in out["findings"]] == [2]


def test_readers_see_old_rows_until_the_manifest_names_new_ones(spark, tmp_path, monkeypatch):
    path, schema = f"{tmp_path}/t", "n long, pool string"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    assert S.published(spark, path, schema).count() == 0
    S.publish(make((1, "a"), (2, "b"), (3, "c")), path, ["pool"])

    def fails(self, name, text):
        raise OSError("the writer died")

    with monkeypatch.context() as m:
        m.setattr(S.Folder, "create", fails)
        with pytest.raises(OSError):
            S.publish(make((9, "a")), path, ["pool"], [("b",)])
    assert rows_of(S.published(spark, path, schema)) == [(1, "a"), (2, "b"), (3, "c")]
    S.publish(make((9, "a")), path, ["pool"], [("a",), ("b",)])
    assert rows_of(S.published(spark, path, schema)) == [(3, "c"), (9, "a")]
    with pytest.raises(ValueError):  # another writer began with the same manifest
        S.Folder(spark, path).create("manifest-000000002", "{}")
    assert S.clean(spark, path) == 2 and rows_of(S.published(spark, path, schema)) == [(3, "c"), (9, "a")]


def test_undated_games_follow_the_later_of_both_ends(spark):
    d = lambda n: date(2000, 1, 1) + timedelta(n)
    games = spark.createDataFrame([
        ("s", "MAIN", 1, d(100)), ("s", "SEMI", 2, d(110)), ("s", "SEMI", 3, None), ("s", "FINAL", 4, None), ("s", "FINAL", 5, None),
        ("t", "MAIN", 6, d(0)), ("t", "EIGHT", 7, d(30)), ("t", "EIGHT", 8, None), ("t", "SEMI", 9, None), ("u", "MAIN", 10, None), ("u", "SEMI", 11, None),
    ], "season string, stage string, game_id long, game_date date")
    got = {r.game_id: r.game_date for r in feeds.filled_dates(games, "season", ["MAIN", "EIGHT", "SEMI", "FINAL"], "game_id", ("EIGHT",)).collect()}
    assert got == {1: d(100), 2: d(110), 3: d(111), 4: d(112), 5: d(113), 6: d(0), 7: d(30), 8: d(1), 9: d(31), 10: None, 11: None}


def test_duplicates_need_both_sides(spark):
    teams = spark.createDataFrame([(1, "ES"), (2, "ES"), (3, "FR"), (4, "IT"), (5, None)], "team_id long, country string")
    day = date(2000, 1, 1)
    games = spark.createDataFrame([
        (1, "a", "s", day, 80, 70, 1, 3), (2, "b", "s", day, 80, 70, 2, 3), (3, "c", "s", day, 80, 70, 1, 4), (4, "d", "t", day, 80, 70, 1, 3), (5, "a", "s", day, 80, 70, 1, 3), (6, "e", "s", day, 80, 70, 5, 3), (7, "f", "s", day, 80, 70, 5, 3),
    ], "game_id long, source string, season string, game_date date, home_score int, away_score int, home_id long, away_id long")
    assert [r[:2] for r in rows_of(D.same_day_duplicates(games, teams))] == [(1, 2), (2, 5), (6, 7)]


def test_schedules_of_a_matrix(spark):
    names = ["D", "A", "C", "B"]
    teams = spark.createDataFrame([("p", i, n) for i, n in enumerate(names)] + [("odd", i, n) for i, n in enumerate("XYZ")], "page string, row_no int, team string")
    grid = [("p", 1963, h, a) for h in names for a in names if h != a] + [("odd", 1963, h, a) for h in "XYZ" for a in "XYZ" if h != a]
    games = spark.createDataFrame(grid, "page string, start_year int, home string, away string")
    got = {(r.home, r.away): (r.round_no, r.game_date) for r in files.scheduled(games, teams, [0, 6, 13]).collect()}
    # the first stays, the others move on by one a round
    pairs = {1: ("DB", "AC"), 2: ("DC", "BA"), 3: ("DA", "CB")}
    assert {k: v[0] for k, v in got.items()} == {key: r + 3 * (key[0] > key[1]) for r, two in pairs.items() for p in two for key in (tuple(p), tuple(p[::-1]))}
    assert got["B", "D"] == (1, date(1963, 9, 28)) and got["D", "B"] == (4, date(1963, 10, 11))
    assert files.scheduled(games.filter("home <> 'D' or away <> 'A'"), teams, [0]).count() == 0


def test_wikitext_of_all_kinds():
    page = """== First round ==
=== Group A ===
{{TwoLegResult|[[Real Madrid Baloncesto|Real Madrid]]|{{flag|ESP|{{x}}}}|150–140|[[CSKA]]|{{flag|URS}}|80–70|70–70}}
{{ThreeLegResult|[[A]]||2–1|[[B]]||60–50<ref>Un partido de desempate en {{c|Paris}}: [[B]] - [[A]] 77–76</ref>|[[x]]|50–60|61–60}}
{{TwoLegResult|[[Unclosed]]|1–1|[[X]]|1–0
== Final ==
{| class="wikitext"
! !! A !! B !! C
|-
| A || - || 80–70 || 81–71
|-
| B || 82–72 || || 83–73
|-
| C || 84–74 || 85–75 || —
|}
{| class="w"
|-
| [[E|Ee]] || 1–1 || style="x" | [[F]] || 90–80
| 70–75
|-
| 77–88 || 1–1 || [[F]] || 90–80 || 1–2
|}
{{8TeamBracket|RD1-team1=[[G]]|RD1-score1=66|RD1-team2='''[[H]]'''|RD1-score2=67|RD2-team1=[[H]]|RD2-score1-1=1|RD2-score1-2=2|RD2-team2=bye}}"""
    got = wiki.games_of(page)
    assert [g[:3] for g in got[:2]] == [("twoleg", "First round", "Group A")] * 2
    assert [g[3:] for g in got if g[0] == "twoleg"] == [(1, "Real Madrid", "CSKA", 80, 70), (2, "CSKA", "Real Madrid", 70, 70)]
    assert [g[3:] for g in got if g[0] == "threeleg"] == [(1, "A", "B", 60, 50), (2, "B", "A", 60, 50), (3, "A", "B", 61, 60)]
    assert [g[3:] for g in got if g[0] == "tie-break"] == [(1, "B", "A", 77, 76)]
    assert [g[3:] for g in got if g[0] == "matrix"] == [(1, "A", "B", 80, 70), (1, "A", "C", 81, 71), (1, "B", "A", 82, 72), (1, "B", "C", 83, 73), (1, "C", "A", 84, 74), (1, "C", "B", 85, 75)]
    assert [g[1:] for g in got if g[0] == "table"] == [("Final", None, 1, "Ee", "F", 90, 80), ("Final", None, 2, "F", "Ee", 75, 70)]
    assert [g[3:] for g in got if g[0] == "bracket"] == [(1, "G", "H", 66, 67)]
    assert wiki.games_of("") == wiki.games_of("]] }} |}\n|}") == []


def test_late_games_are_flagged_and_their_pools_replayed(spark, tmp_path):
    from courtfold.functions import rating as X
    from courtfold.operators import rating as E
    from courtfold.streaming.replay import caught_up, ratings_stream

    rules = X.ruleset("adjusted-v1")
    row = lambda pool, d: (pool, date(2000, 1, d), "s", str(d), d, 1, "1999-2000", d % 3, (d + 1) % 3, 80 + d % 5, 81, True, "finished")
    schema = "pool string, game_date date, source string, source_game_id string, game_id long, competition_id long, season string, home_id long, away_id long, home_score long, away_score long, eligible boolean, status string"
    days = [[1, 2, 5, 7], [3, 8, 10], [12, 13]]
    every = spark.createDataFrame([row("a", d) for part in days for d in part] + [row("b", d) for d in range(1, 14)], schema)
    for k, (part, more) in enumerate(zip(days, (range(1, 5), range(5, 11), range(11, 14)))):
        spark.createDataFrame([row("a", d) for d in part] + [row("b", d) for d in more], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        ratings_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), rules).writeStream.format("parquet").option(
            "checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out")
    assert [(r.pool, r.game_id, r.post) for r in streamed.filter("late").collect()] == [("a", 3, None)]
    cols = ["pool", "game_id", "team_id", "pre", "post", "games_before", "rank_after"]
    assert rows_of(caught_up(streamed, every, rules).select(*cols)) == rows_of(E.replay(every, [rules]).select(*cols))


def test_an_audit_computes_changed_seasons_only(spark, tmp_path):
    from courtfold.operators.audit import audit

    schema = "season string, game_date date, home_id long, away_id long, home_score int, away_score int"
    games = spark.createDataFrame([(f"s{i % 3}", date(2000, 1, 1 + i), i, i + 1, 80, None if i == 4 else 70) for i in range(9)], schema)
    path = f"{tmp_path}/ledger"
    assert not any(r.resumed for r in audit(games, path).collect())
    assert all(r.resumed for r in audit(games.repartition(5), path).collect()) and len(S.Folder(spark, path).names()) == 2
    changed = games.filter("season <> 's2'").unionByName(games.filter("season = 's1'"))
    assert rows_of(audit(changed, path)) == [("s0", 3, 0, 0, True), ("s1", 6, 2, 3, False)]
    folders = [n for n in S.Folder(spark, path).names() if n.startswith("v-")]
    assert sorted(len([x for x in S.Folder(spark, path).names(n) if "=" in x]) for n in folders) == [1, 3]


def test_names_in_text_take_the_longest_and_leave_doubtful_ones(spark):
    from courtfold.operators.audit import names_in_text

    names = spark.createDataFrame([(1, "Real"), (2, "Real Madrid"), (3, "Zadar"), (4, "KK Zadar"), (5, "Split"), (6, "split"), (7, "")], "team_id long, name string")
    texts = ["about real madrid.", "REAL", "Real, Madrid and Zadar", "kk zadar", "Split", "Realm", None, "zadar Zadar", "real real madrid"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id int, text string")
    assert dict(map(tuple, names_in_text(rows, names).collect())) == {0: 2, 1: 1, 3: 4, 7: 3}
    assert names_in_text(rows, names.limit(0)).count() == names_in_text(rows.limit(0), names).count() == 0


def test_similar_names_meet_in_small_blocks_and_lose_no_pair(spark):
    import random

    from courtfold.functions.text import similar

    rng = random.Random(5)
    names = ["BASK" + "".join(rng.choice("ABCDEFGH") for _ in range(rng.randint(2, 16))) for _ in range(150)]
    for n in names[:60]:
        i = rng.randrange(len(n))
        names += [n[:i] + rng.choice("XYZ") + n[i + 1 :], n[:i] + n[i + 1 :], n + "TEAM", n[:6] + "QQ" + n[6:]]
    names += ["BAS", "BAS", "AB"]
    frame = spark.createDataFrame(list(enumerate(names)), "team_id int, name string")
    got = {(r.left_id, r.right_id) for r in D.similar_names(frame).collect()}
    a, b = frame.withColumnsRenamed({"team_id": "i", "name": "a"}), frame.withColumnsRenamed({"team_id": "j", "name": "b"})
    want = {tuple(r) for r in a.crossJoin(b).filter("i < j").filter(similar(F.col("a"), F.col("b"))).select("i", "j").collect()}
    assert got == want and len(want) > 100
    blocks = D.rarest_blocks(frame).select(F.explode("prefix").alias("block")).groupBy("block").count()
    assert blocks.agg(F.max("count")).first()[0] < len(set(names)) / 4


def test_written_tables_follow_their_inputs(spark, tmp_path, monkeypatch):
    from courtfold.plans import adapter

    monkeypatch.setattr(adapter, "_shared", lambda _: f"{tmp_path}/shared")
    make = lambda n: spark.range(n).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/sf/t.parquet")
    read = lambda: adapter.written(spark, f"{tmp_path}/sf", "t", lambda: spark.read.parquet(f"{tmp_path}/sf/t.parquet")).count()
    make(3)
    before = adapter.state_of(spark, f"{tmp_path}/sf")
    assert read() == 3 == read() and adapter.state_of(spark, f"{tmp_path}/sf") == before
    make(5)
    assert read() == 5 and len(list((tmp_path / "shared").iterdir())) == 1
