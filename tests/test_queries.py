"""Every query with SQL gives the rows that DuckDB gives over the smallest tables; rules and edge cases of the operators."""

from __future__ import annotations

import math
from datetime import date
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from courtfold.functions import rating as X
from courtfold.functions import text as T
from courtfold.operators import changes as C
from courtfold.operators import rankings as R
from courtfold.operators import rating as E
from courtfold.plans import answer_queries, archive_queries, audit_queries, change_queries, feed_queries, game_queries, health_queries, identity_queries, ingest_queries, matching_queries, merge_queries, rating_queries, source_queries  # noqa: F401
from courtfold.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    theirs = con.sql(ORACLES[name])
    assert sorted(theirs.columns) == cols
    at = [theirs.columns.index(c) for c in cols]
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert mine, "nothing is shown by two empty results"
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=repr)


def test_rating_of_one_game():
    p, times, d = X.rate(90, 80, 1500, 1500, X.ruleset("basic-elo-v1"))
    assert 0.64 <= p <= 0.6401 and times == 1 and 7.19 <= d <= 7.21
    assert -12.81 <= X.rate(80, 81, 1500, 1500, X.ruleset("basic-elo-v1"))[2] <= -12.79
    assert 0.5993 <= X.rate(90, 80, 1500, 1500, X.ruleset("adjusted-v1"))[0] <= 0.5994
    with pytest.raises(ValueError):
        X.rate(80, 80, 1500, 1500, X.ruleset("basic-elo-v1"))
    with pytest.raises(ValueError):
        X.ruleset("none")
    with pytest.raises(ValueError):
        X.custom(k=0)


def test_points_of_a_series():
    assert [R.points_for(n) for n in (0, -1, 1, 60, 121)] == [120, 120, 2, 60, 120]


def _games(spark, rows):
    return spark.createDataFrame(rows, "pool string, game_date date, source string, source_game_id string, game_id long, competition_id long, season string, home_id long, away_id long, home_score long, away_score long, eligible boolean, status string")


ROWS = [("nba", date(2000, 1, d), "s", str(d), d, 1, "1999-2000", d % 3, (d + 1) % 3, 80 + d % 5, 81, d % 7 > 0, "finished") for d in range(1, 29)]


def test_replay_is_zero_sum_and_ignores_input_order(spark):
    rules = [X.ruleset("adjusted-v1")]
    a = E.replay(_games(spark, ROWS), rules).orderBy("seq", "is_home").collect()
    b = E.replay(_games(spark, ROWS[::-1]).repartition(7), rules).orderBy("seq", "is_home").collect()
    assert a == b and len(a) == 2 * sum(r[9] != r[10] and r[11] for r in ROWS)
    assert abs(sum(r.change for r in a)) < 1e-9
    assert E.gate(_games(spark, ROWS)).first().first_game_id == 7
    assert E.replay(_games(spark, []), rules).count() == 0


def test_stream_of_days_equals_the_batch_replay(spark, tmp_path):
    from courtfold.streaming.replay import ratings_stream

    rules = X.ruleset("adjusted-v1")
    games = _games(spark, ROWS)
    for k, part in enumerate((games.filter("game_id <= 9"), games.filter("game_id between 10 and 20"), games.filter("game_id > 20"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        q = ratings_stream(spark.readStream.schema(games.schema).parquet(f"{tmp_path}/in/*"), rules).writeStream.format("parquet").option(
            "checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    cols = ["pool", "game_id", "team_id", "pre", "post", "games_before", "rank_after"]
    stream = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*cols).collect()))
    assert stream == sorted(map(tuple, E.replay(games, [rules]).select(*cols).collect()))


@pytest.mark.parametrize(("f", "cases"), [
    (T.full_season, {"2023": "2023-2024", "2023-24": "2023-2024", "1999-00": "1999-2000", " 2020-2021 ": "2020-2021", "cup": "cup"}),
    (T.country_code, {"uk": "GB", " el ": "GR", "FR": "FR", "": None}),
    (T.compact_name, {"K.K. Žalgiris-2": "KKŽALGIRIS2"}),
    (T.without_marks, {"Žalgiris Ülker": "Zalgiris Ulker"}),
    (T.slug, {" Copa del Rey! ": "copa-del-rey"}),
    (T.competition_of, {"ACB Play Off": "ACB", "Turkish  Cup": "Turkish Cup", "NBA": "NBA", "chess": None}),
])
def test_text_functions(spark, f, cases):
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert [r[0] for r in df.select(f(F.col("x"))).collect()] == list(cases.values())


def test_similar_names(spark):
    pairs = [("Real Madrid", "Real Madrid Baloncesto", True), ("ABC", "ABD", False), ("Olympiacos", "Olympiakos", True), ("Partizan", "Zadar", False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert df.filter(T.similar(F.col("a"), F.col("b")) != F.col("same")).count() == 0


def test_merged_rows_that_collide_keep_one(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 3, "b")], "id long, team_id long, name string")
    moves = spark.createDataFrame([(2, 1)], "source_id long, target_id long")
    assert {tuple(r) for r in C.merge_teams(rows, ["team_id"], moves, ["team_id", "name"]).select("id", "team_id").collect()} == {(1, 1), (3, 3)}


def test_dynamic_overwrite_leaves_other_pools(spark, tmp_path):
    base = E.replay(_games(spark, ROWS), [X.ruleset("adjusted-v1")])
    E.write_history(base, f"{tmp_path}/h")
    E.write_history(base.withColumn("pool", F.lit("europe")).limit(4), f"{tmp_path}/h")
    assert {r.pool: r["count"] for r in spark.read.parquet(f"{tmp_path}/h").groupBy("pool").count().collect()} == {"nba": base.count(), "europe": 4}


def test_archives_rounds_and_reports(spark, tmp_path):
    import hashlib

    from courtfold.sources import files as S

    body = "game_id,lg_id,_iscopy,year_id,date_game,fran_id,opp_fran,pts,opp_pts\n1,NBA,0,2000,1/5/2000,A,B,90,80\n2,NBA,1,2000,1/6/2000,B,A,80,90\n2,NBA,0,2000,1/7/2000,B,A,81,90\n"
    path = tmp_path / "a.csv"
    path.write_text(body)
    rows = S.read_archive(spark, str(path), ["game_id", "pts"], hashlib.sha256(body.encode()).hexdigest())
    assert [(r.game_id, r.home_score) for r in S.archive_games(rows).orderBy("game_id").collect()] == [("1", 90), ("2", 81)]
    assert [r.game_id for r in S.repeated_ids(rows, "game_id").collect()] == ["2"]
    for wrong in ({"required": ["game_id"], "sha256": "0" * 64}, {"required": ["missing"]}):
        with pytest.raises(ValueError):
            S.read_archive(spark, str(path), **wrong)
    for n in (4, 5):
        games = S.round_robin(n)
        assert len(games) == n * (n - 1) // 2 == len({frozenset(g[1:]) for g in games})
        for r in {g[0] for g in games}:
            played = [t for g in games if g[0] == r for t in g[1:]]
            assert len(played) == len(set(played))
    S.write_report(rows, str(tmp_path / "csv"))
    S.write_report(rows, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 3
    assert '"1","NBA"' in next((tmp_path / "csv").glob("part-*")).read_text()


def test_a_rebuild_deletes_the_partition_of_a_pool_without_games(spark, tmp_path):
    base = E.replay(_games(spark, ROWS), [X.ruleset("adjusted-v1")])
    E.write_history(base.unionByName(base.withColumn("pool", F.lit("gone"))), f"{tmp_path}/h")
    E.write_history(base, f"{tmp_path}/h", [("nba", "adjusted-v1"), ("gone", "adjusted-v1")])
    assert {r.pool for r in spark.read.parquet(f"{tmp_path}/h").select("pool").distinct().collect()} == {"nba"}


def test_blocked_pools_keep_their_ratings(spark):
    rules = [X.ruleset("adjusted-v1")]
    games = _games(spark, ROWS + [(*ROWS[0][:1], *ROWS[0][1:4], 900, *ROWS[0][5:11], False, "finished")])
    stored = E.replay(_games(spark, ROWS[:3]), rules)
    assert sorted(map(tuple, E.rebuilt(games, stored, rules).collect())) == sorted(map(tuple, stored.collect()))


def test_upsert_with_null_and_repeated_keys(spark):
    old = spark.createDataFrame([(None, "a", 1), (1, "b", 1), (2, "c", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "k int, v string, n int")
    got = C.upsert(old, new, ["k"], order=[F.desc("n")])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, "a", 1), (1, "y", 2), (2, "c", 1), (3, "z", 1)], key=repr)
    both = spark.createDataFrame([(None, "q", 5)], "k int, v string, n int")
    assert (None, "q", 5) in map(tuple, C.upsert(old, both, ["k"]).collect())


def test_results_by_day_count_each_id_once_and_drop_late_ones(spark, tmp_path):
    from datetime import datetime

    from courtfold.streaming.replay import results_by_day

    days = [[("a", 1), ("b", 1), ("a", 1)], [("c", 9)], [("d", 2), ("e", 9)], [("f", 20)]]
    schema = "source_game_id string, ts timestamp"
    (tmp_path / "in").mkdir()
    stream = results_by_day(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    for k, part in enumerate(days):
        spark.createDataFrame([(i, datetime(2024, 1, d, 12)) for i, d in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert {(r.day.day, r.results) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 2), (9, 2)}
