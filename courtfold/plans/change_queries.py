"""Queries over changes: upserts, replacements, merges, decisions, as the tables they leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import games as G
from .adapter import view, with_views
from .identity_queries import FINDINGS, findings
from .registry import query

#: A later delivery of every third game: some scheduled again, some with other scores, and some new.
DELIVERY = """SELECT game_id + CASE WHEN game_id % 9 = 0 THEN 1000000000 ELSE 0 END AS game_id, season, home_id, away_id, home_score + 1 AS home_score, away_score,
  CASE WHEN game_id % 6 = 0 THEN 'scheduled' ELSE status END AS status, round_name FROM games WHERE game_id % 3 = 0"""
STORED = "SELECT game_id, season, home_id, away_id, home_score, away_score, status, round_name FROM games"
COLUMNS = ["game_id", "season", "home_id", "away_id", "home_score", "away_score", "status", "round_name"]
VIEWS = {"stored": STORED, "delivery": DELIVERY}


def stored(spark, sf_dir):
    return view(spark, sf_dir, "games").select(*COLUMNS)


def delivery(spark, sf_dir):
    g = F.col("game_id")
    return stored(spark, sf_dir).filter(g % 3 == 0).withColumns({
        "status": F.when(g % 6 == 0, "scheduled").otherwise(F.col("status")), "home_score": F.col("home_score") + 1,
        "game_id": g + F.when(g % 9 == 0, F.lit(1000000000)).otherwise(0),
    })


@query(with_views("""SELECT s.* FROM stored s LEFT JOIN delivery d USING (game_id) WHERE d.game_id IS NULL OR (s.status = 'finished' AND d.status = 'scheduled')
UNION ALL SELECT d.* FROM delivery d LEFT JOIN stored s USING (game_id) WHERE s.game_id IS NULL OR NOT (s.status = 'finished' AND d.status = 'scheduled')""", **VIEWS))
def upserted_games(spark, sf_dir):
    """Scheduled games never overwrite finished ones."""
    keep = (F.col("o.status") == "finished") & (F.col("n.status") == "scheduled")
    return C.upsert(stored(spark, sf_dir), delivery(spark, sf_dir), ["game_id"], keep)


@query(with_views("""SELECT s.* FROM stored s WHERE s.season <> '1997-1998' UNION ALL SELECT d.* FROM delivery d WHERE d.season = '1997-1998'""", **VIEWS))
def replaced_season(spark, sf_dir):
    return C.replace_season(stored(spark, sf_dir), delivery(spark, sf_dir).filter("season = '1997-1998'"), ["season"], ["game_id"])


@query(with_views("SELECT * FROM stored UNION ALL SELECT * FROM delivery WHERE game_id >= 1000000000", **VIEWS))
def added_games(spark, sf_dir):
    return C.add_missing(stored(spark, sf_dir), delivery(spark, sf_dir), ["game_id"])


@query(with_views("""SELECT feed_id, CASE WHEN home_id = away_id THEN 'same team' WHEN home_score = away_score THEN 'level' WHEN raw_status = 'error' THEN 'status' END AS reason FROM feed"""))
def accepted_feed(spark, sf_dir):
    feed = view(spark, sf_dir, "feed")
    reasons = [(F.col("home_id") == F.col("away_id"), "same team"), (F.col("home_score") == F.col("away_score"), "level"), (F.col("raw_status") == "error", "status")]
    good, held = C.accept(feed, reasons)
    return good.select("feed_id", F.lit(None).cast("string").alias("reason")).unionByName(held.select("feed_id", "reason"))


MOVES = "SELECT CAST(n_nationkey AS BIGINT) AS source_id, CAST(n_nationkey - 1 AS BIGINT) AS target_id FROM nation WHERE n_nationkey % 5 = 4"


def moves(spark, sf_dir):
    key = F.col("n_nationkey").cast("long")
    return view(spark, sf_dir, "nation").filter("n_nationkey % 5 = 4").select(key.alias("source_id"), (key - 1).alias("target_id"))


@query(with_views("""SELECT source_id, target_id FROM moves WHERE EXISTS (SELECT 1 FROM games WHERE least(home_id, away_id) = least(source_id, target_id) AND greatest(home_id, away_id) = greatest(source_id, target_id))""", moves=MOVES))
def merge_blockers(spark, sf_dir):
    return C.merge_blockers(view(spark, sf_dir, "games"), moves(spark, sf_dir))


@query(with_views("""SELECT game_id, coalesce(h.target_id, home_id) AS home_id, coalesce(a.target_id, away_id) AS away_id FROM games LEFT JOIN moves h ON h.source_id = home_id LEFT JOIN moves a ON a.source_id = away_id""", moves=MOVES))
def merged_teams(spark, sf_dir):
    return C.merge_teams(view(spark, sf_dir, "games").select("game_id", "home_id", "away_id"), ["home_id", "away_id"], moves(spark, sf_dir))


@query(with_views("""SELECT min(alias_id) AS alias_id, coalesce(target_id, team_id) AS team_id, source, source_team_id FROM aliases LEFT JOIN moves ON source_id = team_id
GROUP BY coalesce(target_id, team_id), source, source_team_id""", moves=MOVES))
def merged_aliases(spark, sf_dir):
    own = view(spark, sf_dir, "aliases").select("alias_id", "team_id", "source", "source_team_id")
    return C.merge_teams(own, ["team_id"], moves(spark, sf_dir), ["team_id", "source", "source_team_id"])


@query(with_views("SELECT finding_id, status FROM findings WHERE finding_id NOT IN (SELECT finding_id FROM findings WHERE status = 'completed' AND severity = 'warning')", findings=FINDINGS))
def open_findings(spark, sf_dir):
    rows = findings(spark, sf_dir)
    return C.suppress(rows, rows.filter("status = 'completed' and severity = 'warning'").select("finding_id"), "finding_id").select("finding_id", "status")


RUNS = """SELECT p_partkey AS run_id, CASE WHEN p_partkey % 4 <> 0 THEN concat('c', p_partkey % 5) END AS competition, CASE WHEN p_partkey % 3 <> 0 THEN concat('s', p_partkey % 7) END AS season FROM part"""


@query(with_views("SELECT run_id FROM runs WHERE (competition IS NULL OR competition = 'c2') OR ((competition IS NULL OR competition = 'c3') AND (season IS NULL OR season = 's4'))", runs=RUNS))
def invalidated_runs(spark, sf_dir):
    key = F.col("p_partkey")
    runs = view(spark, sf_dir, "part").select(
        key.alias("run_id"), F.when(key % 4 != 0, F.concat(F.lit("c"), key % 5)).alias("competition"), F.when(key % 3 != 0, F.concat(F.lit("s"), key % 7)).alias("season")
    )
    scopes = spark.createDataFrame([("c2", None), ("c3", "s4")], "competition string, season string")
    return C.invalidated(runs, scopes, ["competition", "season"]).select("run_id")


@query(with_views("""SELECT competition_id, season, n < 30 AND NOT decided AS needs_inspection, CASE WHEN decided THEN 'reviewed' WHEN n < 30 THEN 'warning' ELSE 'ok' END AS severity, CASE WHEN decided THEN 'short season' END AS note
FROM (SELECT competition_id, season, count(*) AS n, competition_id % 2 = 0 AND season IN ('1994-1995', '2001-2002') AS decided FROM games GROUP BY ALL)"""))
def inspected_coverage(spark, sf_dir):
    rows = view(spark, sf_dir, "games").groupBy("competition_id", "season").agg(F.count("*").alias("n"))
    rows = rows.select("competition_id", "season", (F.col("n") < 30).alias("needs_inspection"), F.when(F.col("n") < 30, "warning").otherwise("ok").alias("severity"))
    decisions = spark.createDataFrame([(c, s, "short season") for c in (0, 2, 4) for s in ("1994-1995", "2001-2002")], "competition_id long, season string, note string")
    return C.overlay(rows, decisions, ["competition_id", "season"])


@query("""SELECT p_partkey % 50 AS model, max(version) + 1 AS version, arg_max_null(k, version) + 1 AS k, arg_max_null(note, version) AS note FROM (
  SELECT p_partkey, p_partkey // 50 + 1 AS version, CASE WHEN p_size % 5 <> 0 THEN p_size END AS k, CASE WHEN p_size % 2 = 0 THEN p_type END AS note FROM part) GROUP BY p_partkey % 50 HAVING arg_max_null(k, version) IS NOT NULL""")
def next_versions(spark, sf_dir):
    """Every model is proposed again with k one higher; where k is null nothing changes."""
    key, size = F.col("p_partkey"), F.col("p_size")
    versions = view(spark, sf_dir, "part").select(
        (key % 50).alias("model"), (F.floor(key / 50) + 1).alias("version"), F.when(size % 5 != 0, size).alias("k"), F.when(size % 2 == 0, F.col("p_type")).alias("note")
    )
    last = versions.groupBy("model").agg(F.max_by(F.struct("k", "note"), "version").alias("l"))
    return C.next_version(versions, last.select("model", (F.col("l.k") + 1).alias("k"), F.col("l.note").alias("note")), "model", ["k", "note"])


@query(with_views("SELECT game_id, CASE WHEN lower(coalesce(round_name, '')) IN ('final', 'round 3') THEN competition_id + 100 ELSE competition_id END AS competition_id FROM games"))
def split_stages(spark, sf_dir):
    return C.split_stage(view(spark, sf_dir, "games"), ["FINAL", "Round 3"], F.col("competition_id") + 100).select("game_id", "competition_id")


@query(with_views("""SELECT game_date, home_id, away_id, game_id, source FROM (SELECT *, row_number() OVER (PARTITION BY game_date, home_id, away_id
  ORDER BY CASE source WHEN 'src2' THEN 0 WHEN 'src0' THEN 1 ELSE 2 END, game_id) AS rn FROM games) WHERE rn = 1"""))
def games_by_priority(spark, sf_dir):
    rank = F.when(F.col("source") == "src2", 0).when(F.col("source") == "src0", 1).otherwise(2)
    return C.first_wins(view(spark, sf_dir, "games").select("game_date", "home_id", "away_id", "game_id", "source"), ["game_date", "home_id", "away_id"], [rank, "game_id"])


POINTS = "SELECT competition_id, game_date, count(*) AS n FROM games GROUP BY ALL"


@query(with_views("""SELECT competition_id, game_date, CASE WHEN month(game_date) = 3 THEN -n ELSE n END AS n FROM points""", points=POINTS))
def refined_points(spark, sf_dir):
    """A series of which the points of one month are replaced by refined ones."""
    points = view(spark, sf_dir, "games").groupBy("competition_id", "game_date").agg(F.count("*").alias("n"))
    refined = points.filter(F.month("game_date") == 3).withColumn("n", -F.col("n"))
    return C.replace_points(points, refined, ["competition_id", "game_date"])


@query(with_views("SELECT pool, team_id FROM (SELECT pool, home_id AS team_id FROM games INTERSECT SELECT pool, away_id FROM games) EXCEPT SELECT pool, home_id FROM games WHERE round_name = 'Final' AND home_id % 3 > 0"))
def unfinished_business(spark, sf_dir):
    """Teams that play at home and away but never had a final at home, where every third team's finals count for nothing."""
    sides = G.appearances(view(spark, sf_dir, "games"))
    home, away = (sides.filter(c).select("pool", "team_id") for c in ("is_home", "not is_home"))
    return home.intersect(away).exceptAll(sides.filter("is_home and round_name = 'Final' and team_id % 3 > 0").select("pool", "team_id").distinct())
