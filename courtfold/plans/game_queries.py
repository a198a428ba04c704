"""Queries over games: browser, review, browsing, dashboards and coverage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import games as G
from ..operators import rankings as R
from ..operators import rating as E
from .adapter import view, with_views
from .rating_queries import history, ranked
from .registry import query

TODAY = date(2001, 8, 2)
DAY = "DATE '2001-08-02'"
SIDES = """SELECT *, home_id AS team_id, true AS is_home FROM games UNION ALL SELECT *, away_id, false FROM games"""


def games(spark, sf_dir):
    return view(spark, sf_dir, "games")


def teams(spark, sf_dir):
    return view(spark, sf_dir, "teams")


BROWSER = """SELECT game_id, game_date, season, home_score, away_score, status FROM games g JOIN teams h ON h.team_id = home_id JOIN teams a ON a.team_id = away_id
WHERE pool = 'europe' AND season IN ('1997-1998', '1997') AND game_date >= DATE '1997-09-01' AND game_date <= DATE '1998-03-31'
  AND (h.team_name ILIKE '%nation_1%' OR a.team_name ILIKE '%nation_1%')"""


@query(with_views(BROWSER))
def games_browser(spark, sf_dir):
    found = G.search(G.filtered(games(spark, sf_dir), pool="europe", status=" "), teams(spark, sf_dir), "nation_1")
    kept = found.filter(G.season_matches(F.col("season"), "1997-1998") & G.between_days(F.col("game_date"), date(1997, 9, 1), date(1998, 3, 31)))
    return kept.select("game_id", "game_date", "season", "home_score", "away_score", "status")


@query(with_views(f"{BROWSER} ORDER BY game_date DESC, game_id LIMIT 10 OFFSET 10"))
def games_browser_page_2(spark, sf_dir):
    rows = games_browser(spark, sf_dir)
    return R.page(rows, [F.desc("game_date"), "game_id"], 2, 10, rows.count())


@query(with_views("""SELECT game_id, game_date FROM games g JOIN teams h ON h.team_id = home_id JOIN teams a ON a.team_id = away_id
WHERE game_date >= DATE '1998-01-01' AND game_date < DATE '1999-01-01' AND (contains(h.team_name, 'NATION_7') OR contains(a.team_name, 'NATION_7'))"""))
def results_of_year(spark, sf_dir):
    return G.search(games(spark, sf_dir), teams(spark, sf_dir), "NATION_7", exact_case=True).filter(G.in_year(F.col("game_date"), 1998)).select("game_id", "game_date")


DONE = "regexp_matches(lower(status), 'finished|after overtime|after over time|final|completed')"
OFF = "regexp_matches(replace(lower(status), ' ', ''), 'cancelled|canceled|postponed|abandoned')"
NO_SCORE = "(home_score IS NULL OR away_score IS NULL)"


@query(with_views(f"""SELECT 'excluded' AS kind, game_id FROM games WHERE NOT eligible UNION ALL SELECT 'missing_score', game_id FROM games WHERE {DONE} AND {NO_SCORE}
UNION ALL SELECT 'stale', game_id FROM games WHERE NOT {DONE} AND NOT {OFF} AND game_date < {DAY} - 2
UNION ALL SELECT 'needs_review', game_id FROM games WHERE NOT {OFF} AND (NOT eligible OR ({DONE} AND {NO_SCORE}) OR (NOT {DONE} AND game_date < {DAY} - 2))"""))
def games_to_review(spark, sf_dir):
    kinds = ("excluded", "missing_score", "stale", "needs_review")
    parts = [G.review(games(spark, sf_dir), k, F.lit(TODAY)).select(F.lit(k).alias("kind"), "game_id") for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(with_views(f"""SELECT game_id, CASE WHEN {OFF} THEN '' ELSE concat_ws(',', CASE WHEN NOT eligible THEN 'excluded' END,
  CASE WHEN status = 'finished' AND {NO_SCORE} THEN 'missing score' END, CASE WHEN status <> 'finished' AND game_date < {DAY} - 2 THEN 'stale' END) END AS reasons FROM games"""))
def review_reasons(spark, sf_dir):
    return G.review_reasons(games(spark, sf_dir), F.lit(TODAY)).select("game_id", F.array_join("reasons", ",").alias("reasons"))


@query(with_views("""SELECT * FROM (SELECT game_id, CASE WHEN status = 'finished' AND (hs IS NULL OR aw IS NULL) THEN 'finished without score' WHEN (hs IS NULL) <> (aw IS NULL) THEN 'one score'
  WHEN hs NOT BETWEEN 0 AND 300 OR aw NOT BETWEEN 0 AND 300 THEN 'out of range' WHEN status = 'finished' AND hs = aw THEN 'level' END AS error FROM (
  SELECT game_id, status, CASE WHEN game_id % 7 = 0 THEN NULL WHEN game_id % 11 = 0 THEN 301 ELSE home_score END AS hs, CASE WHEN game_id % 35 = 0 THEN NULL WHEN game_id % 13 = 0 THEN home_score ELSE away_score END AS aw FROM games))
WHERE error IS NOT NULL"""))
def score_errors(spark, sf_dir):
    """Games whose scores were spoiled by rule, so that every error occurs."""
    g = F.col("game_id")
    spoiled = games(spark, sf_dir).withColumn("home_score_", F.when(g % 7 == 0, None).when(g % 11 == 0, 301).otherwise(F.col("home_score"))).withColumn(
        "away_score", F.when(g % 35 == 0, None).when(g % 13 == 0, F.col("home_score")).otherwise(F.col("away_score"))
    ).withColumn("home_score", F.col("home_score_"))
    return G.write_errors(spoiled).select("game_id", "error")


SUMMARY = """SELECT {keys}, count(*) FILTER (is_home) AS games, count(*) FILTER (is_home AND status = 'finished') AS n_finished, count(DISTINCT team_id) AS teams,
  min(game_date) AS first_date, max(game_date) AS last_date FROM sides{join} GROUP BY {keys}"""


@query(with_views(SUMMARY.format(keys="competition_id", join=""), sides=SIDES))
def browse_competitions(spark, sf_dir):
    return G.summary(games(spark, sf_dir), "competition_id")


@query(with_views(SUMMARY.format(keys="country, tier", join=" JOIN competitions USING (competition_id)"), sides=SIDES))
def browse_countries(spark, sf_dir):
    known = view(spark, sf_dir, "competitions").select("competition_id", "country", "tier")
    return G.summary(games(spark, sf_dir).join(known, "competition_id"), "country", "tier")


@query(with_views("SELECT min(season) AS season, count(*) AS games, max(game_date) AS last_date FROM games GROUP BY lower(season)"))
def browse_seasons(spark, sf_dir):
    return G.season_list(games(spark, sf_dir))


@query(ranked("""SELECT pool, tier, count(*) AS teams, sum(n)::BIGINT AS games, round(avg(elo), 2) AS avg_elo FROM (
  SELECT pool, tier, team_id, count(*) FILTER (is_home) AS n FROM sides JOIN (SELECT competition_id, tier FROM competitions) USING (competition_id) GROUP BY ALL)
LEFT JOIN (SELECT pool, team_id, elo FROM snapshot) USING (pool, team_id) GROUP BY pool, tier""", sides=SIDES))
def browse_tiers(spark, sf_dir):
    return G.tier_summary(E.snapshot(history(spark, sf_dir)), games(spark, sf_dir), view(spark, sf_dir, "competitions"))


@query(ranked("""SELECT competition_id, place, team_id, elo FROM (SELECT competition_id, team_id, elo, row_number() OVER (PARTITION BY competition_id ORDER BY elo DESC, team_id) AS place FROM (
  SELECT DISTINCT competition_id, pool, team_id FROM sides) JOIN (SELECT pool, team_id, elo FROM snapshot) USING (pool, team_id)) WHERE place <= 3""", sides=SIDES))
def browse_top_teams(spark, sf_dir):
    return G.top_teams(E.snapshot(history(spark, sf_dir)), games(spark, sf_dir), 3)


@query(with_views(f"""SELECT count(*) AS games, count(*) FILTER (status = 'finished') AS n_finished, count(*) FILTER (eligible) AS n_eligible, min(game_date) AS first_date, max(game_date) AS last_date,
  count(*) FILTER ({NO_SCORE}) AS n_missing FROM games"""))
def dashboard_totals(spark, sf_dir):
    return G.totals(games(spark, sf_dir))


@query(with_views("""SELECT p.pool, count(game_id) AS games, max(game_date) AS last_date FROM (VALUES ('europe'), ('nba'), ('national'), ('women')) p(pool) LEFT JOIN games g ON g.pool = p.pool GROUP BY p.pool"""))
def pool_catalog(spark, sf_dir):
    return G.pool_catalog(games(spark, sf_dir), ["europe", "nba", "national", "women"])


@query(with_views("""SELECT competition_id, season, count(*) AS total, count(*) FILTER (done) AS completed, count(*) FILTER (done AND NOT rated) AS n_unrated, max(game_date) AS last_date FROM (
  SELECT *, home_score IS NOT NULL AND away_score IS NOT NULL AS done, game_id IN (SELECT game_id FROM rated_games) AS rated FROM games) GROUP BY competition_id, season
ORDER BY n_unrated DESC, total DESC, competition_id, season LIMIT 25"""))
def admin_coverage(spark, sf_dir):
    return G.admin_coverage(games(spark, sf_dir), history(spark, sf_dir))


@query(with_views("""SELECT game_id, pool FROM games WHERE home_score IS NOT NULL AND away_score IS NOT NULL AND game_id NOT IN (SELECT game_id FROM rated_games)"""))
def unrated_games(spark, sf_dir):
    return G.unrated(games(spark, sf_dir), history(spark, sf_dir)).select("game_id", "pool")


@query(with_views(f"""SELECT season, sum(n)::BIGINT AS games, sum(m)::BIGINT AS n_missing, sum(greatest(n - 1, 0))::BIGINT AS n_copies FROM (
  SELECT season, count(*) AS n, count(*) FILTER ({NO_SCORE}) AS m FROM games GROUP BY season, game_date, home_id, away_id) GROUP BY season"""))
def season_audit(spark, sf_dir):
    return G.season_audit(games(spark, sf_dir))


@query(with_views("""SELECT pool, sum(n)::BIGINT AS n, round(sum(margin * n) / sum(n), 6) AS margin FROM (
  SELECT pool, season, count(*) AS n, avg(abs(home_score - away_score)) AS margin FROM rated_games GROUP BY pool, season) GROUP BY pool"""))
def merged_metrics(spark, sf_dir):
    own = E.rated_games(games(spark, sf_dir)).groupBy("pool", "season").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("home_score") - F.col("away_score"))).alias("margin"))
    return G.merged_metrics(own, ["pool"], ["margin"]).withColumn("margin", F.round("margin", 6))


@query(with_views("""SELECT season, coalesce(min(game_date) FILTER (status = 'finished'), min(game_date)) AS opener FROM games GROUP BY season"""))
def season_openers(spark, sf_dir):
    return G.first_scored(games(spark, sf_dir))


@query(with_views("""SELECT 'season' AS kind, season AS value FROM games UNION SELECT 'source', source FROM games UNION SELECT 'year', year(game_date)::VARCHAR FROM games
UNION SELECT 'round', round_name FROM games UNION SELECT 'status', status FROM games"""))
def browser_options(spark, sf_dir):
    return G.options(games(spark, sf_dir))


@query(with_views("SELECT season, source, count(*) AS games FROM games GROUP BY season, source"))
def games_by_source(spark, sf_dir):
    return games(spark, sf_dir).groupBy("season", "source").agg(F.count("*").alias("games"))


CATALOG = """SELECT competition_id, CASE competition_id % 3 WHEN 0 THEN 'league' WHEN 1 THEN 'cup' ELSE 'super' END AS kind, unnest(range(1994, 2003)) AS y FROM competitions"""
JOBS = """SELECT event_id AS job_id, user_id % 5 AS competition_id, concat(1994 + event_id % 9, '-', 1995 + event_id % 9) AS season, event_type AS status FROM events"""
COVERAGE = """
SELECT competition_id, kind, c.season, coalesce(n, 0) AS n, coalesce(n_done, 0) AS n_done, job_status, median, CASE WHEN coalesce(median, 0) <= 0 THEN false WHEN kind = 'super' THEN coalesce(n, 0) = 0
  WHEN kind = 'cup' AND coalesce(n, 0) >= 4 AND median <= 20 THEN false WHEN kind = 'cup' THEN coalesce(n, 0) < greatest(4, median * 0.35) ELSE coalesce(n, 0) < median * 0.65 END AS low
FROM (SELECT competition_id, kind, concat(y, '-', y + 1) AS season FROM catalog) c LEFT JOIN counted USING (competition_id, season)
LEFT JOIN (SELECT competition_id, season, arg_max(status, job_id) AS job_status FROM jobs GROUP BY ALL) USING (competition_id, season)
LEFT JOIN (SELECT competition_id, median(n) AS median FROM counted WHERE season BETWEEN '1994-1995' AND '2002-2003' GROUP BY competition_id) USING (competition_id)"""
COVERAGE_VIEWS = {"catalog": CATALOG, "jobs": JOBS, "counted": "SELECT competition_id, season, count(*) AS n, count(home_score) AS n_done FROM games GROUP BY ALL", "covered": COVERAGE}


def _covered(spark, sf_dir):
    own = view(spark, sf_dir, "competitions")
    kind = F.when(own.competition_id % 3 == 0, "league").when(own.competition_id % 3 == 1, "cup").otherwise("super")
    y = F.lit(1994) + F.col("event_id") % 9
    jobs = view(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), (F.col("user_id") % 5).alias("competition_id"), F.concat_ws("-", y, y + 1).alias("season"), F.col("event_type").alias("status")
    )
    catalog = own.select("competition_id", kind.alias("kind"), F.lit(1994).alias("first"), F.lit(2002).alias("last"))
    return G.coverage(catalog, games(spark, sf_dir), jobs)


@query(with_views("SELECT * FROM covered", **COVERAGE_VIEWS))
def coverage(spark, sf_dir):
    return _covered(spark, sf_dir)


@query(with_views("""SELECT competition_id, count(*) AS n_seasons, count(*) FILTER (n > 0) AS n_with_games, bool_or(coalesce(low, false)) AS any_low, min(season) AS first_season,
  arg_min(season, (-n, season)) AS fullest, arg_min(season, (n, season)) AS emptiest FROM covered GROUP BY competition_id""", **COVERAGE_VIEWS))
def league_cards(spark, sf_dir):
    return G.league_cards(_covered(spark, sf_dir))
