"""Queries over identities: aliases, similar teams, matches across sources, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity as I
from .adapter import view, with_views
from .registry import query

COMPACT = "upper(regexp_replace({0}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"
#: Findings by rule: pairs of teams with types, states and evidence from the part table.
FINDINGS = """SELECT p_partkey AS finding_id, p_partkey % 25 AS left_id, (p_partkey * 7 + 3) % 25 AS right_id, p_brand AS finding_type,
  CASE p_size % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'deferred' ELSE 'completed' END AS status, CASE p_size % 4 WHEN 0 THEN 'blocker' ELSE 'warning' END AS severity, p_name AS evidence FROM part"""


def findings(spark, sf_dir):
    size = F.col("p_size")
    return view(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("finding_id"), (F.col("p_partkey") % 25).alias("left_id"), ((F.col("p_partkey") * 7 + 3) % 25).alias("right_id"), F.col("p_brand").alias("finding_type"),
        F.when(size % 3 == 0, "open").when(size % 3 == 1, "deferred").otherwise("completed").alias("status"), F.when(size % 4 == 0, "blocker").otherwise("warning").alias("severity"),
        F.col("p_name").alias("evidence"),
    )


#: Aliases whose source ids stand for ten parts in a row; in some of these one part belongs to another team.
GROUPED = "SELECT source, concat('u', alias_id // 10) AS source_team_id, (alias_id // 10 + CASE WHEN alias_id % 70 = 3 THEN 1 ELSE 0 END) % 25 AS team_id FROM aliases"


@query(with_views("SELECT source, source_team_id, min(team_id) AS team_id FROM grouped GROUP BY ALL HAVING count(DISTINCT team_id) = 1", grouped=GROUPED))
def unique_aliases(spark, sf_dir):
    i = F.col("alias_id")
    tens = F.floor(i / 10)
    return I.unique_aliases(view(spark, sf_dir, "aliases").select("source", F.concat(F.lit("u"), tens).alias("source_team_id"), ((tens + F.when(i % 70 == 3, 1).otherwise(0)) % 25).alias("team_id")))


@query(with_views("SELECT source, source_team_id, count(DISTINCT team_id) AS n_teams FROM aliases GROUP BY ALL HAVING count(DISTINCT team_id) > 1"))
def split_sources(spark, sf_dir):
    return I.split_sources(view(spark, sf_dir, "aliases"))


@query(with_views(f"""SELECT source, source_team_id, string_agg(DISTINCT name, '|' ORDER BY name) AS names, count(DISTINCT name) AS n_names FROM (
  SELECT source, source_team_id, {COMPACT.format("alias_name")} AS name FROM aliases) GROUP BY ALL HAVING count(DISTINCT name) > 1"""))
def split_names(spark, sf_dir):
    return I.split_names(view(spark, sf_dir, "aliases"))


@query(with_views("""SELECT team_id, min(country) AS country FROM (SELECT home_id AS team_id, CASE WHEN home_id % 4 = 1 THEN game_id % 5 ELSE competition_id END AS competition_id FROM games) JOIN competitions USING (competition_id)
GROUP BY team_id HAVING count(DISTINCT country) = 1"""))
def unanimous_countries(spark, sf_dir):
    """Of games at home, where a quarter of the teams play in every competition."""
    at_home = view(spark, sf_dir, "games").withColumns({"away_id": F.col("home_id"), "competition_id": F.when(F.col("home_id") % 4 == 1, F.col("game_id") % 5).otherwise(F.col("competition_id"))})
    return I.unanimous(at_home, view(spark, sf_dir, "competitions"))


@query(with_views("""SELECT alias_id, coalesce(sum(n), 0)::BIGINT AS n_games FROM aliases a LEFT JOIN (
  SELECT team_id, year(game_date) AS y, count(*) AS n FROM (SELECT home_id AS team_id, game_date FROM games UNION ALL SELECT away_id, game_date FROM games) GROUP BY ALL) g
ON g.team_id = a.team_id AND (valid_from IS NULL OR y >= valid_from) AND (valid_to IS NULL OR y <= valid_to) GROUP BY alias_id"""))
def alias_usage(spark, sf_dir):
    return I.alias_usage(view(spark, sf_dir, "aliases"), view(spark, sf_dir, "games"))


NAMED = f"""SELECT DISTINCT team_id, {COMPACT.format("alias_name")} AS name FROM aliases"""
SEEN = "SELECT DISTINCT team_id, competition_id FROM (SELECT home_id AS team_id, competition_id FROM games UNION ALL SELECT away_id, competition_id FROM games)"


@query(with_views("""SELECT left_id, right_id, count(*) AS n_names FROM (
  SELECT DISTINCT l.team_id AS left_id, r.team_id AS right_id FROM (SELECT DISTINCT team_id FROM named) l JOIN (SELECT DISTINCT team_id FROM named) r ON l.team_id < r.team_id
  WHERE l.team_id NOT IN (SELECT team_id FROM seen) OR r.team_id NOT IN (SELECT team_id FROM seen) OR EXISTS (SELECT 1 FROM seen a JOIN seen b USING (competition_id) WHERE a.team_id = l.team_id AND b.team_id = r.team_id)) p
JOIN named l ON l.team_id = left_id JOIN named r ON r.team_id = right_id
WHERE CASE WHEN least(length(l.name), length(r.name)) < 4 THEN l.name = r.name
  ELSE contains(l.name, r.name) OR contains(r.name, l.name) OR 1 - levenshtein(l.name, r.name)::DOUBLE / greatest(length(l.name), length(r.name)) >= 0.86 END
GROUP BY left_id, right_id""", named=NAMED, seen=SEEN))
def similar_teams(spark, sf_dir):
    from ..operators.games import appearances

    return I.similar_teams(view(spark, sf_dir, "aliases"), appearances(view(spark, sf_dir, "games")))


#: The feed of another source, moved to the days of the games so that fixtures are near.
#: Each game as a daily feed has it: up to 60 hours later or 20 earlier, some in another competition, some from the game's own source.
NEWS = {
    "timed": "SELECT *, CAST(game_date AS TIMESTAMP) + CAST(game_id % 24 AS INT) * INTERVAL '1' HOUR AS game_ts FROM games",
    "news": """SELECT game_id AS feed_id, game_ts + CAST(game_id % 80 - 20 AS INT) * INTERVAL '1' HOUR AS feed_ts, CASE WHEN game_id % 7 = 0 THEN (competition_id + 1) % 5 ELSE competition_id END AS competition_id,
  CASE WHEN game_id % 6 = 0 THEN source ELSE 'feed' END AS source, home_id, away_id FROM timed""",
    "fixtures": """SELECT game_id, source, competition_id, home_id, away_id, status, game_ts FROM timed
UNION ALL SELECT game_id + 1000000000, source, competition_id, home_id, away_id, status, game_ts + CAST(2 * (game_id % 80 - 20) AS INT) * INTERVAL '1' HOUR FROM timed WHERE game_id % 9 = 0""",
}


@query(with_views("""SELECT feed_id, CASE WHEN count(*) = 1 THEN min(game_id) END AS game_id, min(distance) AS distance, count(*) > 1 AS ambiguous FROM (
  SELECT *, min(distance) OVER (PARTITION BY feed_id) AS best FROM (
    SELECT feed_id, game_id, abs(epoch(feed_ts) - epoch(game_ts))::BIGINT AS distance FROM news n JOIN fixtures g ON g.competition_id = n.competition_id AND g.home_id = n.home_id AND g.away_id = n.away_id
      AND g.source <> n.source AND g.status = 'scheduled' AND abs(epoch(feed_ts) - epoch(game_ts)) <= 36 * 3600)) WHERE distance = best GROUP BY feed_id""", **NEWS))
def nearest_fixtures(spark, sf_dir):
    """Some games are planned twice, equally far from the news."""
    return I.nearest_fixture(view(spark, sf_dir, "news", NEWS), view(spark, sf_dir, "fixtures", NEWS))


SCORED = "SELECT * FROM games WHERE home_score IS NOT NULL AND away_score IS NOT NULL"
#: Games, and a third of them once more from another source; of these some have another away team, of the same country or not.
TWICE = """SELECT game_id, source, game_date, season, home_id, away_id, home_score, away_score FROM games WHERE home_score IS NOT NULL AND away_score IS NOT NULL
UNION ALL SELECT game_id + 1000000000, 'copy', game_date, season, home_id, CASE WHEN game_id % 2 = 0 THEN (away_id + 5) % 30 ELSE away_id END, home_score, away_score FROM games WHERE game_id % 3 = 0 AND home_score IS NOT NULL AND away_score IS NOT NULL"""


def twice(spark, sf_dir):
    g = view(spark, sf_dir, "games").filter("home_score is not null and away_score is not null").select("game_id", "source", "game_date", "season", "home_id", "away_id", "home_score", "away_score")
    i = F.col("game_id")
    return g.unionByName(g.filter(i % 3 == 0).withColumns({"game_id": i + 1000000000, "source": F.lit("copy"), "away_id": F.when(i % 2 == 0, (F.col("away_id") + 5) % 30).otherwise(F.col("away_id"))}))


@query(with_views("""SELECT a.game_id, b.game_id AS other_id, a.game_date FROM placed a JOIN placed b USING (season, game_date, home_score, away_score)
WHERE a.game_id < b.game_id AND a.source <> b.source AND (a.home_id = b.home_id OR a.hc = b.hc) AND (a.away_id = b.away_id OR a.ac = b.ac)""",
                  twice=TWICE, placed="SELECT w.*, h.country AS hc, a.country AS ac FROM twice w LEFT JOIN teams h ON h.team_id = home_id LEFT JOIN teams a ON a.team_id = away_id"))
def same_day_duplicates(spark, sf_dir):
    return I.same_day_duplicates(twice(spark, sf_dir), view(spark, sf_dir, "teams"))


@query(with_views("""SELECT game_id, other_id, distance, score_match FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY distance, score_match DESC, other_id) AS r1, row_number() OVER (PARTITION BY other_id ORDER BY distance, score_match DESC, game_id) AS r2 FROM (
    SELECT a.game_id, b.game_id AS other_id, abs(a.game_date - b.game_date) AS distance,
      CASE WHEN a.home_id = b.home_id THEN a.home_score = b.home_score AND a.away_score = b.away_score ELSE a.home_score = b.away_score AND a.away_score = b.home_score END::INT AS score_match
    FROM scored a JOIN scored b ON a.competition_id = b.competition_id AND least(a.home_id, a.away_id) = least(b.home_id, b.away_id) AND greatest(a.home_id, a.away_id) = greatest(b.home_id, b.away_id)
    WHERE a.source <> b.source AND abs(a.game_date - b.game_date) <= 31)) WHERE r1 = 1 AND r2 = 1 AND game_id < other_id""", scored=SCORED))
def near_duplicate_games(spark, sf_dir):
    return I.near_duplicates(view(spark, sf_dir, "games"), 31)


@query(with_views("""SELECT a.game_id, b.game_id AS other_id FROM (SELECT *, count(*) OVER (PARTITION BY home_id, away_id, home_score, away_score, season) AS n FROM twice) a
JOIN (SELECT *, count(*) OVER (PARTITION BY home_id, away_id, home_score, away_score, season) AS n FROM twice) b USING (home_id, away_id, home_score, away_score, season)
WHERE a.n = 2 AND b.n = 2 AND a.game_id < b.game_id AND a.source <> b.source""", twice=TWICE))
def one_to_one_duplicates(spark, sf_dir):
    return I.one_to_one(twice(spark, sf_dir), ["home_id", "away_id", "home_score", "away_score", "season"])


@query(with_views("""SELECT least(left_id, right_id) AS left_id, greatest(left_id, right_id) AS right_id,
  CASE WHEN bool_or(status = 'open') THEN 'open' WHEN bool_or(status = 'deferred') THEN 'deferred' ELSE 'completed' END AS status,
  CASE WHEN bool_or(severity = 'blocker') THEN 'blocker' ELSE 'warning' END AS severity, array_to_string(list_sort(list(DISTINCT finding_type)), ',') AS types, count(*) AS n,
  array_to_string(list_sort(list(DISTINCT evidence))[1:5], ',') AS evidence FROM findings GROUP BY 1, 2""".replace("GROUP BY 1, 2", "GROUP BY least(left_id, right_id), greatest(left_id, right_id)"), findings=FINDINGS))
def finding_pairs(spark, sf_dir):
    return I.pair_rollup(findings(spark, sf_dir))


@query(with_views("SELECT finding_type, status, severity, count(*) AS n FROM findings GROUP BY ALL", findings=FINDINGS))
def finding_counts(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("finding_type", "status", "severity").agg(F.count("*").alias("n"))


@query(with_views("""SELECT team_id, sum(n)::BIGINT AS games, max(last_date) AS last_date FROM (SELECT home_id AS team_id, count(*) AS n, max(game_date) AS last_date FROM games GROUP BY home_id
UNION ALL SELECT away_id, count(*), max(game_date) FROM games GROUP BY away_id) GROUP BY team_id"""))
def team_stats(spark, sf_dir):
    return I.team_stats(view(spark, sf_dir, "games"))


@query(with_views("""SELECT t.team_id, coalesce(a.n, 0) AS n_aliases, coalesce(g.n, 0) AS n_games, a.top_source FROM teams t
LEFT JOIN (SELECT team_id, sum(n)::BIGINT AS n, arg_min(source, (-n, source)) AS top_source FROM (SELECT team_id, source, count(*) AS n FROM aliases GROUP BY ALL) GROUP BY team_id) a USING (team_id)
LEFT JOIN (SELECT team_id, count(*) AS n FROM (SELECT home_id AS team_id FROM games UNION ALL SELECT away_id FROM games) GROUP BY team_id) g USING (team_id)"""))
def admin_teams(spark, sf_dir):
    return I.admin_teams(view(spark, sf_dir, "teams"), view(spark, sf_dir, "aliases"), view(spark, sf_dir, "games"))
