"""Queries over merged teams, a table each, and over partitions that are replaced by a manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import merges as M
from ..operators import store as S
from .adapter import view, with_views
from .registry import query

#: Clubs are customers. Every tenth of moves: a chain over three clubs, a cycle of two, a target that isn't there, and clubs that never met.
CLUBS = {
    "clubs": """SELECT c_custkey AS team_id, c_name AS team_name, CASE WHEN c_custkey % 10 IN (1, 4) THEN c_custkey + 1 END AS predecessor_id, CASE WHEN c_custkey % 10 IN (2, 6) THEN c_custkey + 1 END AS successor_id FROM customer""",
    "club_games": """SELECT o_orderkey AS game_id, o_custkey AS home_id, (o_custkey + o_orderkey) % 97 + 1 AS away_id FROM orders WHERE o_custkey <> (o_custkey + o_orderkey) % 97 + 1""",
    "club_aliases": """SELECT p_partkey AS alias_id, p_partkey % 150 + 1 AS team_id, concat('src', p_partkey % 2) AS source, 'x' AS source_team_id, concat('n', p_partkey % 3) AS alias_name FROM part WHERE p_partkey % 150 + 1 < 140""",
    "club_history": """SELECT 'europe' AS pool, 'basic' AS ruleset, game_id - game_id % 8 AS game_id, home_id AS team_id, away_id AS opponent_id, game_id AS row_no FROM club_games""",
    "club_ratings": """SELECT 'europe' AS pool, 'basic' AS ruleset, home_id AS team_id, count(*) AS games, max(game_id) AS last_game_id FROM club_games GROUP BY home_id""",
    "club_findings": """SELECT game_id AS finding_id, home_id AS left_id, away_id AS right_id, CASE WHEN game_id % 2 = 0 THEN 'names' ELSE 'sources' END AS finding_type, 'open' AS status FROM club_games""",
    "club_moves": """SELECT team_id AS source_id, CASE team_id % 10 WHEN 2 THEN team_id - 1 WHEN 3 THEN team_id - 1 WHEN 7 THEN team_id + 1 WHEN 8 THEN team_id - 1 WHEN 5 THEN team_id + 1000000000 ELSE team_id - 3 END AS target_id
FROM clubs WHERE team_id % 10 IN (2, 3, 5, 7, 8, 9)""",
}
_CLOSED = """SELECT source_id, CASE source_id % 10 WHEN 3 THEN source_id - 2 ELSE target_id END AS target_id FROM club_moves WHERE source_id % 10 NOT IN (7, 8)"""
REFUSED = {
    "closed": _CLOSED,
    "rows_of": "SELECT team_id FROM club_aliases UNION SELECT home_id FROM club_games UNION SELECT away_id FROM club_games",
    "busy": "SELECT * FROM closed WHERE source_id IN (SELECT team_id FROM rows_of)",
    "end_of": "SELECT source_id, target_id FROM busy UNION SELECT target_id, target_id FROM busy",
    "met": "SELECT DISTINCT h.target_id FROM club_games JOIN end_of h ON h.source_id = home_id JOIN end_of a ON a.source_id = away_id WHERE h.target_id = a.target_id",
    "refused": """SELECT source_id, CASE WHEN source_id % 10 IN (7, 8) THEN 'cycle' WHEN source_id NOT IN (SELECT source_id FROM busy) THEN 'nothing to move' WHEN target_id NOT IN (SELECT team_id FROM clubs) THEN 'missing target' ELSE 'met' END AS reason
FROM (SELECT m.source_id, c.target_id FROM club_moves m LEFT JOIN closed c ON c.source_id = m.source_id) WHERE source_id % 10 IN (7, 8) OR source_id NOT IN (SELECT source_id FROM busy)
  OR target_id NOT IN (SELECT team_id FROM clubs) OR target_id IN (SELECT target_id FROM met)""",
    "done": "SELECT * FROM busy WHERE source_id NOT IN (SELECT source_id FROM refused)",
}
ALL = CLUBS | REFUSED


def _moves(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n, CLUBS)
    return M.guarded_moves(v("club_moves"), v("clubs"), v("club_games"), [v("club_aliases")])


def _merged(spark, sf_dir, name):
    names = {n: view(spark, sf_dir, f"club_{n}" if n != "teams" else "clubs", CLUBS) for n in ("teams", "aliases", "games", "history", "ratings", "findings")}
    return M.merge_all(names, S.kept(_moves(spark, sf_dir)[0]))[name]


@query(with_views("SELECT source_id, target_id FROM done", **ALL))
def club_moves(spark, sf_dir):
    """Moves to the end of their chains that nothing stands against."""
    return _moves(spark, sf_dir)[0]


@query(with_views("SELECT source_id, reason FROM refused", **ALL))
def refused_moves(spark, sf_dir):
    return _moves(spark, sf_dir)[1]


_TO = "coalesce((SELECT target_id FROM done WHERE source_id = {0}), {0})"


@query(with_views(f"""SELECT team_id, team_name, nullif({_TO.format("predecessor_id")}, team_id) AS predecessor_id, nullif({_TO.format("successor_id")}, team_id) AS successor_id FROM clubs
WHERE team_id NOT IN (SELECT source_id FROM done)""", **ALL))
def merged_club_teams(spark, sf_dir):
    return _merged(spark, sf_dir, "teams")


@query(with_views(f"""SELECT alias_id, team_id, source, source_team_id, alias_name FROM (SELECT alias_id, source, source_team_id, alias_name, {_TO.format("c.team_id")} AS team_id,
  row_number() OVER (PARTITION BY {_TO.format("c.team_id")}, source, source_team_id, alias_name ORDER BY c.team_id IN (SELECT source_id FROM done), alias_id) AS rn FROM club_aliases c) WHERE rn = 1""", **ALL))
def merged_club_aliases(spark, sf_dir):
    return _merged(spark, sf_dir, "aliases")


@query(with_views(f"""SELECT game_id, {_TO.format("home_id")} AS home_id, {_TO.format("away_id")} AS away_id FROM club_games""", **ALL))
def merged_club_games(spark, sf_dir):
    return _merged(spark, sf_dir, "games")


@query(with_views(f"""SELECT pool, ruleset, game_id, team_id, opponent_id, row_no FROM (SELECT pool, ruleset, game_id, {_TO.format("c.team_id")} AS team_id, {_TO.format("opponent_id")} AS opponent_id, row_no,
  row_number() OVER (PARTITION BY game_id, {_TO.format("c.team_id")} ORDER BY c.team_id IN (SELECT source_id FROM done), c.team_id) AS rn FROM (
    SELECT DISTINCT ON (pool, ruleset, game_id, team_id) * FROM club_history ORDER BY pool, ruleset, game_id, team_id, row_no) c) WHERE rn = 1""", **ALL))
def merged_club_history(spark, sf_dir):
    """Histories of which eight games are one, so that clubs that become one have played the same."""
    own = view(spark, sf_dir, "club_history", CLUBS)
    one = own.groupBy("pool", "ruleset", "game_id", "team_id").agg(F.min("row_no").alias("row_no"), F.min_by("opponent_id", "row_no").alias("opponent_id"))
    tables = {n: view(spark, sf_dir, f"club_{n}" if n != "teams" else "clubs", CLUBS) for n in ("teams", "aliases", "games", "ratings", "findings")}
    return M.merge_all(tables | {"history": one}, S.kept(_moves(spark, sf_dir)[0]))["history"]


@query(with_views(f"""SELECT pool, ruleset, team_id, games, last_game_id FROM (SELECT pool, ruleset, {_TO.format("c.team_id")} AS team_id, games, last_game_id,
  row_number() OVER (PARTITION BY {_TO.format("c.team_id")} ORDER BY c.team_id IN (SELECT source_id FROM done), games DESC, c.team_id) AS rn FROM club_ratings c) WHERE rn = 1""", **ALL))
def merged_club_ratings(spark, sf_dir):
    return _merged(spark, sf_dir, "ratings")


@query(with_views(f"""SELECT min(finding_id) AS finding_id, least(l, r) AS left_id, greatest(l, r) AS right_id, finding_type, 'open' AS status FROM (
  SELECT finding_id, finding_type, {_TO.format("left_id")} AS l, {_TO.format("right_id")} AS r FROM club_findings) WHERE l <> r GROUP BY finding_type, least(l, r), greatest(l, r)""", **ALL))
def merged_club_findings(spark, sf_dir):
    return _merged(spark, sf_dir, "findings")


@query(with_views("""SELECT game_id, season, CASE pool WHEN 'nba' THEN home_score + 100 ELSE home_score END AS home_score, pool FROM games WHERE pool <> 'national' OR game_date < DATE '1996-01-01'"""))
def republished_results(spark, sf_dir):
    """Results by pool; then one pool's again with other scores, and one of which only early games are left."""
    path = f"{S.shared_dir(spark)}/courtfold-{uuid.uuid4().hex}"
    g = view(spark, sf_dir, "games").select("game_id", "season", "home_score", "pool")
    dated = view(spark, sf_dir, "games").select("game_id", "season", "home_score", "pool", "game_date")
    S.publish(g, path, ["pool"])
    again = g.filter("pool = 'nba'").withColumn("home_score", F.col("home_score") + 100)
    S.publish(again.unionByName(dated.filter("pool = 'national' and game_date < '1996-01-01'").drop("game_date")), path, ["pool"], [("nba",), ("national",)])
    return S.published(spark, path, g.schema)
