"""Queries over audits that are resumed, and teams inferred from findings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators.store import kept, shared_dir
from .adapter import view, with_views
from .registry import query


@query(with_views("""SELECT season, sum(n)::BIGINT AS games, sum(m)::BIGINT AS n_missing, sum(n - 1)::BIGINT AS n_copies, season NOT IN ('1995-1996', '1990-1991') AS resumed FROM (
  SELECT season, count(*) AS n, count(*) FILTER (home_score IS NULL OR away_score IS NULL) AS m FROM (SELECT season, game_date, home_id, away_id, home_score, away_score FROM games
    UNION ALL SELECT season, game_date, home_id, away_id, NULL, away_score FROM games WHERE season = '1995-1996' UNION ALL SELECT '1990-1991', game_date, home_id, away_id, home_score, away_score FROM games WHERE season = '1994-1995')
  GROUP BY season, game_date, home_id, away_id) GROUP BY season"""))
def resumed_audit(spark, sf_dir):
    """An audit of all seasons, gone on with after games were added to one and another one came."""
    games = kept(view(spark, sf_dir, "games").select("season", "game_date", "home_id", "away_id", "home_score", "away_score"))
    path = f"{shared_dir(spark)}/courtfold-{uuid.uuid4().hex}"
    A.audit(games, path)
    more = games.filter("season = '1995-1996'").withColumn("home_score", F.lit(None).cast("long"))
    return A.audit(games.unionByName(more).unionByName(games.filter("season = '1994-1995'").withColumn("season", F.lit("1990-1991"))), path)


#: Findings that name a game's home team in prose, some its away team too, some a longer or doubtful name; a third give its id as well.
NAMED = {
    "places": """SELECT team_id, team_name FROM teams UNION ALL SELECT 100, 'Nation' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 102, 'nation 7' FROM region WHERE r_regionkey = 0
UNION ALL SELECT 103, 'Nation 3 B' FROM region WHERE r_regionkey = 0""",
    "told_of": """SELECT game_id AS finding_id, g.source, CASE WHEN game_id % 3 = 0 THEN concat('t', home_id) WHEN game_id % 3 = 1 THEN 'shared' END AS source_team_id,
  CASE WHEN game_id % 4 = 0 THEN concat('No metadata: (', lower(h.team_name), ')/', a.team_name, '.') WHEN game_id % 11 = 1 THEN 'Country of nation-3 b is missing' WHEN game_id % 11 = 2 THEN 'A nation united'
    WHEN game_id % 11 = 3 THEN concat('x', h.team_name) ELSE concat('Metadata of ', h.team_name, ' are missing') END AS evidence
FROM games g JOIN teams h ON h.team_id = home_id JOIN teams a ON a.team_id = away_id""",
    "told_ids": "SELECT source, concat('t', team_id) AS source_team_id, team_id FROM teams CROSS JOIN (SELECT DISTINCT source FROM games) s WHERE team_id % 4 > 0 UNION ALL SELECT source, 'shared', team_id FROM teams CROSS JOIN (SELECT DISTINCT source FROM games) s",
}


@query(with_views("""SELECT finding_id, coalesce(by_id, by_name) AS team_id, CASE WHEN by_id IS NOT NULL THEN 'source id' WHEN by_name IS NOT NULL THEN 'name' END AS how FROM (
  SELECT f.finding_id, i.team_id AS by_id, n.team_id AS by_name FROM told_of f
  LEFT JOIN (SELECT source, source_team_id, min(team_id) AS team_id FROM told_ids GROUP BY source, source_team_id HAVING count(DISTINCT team_id) = 1) i ON i.source = f.source AND i.source_team_id = f.source_team_id
  LEFT JOIN (SELECT x.evidence, min(x.team_id) AS team_id FROM found x WHERE NOT EXISTS (SELECT 1 FROM found y WHERE y.evidence = x.evidence AND y.at <= x.at AND y.at + y.n >= x.at + x.n AND y.n > x.n)
    GROUP BY x.evidence HAVING count(DISTINCT x.team_id) = 1) n ON n.evidence = f.evidence)""", **NAMED, found="""
SELECT evidence, team_id, strpos(norm, concat(' ', bare, ' ')) AS at, length(bare) AS n FROM (SELECT DISTINCT evidence, concat(' ', regexp_replace(upper(evidence), '[^A-Z0-9]+', ' ', 'g'), ' ') AS norm FROM told_of)
JOIN (SELECT team_id, regexp_replace(upper(team_name), '[^A-Z0-9]+', ' ', 'g') AS bare FROM places) ON contains(norm, concat(' ', bare, ' '))"""))
def inferred_teams(spark, sf_dir):
    return A.inferred_teams(*(view(spark, sf_dir, n, NAMED) for n in ("told_of", "told_ids", "places")))
