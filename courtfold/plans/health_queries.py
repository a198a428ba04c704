"""Queries over the health of identities: all findings of a check, its state, and the pairs to review."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health as H
from .adapter import view, with_views
from .identity_queries import COMPACT
from .registry import query

#: Customers as clubs, two in a row with one name, every fifth with a letter changed, some seen under a second name or under the id of the next; each order is a game.
CLUBS = {
    "clubs": """SELECT c_custkey AS team_id, concat('Club ', c_custkey) AS team_name, CASE c_nationkey % 6 WHEN 0 THEN 'UNK' WHEN 1 THEN NULL WHEN 2 THEN 'DE' ELSE 'FR' END AS country, c_custkey % 9 <> 0 AS is_active FROM customer""",
    "spelled": "SELECT c_custkey AS k, upper(substr(md5(CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING)), 1, 12)) AS x FROM customer",
    "club_aliases": """SELECT k AS team_id, concat('s', CAST(floor(k / 3) AS BIGINT) % 2) AS source, concat('t', CASE WHEN k % 50 = 7 THEN k - 1 ELSE k END) AS source_team_id,
  concat(substr(x, 1, 5), CASE WHEN k % 10 = 5 THEN '-Z' ELSE substr(x, 6, 1) END, substr(x, 7)) AS alias_name FROM spelled
UNION ALL SELECT k, concat('s', CAST(floor(k / 3) AS BIGINT) % 2), concat('t', CASE WHEN k % 50 = 7 THEN k - 1 ELSE k END), concat(' Old ', x) FROM spelled WHERE k % 13 = 0
UNION ALL SELECT k, 's9', concat('u', k), lower(x) FROM spelled WHERE k % 4 < 2""",
    "club_games": """SELECT o_orderkey AS game_id, o_custkey % 1000 * 7 % 1000 + 1 AS home_id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS away_id, CAST(floor(o_custkey / 2) AS BIGINT) % 4 + 10 AS competition_id,
  CAST(year(o_orderdate) AS STRING) AS season, CAST(o_orderdate AS DATE) AS game_date FROM orders WHERE o_custkey % 5 <> 1
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_custkey % 1000 * 7 % 1000 + 1, CAST(floor(o_custkey / 2) AS BIGINT) % 4 + 10, CAST(year(o_orderdate) AS STRING), CAST(o_orderdate AS DATE) FROM orders WHERE o_custkey % 5 = 1""",
    "leagues": "SELECT DISTINCT competition_id, CASE WHEN competition_id % 2 = 0 THEN 'FR' ELSE 'DE' END AS country FROM club_games",
    "club_seasons": "SELECT DISTINCT competition_id, season, CAST(concat(season, '-02-01') AS DATE) AS first, CAST(concat(season, '-11-30') AS DATE) AS last FROM club_games",
    "decided": """SELECT concat('alias_observation|', team_id, ':', team_id, '|', lower(source), ':', source_team_id) AS decision, 'accept' AS action, team_id AS left_id, CAST(NULL AS BIGINT) AS right_id FROM club_aliases WHERE team_id % 39 = 0
UNION ALL SELECT concat('other ', c_custkey), 'keep_separate', c_custkey, c_custkey - 1 FROM customer WHERE c_custkey % 6 = 1""",
}


def _tables(spark, sf_dir):
    return {n: view(spark, sf_dir, n, CLUBS) for n in ("clubs", "club_aliases", "club_games", "leagues", "club_seasons", "decided")}


def _open(spark, sf_dir):
    t = _tables(spark, sf_dir)
    f = H.all_findings(t["clubs"], t["club_aliases"], t["club_games"], t["leagues"], t["club_seasons"])
    return t, H.undecided(f, t["decided"])


FOUND = {
    "sides": "SELECT home_id AS team_id, competition_id, season FROM club_games UNION ALL SELECT away_id, competition_id, season FROM club_games",
    "played_in": "SELECT DISTINCT team_id, competition_id FROM sides",
    "years": "SELECT DISTINCT s.team_id, s.competition_id, s.season, y.first, y.last FROM sides s JOIN club_seasons y ON y.competition_id = s.competition_id AND y.season = s.season",
    "compact": f"SELECT *, {COMPACT.format('alias_name')} AS name FROM club_aliases",
    "names_of": "SELECT DISTINCT team_id, name FROM compact",
    "alike": """SELECT l.team_id AS left_id, r.team_id AS right_id, l.name AS left_name, r.name AS right_name FROM names_of l JOIN names_of r ON l.team_id < r.team_id
  AND (l.name = r.name OR contains(l.name, r.name) OR contains(r.name, l.name) OR 1 - levenshtein(l.name, r.name)::DOUBLE / greatest(length(l.name), length(r.name)) >= 0.86)""",
    "overlapping": """SELECT p.left_id, p.right_id FROM (SELECT DISTINCT left_id, right_id FROM alike) p JOIN clubs l ON l.team_id = p.left_id JOIN clubs r ON r.team_id = p.right_id
  WHERE (coalesce(l.country, 'UNK') = 'UNK' OR coalesce(r.country, 'UNK') = 'UNK' OR l.country = r.country)
    AND (NOT EXISTS (SELECT 1 FROM played_in a WHERE a.team_id = p.left_id) OR NOT EXISTS (SELECT 1 FROM played_in a WHERE a.team_id = p.right_id)
      OR EXISTS (SELECT 1 FROM played_in a JOIN played_in b ON a.competition_id = b.competition_id WHERE a.team_id = p.left_id AND b.team_id = p.right_id))""",
    "findings": """SELECT 'missing_metadata' AS finding_type, 'warning' AS severity, NULL AS source, NULL AS source_team_id, c.team_id, NULL AS other_source, NULL AS other_source_team_id, NULL::BIGINT AS other_id, NULL::BIGINT AS competition_id,
    c.team_name AS evidence, s.country AS suggestion FROM clubs c LEFT JOIN (SELECT team_id, min(country) AS country FROM played_in JOIN leagues USING (competition_id) GROUP BY team_id HAVING count(DISTINCT country) = 1) s ON s.team_id = c.team_id WHERE coalesce(c.country, 'UNK') = 'UNK'
  UNION ALL SELECT 'alias_observation', 'warning', source, source_team_id, team_id, NULL, NULL, NULL, NULL, array_to_string(list_sort(list(DISTINCT alias_name)), ', '), NULL FROM club_aliases GROUP BY source, source_team_id, team_id HAVING count(DISTINCT upper(trim(alias_name))) > 1
  UNION ALL SELECT 'source_team_split', 'blocker', source, source_team_id, ids[1], source, source_team_id, ids[2], NULL, NULL, NULL FROM (SELECT source, source_team_id, list_sort(list(DISTINCT team_id)) AS ids FROM club_aliases GROUP BY ALL) WHERE len(ids) > 1
  UNION ALL SELECT kind, 'blocker', m[1], m[2], left_id, m[3], m[4], right_id, NULL, left_name, NULL FROM (
    SELECT p.left_id, p.right_id, p.left_name, CASE WHEN l.source = r.source THEN 'possible_duplicate' ELSE 'possible_cross_source_match' END AS kind, min([l.source, l.source_team_id, r.source, r.source_team_id]) AS m
    FROM alike p JOIN overlapping o ON o.left_id = p.left_id AND o.right_id = p.right_id JOIN compact l ON l.team_id = p.left_id AND l.name = p.left_name JOIN compact r ON r.team_id = p.right_id AND r.name = p.right_name GROUP BY ALL)
  UNION ALL SELECT 'possible_cross_season_split', 'blocker', NULL, NULL, p.left_id, NULL, NULL, p.right_id, l.competition_id, any_value(p.n), NULL
    FROM (SELECT left_id, right_id, concat(min([left_name, right_name])[1], ' / ', min([left_name, right_name])[2]) AS n FROM alike GROUP BY ALL) p JOIN years l ON l.team_id = p.left_id JOIN years r ON r.team_id = p.right_id AND r.competition_id = l.competition_id
    WHERE l.season <> r.season AND CASE WHEN l.last <= r.first THEN r.first - l.last ELSE l.first - r.last END BETWEEN 0 AND 370 GROUP BY p.left_id, p.right_id, l.competition_id""",
    "left_open": """SELECT * FROM findings f WHERE NOT (finding_type = 'alias_observation' AND team_id % 39 = 0) AND NOT (other_id IS NOT NULL AND abs(team_id - other_id) = 1 AND greatest(team_id, other_id) % 6 = 1)""",
    "stated": "SELECT *, CASE WHEN team_id % 7 = 0 THEN 'deferred' ELSE 'open' END AS status FROM left_open",
    "paired": """SELECT team_id AS left_id, other_id AS right_id, CASE WHEN team_id % 7 = 0 THEN 'deferred' ELSE 'open' END AS status, 'blocker' AS severity, array_to_string(list_sort(list(DISTINCT finding_type)), ',') AS types, count(*) AS n,
  array_to_string(list_sort(list(DISTINCT evidence))[1:5], ',') AS evidence FROM stated WHERE finding_type IN ('possible_duplicate', 'possible_cross_source_match', 'possible_cross_season_split') GROUP BY team_id, other_id""",
    "facts": """SELECT c.*, coalesce(g.n, 0) AS n_games, coalesce(a.n, 0) AS n_aliases, g.last_date FROM clubs c LEFT JOIN (SELECT team_id, count(*) AS n, max(game_date) AS last_date FROM (
  SELECT home_id AS team_id, game_date FROM club_games UNION ALL SELECT away_id, game_date FROM club_games) GROUP BY team_id) g ON g.team_id = c.team_id LEFT JOIN (SELECT team_id, count(*) AS n FROM club_aliases GROUP BY team_id) a ON a.team_id = c.team_id""",
}


@query(with_views(f"SELECT {', '.join(H.COLUMNS)} FROM left_open", **CLUBS, **FOUND))
def identity_findings(spark, sf_dir):
    """All findings of a check that no decision has settled."""
    return _open(spark, sf_dir)[1].select(*H.COLUMNS)


@query(with_views("SELECT count(*) AS n_findings, count(*) FILTER (severity = 'blocker') AS n_blockers, 'blockers' AS state FROM left_open", **CLUBS, **FOUND))
def identity_health(spark, sf_dir):
    return H.check_state(_open(spark, sf_dir)[1])


@query(with_views(f"""SELECT p.*, {', '.join(f"{s}.{c} AS {n}_{c}" for s, n in (("l", "left"), ("r", "right")) for c in ("team_name", "country", "is_active", "n_games", "n_aliases", "last_date"))}
FROM paired p JOIN facts l ON l.team_id = left_id JOIN facts r ON r.team_id = right_id WHERE p.status = 'deferred' ORDER BY l.n_games + r.n_games DESC, l.team_name, left_id, right_id LIMIT 50""", **CLUBS, **FOUND))
def review_candidates(spark, sf_dir):
    """The first fifty of the pairs whose review was put off."""
    t, f = _open(spark, sf_dir)
    f = f.withColumn("status", F.when(F.col("team_id") % 7 == 0, "deferred").otherwise("open"))
    return H.review_candidates(f, t["clubs"], t["club_aliases"], t["club_games"], status="deferred", most=50)
