"""Queries over deliveries: past games from several sources, and a day's candidates, each with the tables that it leaves."""

from __future__ import annotations

from ..operators import ingest as I
from ..operators.store import kept
from .adapter import view, with_views
from .identity_queries import COMPACT
from .registry import query

TS = "CAST(game_date AS TIMESTAMP) + CAST(game_id % 24 AS INT) * INTERVAL '1' HOUR"
LATER = f"{TS} + CAST(game_id % 50 AS INT) * INTERVAL '1' HOUR"
#: Stored games, a quarter of them of the live source; of these each fifth has a double that is as near to what is delivered.
BACKFILL = {
    "held": f"""
SELECT concat('id', game_id) AS game_id, CASE WHEN game_id % 4 = 1 THEN 'live' ELSE source END AS source, source_game_id, competition_id, season, {TS} AS game_ts, home_id, away_id, home_score, away_score,
  status, round_name, eligible, CAST(NULL AS VARCHAR(99)) AS exclusion_reason, game_id % 10 IN (0, 1) AS manual FROM games WHERE game_id % 4 <> 3
UNION ALL SELECT concat('double', game_id), 'live', concat('double', game_id), competition_id, season, {LATER} + CAST(game_id % 50 AS INT) * INTERVAL '1' HOUR, home_id, away_id, home_score, away_score,
  status, round_name, eligible, CAST(NULL AS VARCHAR(99)), false FROM games WHERE game_id % 20 = 1""",
    "delivered": f"""
SELECT CASE game_id % 4 WHEN 1 THEN 'official' WHEN 2 THEN 'other' ELSE source END AS source, CASE game_id % 4 WHEN 1 THEN concat('o', game_id) WHEN 2 THEN concat('x', game_id) ELSE source_game_id END AS source_game_id,
  competition_id, season, CASE WHEN game_id % 4 = 1 THEN {LATER} ELSE {TS} END AS game_ts, home_id, CASE WHEN game_id % 24 = 2 THEN (away_id + 1) % 25 ELSE away_id END AS away_id,
  CASE WHEN game_id % 4 < 2 AND game_id % 3 = 0 THEN NULL WHEN game_id % 4 = 0 THEN home_score + 1 ELSE home_score END AS home_score,
  CASE WHEN game_id % 4 < 2 AND game_id % 3 = 0 THEN NULL ELSE away_score END AS away_score, CASE WHEN game_id % 4 < 2 AND game_id % 3 = 0 THEN 'scheduled' ELSE status END AS status,
  round_name, CASE WHEN game_id % 9 = 0 THEN 'unreviewed season' END AS exclusion_reason, game_id AS row_no FROM games""",
    "delivery": """SELECT * FROM delivered UNION ALL SELECT source, source_game_id, competition_id, season, game_ts, home_id, away_id, 1, 2, 'finished', 'Early', NULL, -1 FROM delivered WHERE row_no % 5 = 0""",
    "known_seasons": "SELECT DISTINCT competition_id, season FROM games WHERE game_id % 4 <> 3 AND competition_id <> 2",
}
_SIDE = "(d.{0}_id = h.{0}_id OR (SELECT country FROM teams WHERE team_id = d.{0}_id) = (SELECT country FROM teams WHERE team_id = h.{0}_id))"
OUTCOMES = {
    "own": "SELECT d.*, h.game_id AS own_id FROM delivered d LEFT JOIN held h ON h.source = d.source AND h.source_game_id = d.source_game_id",
    "near": """SELECT d.row_no, d.source, d.source_game_id, h.game_id AS other_id, abs(epoch(d.game_ts) - epoch(h.game_ts)) AS distance FROM own d JOIN held h ON h.source = 'live' AND d.source <> 'live' AND d.own_id IS NULL
  AND h.competition_id = d.competition_id AND h.home_id = d.home_id AND h.away_id = d.away_id AND abs(epoch(d.game_ts) - epoch(h.game_ts)) <= 36 * 3600""",
    "best": """SELECT row_no, source, source_game_id, min(other_id) AS other_id, count(*) AS n, min(distance) AS distance FROM near n
  WHERE distance = (SELECT min(distance) FROM near m WHERE m.row_no = n.row_no) GROUP BY row_no, source, source_game_id""",
    "claims": "SELECT row_no, other_id FROM (SELECT *, row_number() OVER (PARTITION BY other_id ORDER BY distance, source, source_game_id) AS rn FROM best WHERE n = 1) WHERE rn = 1",
    "same": f"""SELECT DISTINCT d.row_no FROM delivered d JOIN held h ON h.season = d.season AND h.source <> d.source AND CAST(h.game_ts AS DATE) = CAST(d.game_ts AS DATE)
  AND h.home_score IS NOT DISTINCT FROM d.home_score AND h.away_score IS NOT DISTINCT FROM d.away_score WHERE {_SIDE.format("home")} AND {_SIDE.format("away")}""",
    "outcomes": """SELECT o.*, CASE WHEN own_id IS NOT NULL THEN 'updated' WHEN b.n > 1 THEN 'ambiguous' WHEN c.other_id IS NOT NULL THEN 'reconciled' WHEN s.row_no IS NOT NULL THEN 'duplicate' ELSE 'inserted' END AS outcome,
  coalesce(own_id, c.other_id) AS met FROM own o LEFT JOIN best b ON b.row_no = o.row_no LEFT JOIN claims c ON c.row_no = o.row_no LEFT JOIN same s ON s.row_no = o.row_no""",
}
_ID = "md5(concat_ws('|', source, source_game_id))"


def _backfill(spark, sf_dir):
    v = lambda n: kept(view(spark, sf_dir, n, BACKFILL))  # noqa: E731  (views of many joins, each used more than once)
    return I.backfill(v("held"), v("delivery"), v("teams"), v("known_seasons"))


@query(with_views(f"SELECT source, source_game_id, outcome, coalesce(met, CASE WHEN outcome = 'inserted' THEN {_ID} END) AS game_id FROM outcomes", **BACKFILL, **OUTCOMES))
def backfill_outcomes(spark, sf_dir):
    """What each row of a delivery becomes, some of whose rows come twice."""
    return _backfill(spark, sf_dir)["outcomes"]


_KEPT = "(h.manual OR (n.outcome = 'reconciled' AND h.status = 'finished' AND n.status = 'scheduled' AND n.home_score IS NULL AND n.away_score IS NULL))"
_RESULT = ", ".join(f"CASE WHEN n.met IS NULL OR {_KEPT} THEN h.{c} ELSE n.{c} END AS {c}" for c in ("home_score", "away_score", "status", "round_name"))
_PLACE = ", ".join(f"CASE WHEN n.met IS NULL THEN h.{c} ELSE n.{c} END AS {c}" for c in I.PLACE)


@query(with_views(f"""SELECT h.game_id, {_PLACE}, {_RESULT}, CASE WHEN n.met IS NULL OR {_KEPT} THEN h.eligible ELSE n.exclusion_reason IS NULL END AS eligible,
  CASE WHEN n.met IS NULL OR {_KEPT} THEN h.exclusion_reason ELSE n.exclusion_reason END AS exclusion_reason, h.manual FROM held h LEFT JOIN (SELECT * FROM outcomes WHERE outcome IN ('updated', 'reconciled')) n ON n.met = h.game_id
UNION ALL SELECT {_ID}, source, source_game_id, competition_id, season, game_ts, home_id, away_id, home_score, away_score, status, round_name, exclusion_reason IS NULL, exclusion_reason, false FROM outcomes WHERE outcome = 'inserted'""", **BACKFILL, **OUTCOMES))
def backfilled_games(spark, sf_dir):
    return _backfill(spark, sf_dir)["games"]


@query(with_views("SELECT * FROM known_seasons UNION SELECT competition_id, season FROM outcomes WHERE outcome IN ('updated', 'reconciled', 'inserted')", **BACKFILL, **OUTCOMES))
def backfilled_seasons(spark, sf_dir):
    return _backfill(spark, sf_dir)["seasons"]


#: Planned and played games of another source, and a day's candidates for all of them under names and ids of which some are unknown.
DAILY = {
    "planned": f"""
SELECT concat('id', game_id) AS game_id, CASE WHEN game_id % 7 = 0 THEN 'daily' ELSE source END AS source, CASE WHEN game_id % 7 = 0 THEN concat('c', game_id) ELSE source_game_id END AS source_game_id, competition_id, season,
  {TS} AS game_ts, home_id, away_id, CASE WHEN game_id % 3 = 0 THEN home_score END AS home_score, CASE WHEN game_id % 3 = 0 THEN away_score END AS away_score,
  CASE WHEN game_id % 3 = 0 THEN 'finished' ELSE 'scheduled' END AS status, round_name, game_id % 3 = 0 AS eligible, CAST(NULL AS VARCHAR(99)) AS exclusion_reason, game_id % 14 = 0 AS manual FROM games WHERE game_id % 5 <> 0
UNION ALL SELECT concat('double', game_id), 'src9', concat('double', game_id), competition_id, season, {LATER} + CAST(game_id % 50 AS INT) * INTERVAL '1' HOUR, home_id, away_id, NULL, NULL, 'scheduled', round_name, false,
  CAST(NULL AS VARCHAR(99)), false FROM games WHERE game_id % 9 = 1""",
    "listed": "SELECT competition_id, competition_name, country, competition_id <> 4 AS active FROM competitions",
    "known": """
SELECT team_id, 'daily' AS source, concat('t', team_id) AS source_team_id, team_name AS alias_name, c.country FROM teams CROSS JOIN (SELECT DISTINCT country FROM competitions) c
UNION ALL SELECT team_id + 100, 'archive', concat('t', team_id), lower(team_name), country FROM teams WHERE team_id % 6 = 5
UNION ALL SELECT team_id + 200, 'daily', concat('t', team_id), 'unheard of', country FROM teams WHERE team_id % 6 = 3""",
    "candidates": f"""
SELECT concat('c', game_id) AS source_game_id, CASE WHEN game_id % 2 = 0 THEN concat(' ', lower(c.country)) ELSE c.country END AS country,
  CASE WHEN game_id % 13 = 0 THEN 'Unknown Cup' ELSE upper(competition_name) END AS competition, {LATER} AS game_ts, lower(h.team_name) AS home, CASE WHEN game_id % 17 = 0 THEN 'Nobody' ELSE concat(a.team_name, '.') END AS away,
  CASE WHEN game_id % 2 = 0 THEN concat('t', home_id) END AS home_source_id, CASE WHEN game_id % 17 > 3 THEN concat('t', away_id) END AS away_source_id,
  CASE WHEN status = 'scheduled' OR game_id % 19 = 0 THEN NULL ELSE home_score + 1 END AS home_score, CASE WHEN status = 'scheduled' THEN NULL ELSE away_score END AS away_score, status, round_name AS stage, game_id AS row_no
FROM games g JOIN competitions c ON c.competition_id = g.competition_id JOIN teams h ON h.team_id = home_id JOIN teams a ON a.team_id = away_id""",
    "told": """
SELECT concat('c', game_id) AS source_game_id, CASE WHEN game_id % 11 = 0 THEN 'ignored' ELSE 'open' END AS status, 'earlier' AS reasons,
  CASE WHEN game_id % 11 = 1 THEN concat('id', game_id) END AS assigned_game_id FROM games WHERE game_id % 11 < 3
UNION ALL SELECT 'gone', 'open', 'earlier', NULL""",
    "daily_seasons": "SELECT DISTINCT competition_id, season FROM games WHERE competition_id <> 1",
}


def _team(side: str) -> tuple[str, str]:
    name = f"{COMPACT.format('alias_name')} = {COMPACT.format('w.' + side)} AND k.country = w.own_country"
    by_id = f"(SELECT CASE WHEN count(DISTINCT team_id) = 1 THEN min(team_id) END FROM known k WHERE k.source = 'daily' AND k.source_team_id = w.{side}_source_id)"
    n = f"(SELECT count(DISTINCT team_id) FROM known k WHERE {name})"
    found = f"coalesce({by_id}, CASE WHEN {n} = 1 THEN (SELECT min(team_id) FROM known k WHERE {name}) END)"
    return found, f"CASE WHEN {found} IS NOT NULL THEN NULL WHEN {n} > 1 THEN 'ambiguous_{side}_team' ELSE 'unresolved_{side}_team' END"


_HOME, _AWAY = _team("home"), _team("away")
DAILY_OUTCOMES = {
    "joined": """SELECT q.*, l.competition_id, l.active, l.country AS own_country FROM candidates q LEFT JOIN listed l ON lower(trim(l.competition_name)) = lower(trim(q.competition)) AND lower(trim(l.country)) = lower(trim(q.country))""",
    "asked": "SELECT DISTINCT own_country, home, home_source_id, away, away_source_id FROM joined",
    "teamed": f"SELECT w.*, {_HOME[0]} AS home_id, {_AWAY[0]} AS away_id, {_HOME[1]} AS home_reason, {_AWAY[1]} AS away_reason FROM asked w",
    "seen": """SELECT j.*, t.home_id, t.away_id, CASE WHEN j.competition_id IS NULL THEN 'unknown_competition' ELSE concat_ws(',', home_reason, away_reason,
    CASE WHEN j.status = 'finished' AND (j.home_score IS NULL OR j.away_score IS NULL) THEN 'invalid_result' END) END AS why, r.status AS review_status, p.game_id AS own_id, g.game_id AS assigned_id,
    concat(year(j.game_ts) - CASE WHEN month(j.game_ts) < 7 THEN 1 ELSE 0 END, '-', year(j.game_ts) + CASE WHEN month(j.game_ts) < 7 THEN 0 ELSE 1 END) AS season
  FROM joined j JOIN teamed t ON t.own_country IS NOT DISTINCT FROM j.own_country AND t.home IS NOT DISTINCT FROM j.home AND t.away IS NOT DISTINCT FROM j.away
    AND t.home_source_id IS NOT DISTINCT FROM j.home_source_id AND t.away_source_id IS NOT DISTINCT FROM j.away_source_id
  LEFT JOIN told r ON r.source_game_id = j.source_game_id LEFT JOIN planned p ON p.source = 'daily' AND p.source_game_id = j.source_game_id LEFT JOIN planned g ON g.game_id = r.assigned_game_id""",
    "close": """SELECT s.source_game_id, p.game_id AS other_id, abs(epoch(s.game_ts) - epoch(p.game_ts)) AS distance FROM seen s JOIN planned p ON p.status = 'scheduled' AND p.source <> 'daily' AND p.competition_id = s.competition_id
    AND p.home_id = s.home_id AND p.away_id = s.away_id AND abs(epoch(s.game_ts) - epoch(p.game_ts)) <= 36 * 3600
  WHERE s.why = '' AND s.active AND coalesce(review_status, '') <> 'ignored' AND own_id IS NULL AND assigned_id IS NULL""",
    "nearest": "SELECT source_game_id, min(other_id) AS other_id, count(*) AS n, min(distance) AS distance FROM (SELECT *, min(distance) OVER (PARTITION BY source_game_id) AS least FROM close) WHERE distance = least GROUP BY source_game_id",
    "taken": "SELECT source_game_id, other_id FROM (SELECT *, row_number() OVER (PARTITION BY other_id ORDER BY distance, source_game_id) AS rn FROM nearest WHERE n = 1) WHERE rn = 1",
    "became": """SELECT s.*, CASE WHEN s.competition_id IS NULL THEN 'review' WHEN NOT active THEN 'skipped' WHEN why <> '' THEN 'review' WHEN review_status = 'ignored' THEN 'ignored' WHEN own_id IS NOT NULL THEN 'updated'
    WHEN assigned_id IS NOT NULL THEN 'reconciled' WHEN n.n > 1 THEN 'review' WHEN t.other_id IS NOT NULL THEN 'reconciled' ELSE 'inserted' END AS outcome,
    coalesce(own_id, assigned_id, t.other_id) AS met, coalesce(n.n, 0) > 1 AS unclear, s.status = 'finished' AND s.home_score IS NOT NULL AND s.away_score IS NOT NULL AS counts
  FROM seen s LEFT JOIN nearest n ON n.source_game_id = s.source_game_id LEFT JOIN taken t ON t.source_game_id = s.source_game_id""",
}
_NEW = "md5(concat_ws('|', 'daily', source_game_id))"
_WHY = "CASE WHEN outcome = 'review' THEN CASE WHEN why <> '' THEN why ELSE 'ambiguous_planned_fixture' END END"


def _daily(spark, sf_dir):
    v = lambda n: kept(view(spark, sf_dir, n, DAILY))
    return I.daily(v("planned"), v("candidates"), v("told"), v("listed"), v("known"), v("daily_seasons"), "daily")


@query(with_views(f"""SELECT source_game_id, outcome, CASE WHEN outcome = 'inserted' THEN {_NEW} WHEN outcome IN ('updated', 'reconciled') THEN met END AS game_id, {_WHY} AS reasons FROM became""", **DAILY, **DAILY_OUTCOMES))
def daily_outcomes(spark, sf_dir):
    return _daily(spark, sf_dir)["outcomes"]


_RES = ", ".join(f"CASE WHEN n.met IS NULL OR p.manual THEN p.{c} ELSE {x} END AS {c}" for c, x in (
    ("home_score", "n.home_score"), ("away_score", "n.away_score"), ("status", "n.status"), ("round_name", "n.stage"), ("eligible", "n.counts"),
    ("exclusion_reason", "CASE WHEN NOT n.counts AND n.status <> 'scheduled' THEN 'current_result_not_final' END")))
_PLC = ", ".join(f"CASE WHEN n.met IS NULL THEN p.{c} ELSE n.{c} END AS {c}" for c in ("competition_id", "season", "game_ts", "home_id", "away_id"))


@query(with_views(f"""SELECT p.game_id, p.source, p.source_game_id, {_PLC}, {_RES}, p.manual FROM planned p LEFT JOIN (SELECT * FROM became WHERE outcome IN ('updated', 'reconciled')) n ON n.met = p.game_id
UNION ALL SELECT {_NEW}, 'daily', source_game_id, competition_id, season, game_ts, home_id, away_id, home_score, away_score, status, stage, counts, CASE WHEN NOT counts AND status <> 'scheduled' THEN 'current_result_not_final' END, false
FROM became WHERE outcome = 'inserted'""", **DAILY, **DAILY_OUTCOMES))
def daily_games_after(spark, sf_dir):
    return _daily(spark, sf_dir)["games"]


@query(with_views(f"""SELECT source_game_id, CASE WHEN b.outcome = 'review' AND NOT (coalesce(r.status, '') = 'ignored' AND b.why <> 'unknown_competition') THEN 'open'
  WHEN b.outcome IN ('updated', 'reconciled', 'inserted') AND coalesce(r.status, 'open') = 'open' THEN 'resolved' ELSE coalesce(r.status, 'open') END AS status,
  CASE WHEN b.outcome = 'review' THEN {_WHY} ELSE r.reasons END AS reasons, coalesce(CASE WHEN b.outcome = 'reconciled' THEN met END, r.assigned_game_id) AS assigned_game_id
FROM told r FULL JOIN became b USING (source_game_id) WHERE r.status IS NOT NULL OR b.outcome IN ('review', 'reconciled')""", **DAILY, **DAILY_OUTCOMES))
def daily_reviews(spark, sf_dir):
    return _daily(spark, sf_dir)["reviews"]


@query(with_views("SELECT * FROM daily_seasons UNION SELECT competition_id, season FROM became WHERE outcome IN ('updated', 'reconciled', 'inserted')", **DAILY, **DAILY_OUTCOMES))
def daily_seasons_after(spark, sf_dir):
    return _daily(spark, sf_dir)["seasons"]
