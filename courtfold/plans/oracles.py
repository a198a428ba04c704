"""SQL of the rating replay for the oracle: a recursive query over the games of each pool in order, with the ratings as a list."""

from __future__ import annotations

from ..functions.rating import Ruleset
from .adapter import with_views

TEAMS = 25
D = lambda x: f"CAST({x!r} AS DOUBLE)"


def _change(r: Ruleset) -> str:
    if not r.margin:
        return f"{D(r.k)} * (won - e) * {D(r.weight)}", "CAST(1 AS DOUBLE)"
    over = f"(CASE WHEN won = 1 THEN hs - aw - diff / {D(r.points)} ELSE aw - hs + diff / {D(r.points)} END)"
    boost = f"least(ln(abs({over}) + 1) / {D(r.damp)}, {D(r.most - 1)})"
    times = f"(CASE WHEN {over} >= 0 THEN least(1 + {boost}, {D(r.most)}) ELSE greatest(1 / (1 + {boost}), {D(1 / r.most)}) END)"
    return f"{D(r.k)} * (won - e) * m * {D(r.weight)}", times


def fold(r: Ruleset, games: str = "rated_games") -> dict[str, str]:
    """Views seq and fold (one row a game) for a ruleset, over a view of games."""
    change, times = _change(r)
    every = f"range({TEAMS})"
    better = lambda who, post: f"1 + len(list_filter({every}, lambda i: new[i + 1] IS NOT NULL AND (new[i + 1] > {post} OR (new[i + 1] = {post} AND i < {who}))))"
    return {
        "seq": f"SELECT *, row_number() OVER (PARTITION BY pool ORDER BY game_date, source, source_game_id, game_id) AS rn FROM {games}",
        "fold": f"""
SELECT pool, CAST(0 AS BIGINT) AS rn, list_transform({every}, lambda i: CAST(NULL AS DOUBLE)) AS elos, NULL::BIGINT AS game_id, NULL::DATE AS game_date, NULL::BIGINT AS competition_id,
  NULL::VARCHAR AS season, NULL::BIGINT AS home_id, NULL::BIGINT AS away_id, NULL::DOUBLE AS h, NULL::DOUBLE AS a, NULL::DOUBLE AS won, NULL::DOUBLE AS e, NULL::DOUBLE AS m, NULL::DOUBLE AS d,
  NULL::DOUBLE AS margin, NULL::DOUBLE AS diff, NULL::BIGINT AS home_rank, NULL::BIGINT AS away_rank FROM (SELECT DISTINCT pool FROM {games})
UNION ALL
SELECT pool, rn, new, game_id, game_date, competition_id, season, home_id, away_id, h, a, won, e, m, d, hs - aw, diff, {better("home_id", "(h + d)")}, {better("away_id", "(a - d)")} FROM (
  SELECT *, list_transform({every}, lambda i: CASE WHEN i = home_id THEN h + d WHEN i = away_id THEN a - d ELSE elos[i + 1] END) AS new FROM (
    SELECT *, {change} AS d FROM (SELECT *, {times} AS m, 1 / (1 + pow(CAST(10 AS DOUBLE), -diff / {D(r.scale)})) AS e FROM (
      SELECT *, h + {D(r.home_advantage)} - a AS diff FROM (
        SELECT f.elos, s.pool, s.rn, s.game_id, s.game_date, s.competition_id, s.season, s.home_id, s.away_id, CAST(s.home_score AS DOUBLE) AS hs, CAST(s.away_score AS DOUBLE) AS aw,
          coalesce(f.elos[s.home_id + 1], {D(r.base)}) AS h, coalesce(f.elos[s.away_id + 1], {D(r.base)}) AS a, CAST(s.home_score > s.away_score AS INT)::DOUBLE AS won
        FROM fold f JOIN seq s ON s.pool = f.pool AND s.rn = f.rn + 1)))))""",
    }


HISTORY = """
SELECT *, row_number() OVER (PARTITION BY pool, team_id ORDER BY seq) - 1 AS games_before FROM (
  SELECT pool, rn AS seq, game_id, game_date, competition_id, season, home_id AS team_id, away_id AS opponent_id, true AS is_home, h AS pre, h + d AS post, d AS change, e AS expected,
    won AS actual, m AS multiplier, home_rank AS rank_after FROM fold WHERE rn > 0
  UNION ALL
  SELECT pool, rn, game_id, game_date, competition_id, season, away_id, home_id, false, a, a - d, -d, 1 - e, 1 - won, m, away_rank FROM fold WHERE rn > 0)"""

SNAPSHOT = """
SELECT pool, team_id, round(post, 2) AS elo, games_before + 1 AS games, game_id AS last_game_id, game_date AS last_date FROM (
  SELECT *, row_number() OVER (PARTITION BY pool, team_id ORDER BY seq DESC) AS latest FROM history) WHERE latest = 1"""


def over_history(sql: str, r: Ruleset, games: str = "rated_games", **more: str) -> str:
    """SQL over the views history and snapshot of one ruleset's replay."""
    return with_views(sql, recursive=True, **fold(r, games), history=HISTORY, snapshot=SNAPSHOT, **more)
