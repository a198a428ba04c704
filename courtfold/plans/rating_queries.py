"""Queries over the rating replay."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.rating import RULESETS, Ruleset, custom
from ..operators import rankings as R
from ..operators import rating as E
from .adapter import view, with_views, written
from .oracles import HISTORY, D, fold, over_history
from .registry import query

ADJUSTED, BASIC, MARGIN = RULESETS.values()
HISTORY_COLUMNS = ["pool", "seq", "game_id", "team_id", "opponent_id", "is_home", "pre", "post", "change", "expected", "actual", "multiplier", "games_before", "rank_after"]
HISTORY_SQL = """
SELECT pool, seq, game_id, team_id, opponent_id, is_home, round(pre, 2) AS pre, round(post, 2) AS post, round(change, 2) AS change, round(expected, 4) AS expected, actual,
  round(multiplier, 4) AS multiplier, games_before, rank_after FROM history"""


def history(spark, sf_dir, rules: Ruleset = ADJUSTED):
    """The replay of a folder's games, written once for each state of its tables, as a rebuild writes it, and read by every query over it."""
    return written(spark, sf_dir, rules.name, lambda: E.replay(view(spark, sf_dir, "games"), [rules]))


def ranked(sql: str, **more: str) -> str:
    return over_history(sql, ADJUSTED, **more)


def _history_query(rules):
    return lambda spark, sf_dir: E.rounded(history(spark, sf_dir, rules)).select(*HISTORY_COLUMNS)


for _name, _rules in (("adjusted", ADJUSTED), ("basic", BASIC), ("point_margin", MARGIN)):
    query(over_history(HISTORY_SQL, _rules), f"rating_history_{_name}")(_history_query(_rules))


@query(ranked("SELECT * FROM snapshot"))
def rating_snapshot(spark, sf_dir):
    return E.snapshot(history(spark, sf_dir)).drop("ruleset")


#: Games of which some are finished but not eligible, in all pools but one.
GATED = """SELECT * EXCLUDE (status, eligible), CASE WHEN game_id % 97 = 0 THEN 'finished' ELSE status END AS status, eligible AND NOT (game_id % 97 = 0 AND pool <> 'nba') AS eligible FROM games"""


def gated(spark, sf_dir):
    g = F.col("game_id") % 97 == 0
    return view(spark, sf_dir, "games").withColumns({"status": F.when(g, "finished").otherwise(F.col("status")), "eligible": F.col("eligible") & ~(g & (F.col("pool") != "nba"))})


@query(with_views("SELECT pool, count(*) AS n_blocking, arg_min(game_id, (game_date, source, game_id)) AS first_game_id FROM gated WHERE status = 'finished' AND NOT eligible GROUP BY pool", gated=GATED))
def rebuild_gate(spark, sf_dir):
    return E.gate(gated(spark, sf_dir))


_gated = fold(ADJUSTED, "open_games")


@query(with_views("""SELECT pool, game_id, team_id, round(post, 2) AS post FROM history
UNION ALL SELECT pool, -1 AS game_id, 7 AS team_id, 1543.0 AS post FROM (SELECT DISTINCT pool FROM gated WHERE status = 'finished' AND NOT eligible)""", recursive=True, gated=GATED,
                  open_games="""SELECT * FROM gated WHERE eligible AND home_score IS NOT NULL AND away_score IS NOT NULL AND home_score <> away_score
  AND pool NOT IN (SELECT pool FROM gated WHERE status = 'finished' AND NOT eligible)""", **_gated, history=HISTORY))
def rebuilt_history(spark, sf_dir):
    """A rebuild over stored ratings: pools in the gate keep them, the others are replayed."""
    games = gated(spark, sf_dir)
    one = games.select("pool").distinct()
    old = {"game_id": F.lit(-1).cast("long"), "team_id": F.lit(7).cast("long"), "post": F.lit(1543.0), "ruleset": F.lit(ADJUSTED.name)}
    stored = one.select("pool", *[old[f.name].alias(f.name) if f.name in old else F.lit(None).cast(_TYPES[f.name]).alias(f.name) for f in E.HISTORY if f.name != "pool"])
    return E.rebuilt(games, stored, [ADJUSTED]).select("pool", "game_id", "team_id", F.round("post", 2).alias("post"))


_TYPES = dict(x.rsplit(" ", 1) for x in E.DDL.split(", "))


RANKINGS_SQL = """
SELECT s.pool, s.team_id, team_name, country, elo, games, global_rank, row_number() OVER (PARTITION BY s.pool ORDER BY elo DESC, team_name) AS list_rank, latest_change FROM (
  SELECT s.*, team_name, country, row_number() OVER (PARTITION BY s.pool ORDER BY elo DESC, team_name) AS global_rank FROM snapshot s JOIN teams USING (team_id){current}) s
JOIN (SELECT pool, team_id, round(arg_max(change, (game_date, game_id)), 2) AS latest_change FROM history GROUP BY pool, team_id) c ON c.pool = s.pool AND c.team_id = s.team_id{where}"""
CURRENT = """
SELECT DISTINCT pool, team_id FROM (SELECT pool, season, unnest([home_id, away_id]) AS team_id FROM games) s JOIN teams t USING (team_id)
WHERE (pool = 'nba' AND is_active) OR (pool = 'europe' AND season = (SELECT max(season) FROM games WHERE pool = 'europe')) OR (pool = 'national' AND team_name <> 'NATION_2')"""


@query(ranked(RANKINGS_SQL.format(current="", where="")))
def rankings(spark, sf_dir):
    h = history(spark, sf_dir)
    return R.rankings(E.snapshot(h), view(spark, sf_dir, "teams"), R.latest_change(h))


@query(ranked(RANKINGS_SQL.format(current=" JOIN current USING (pool, team_id)", where=" WHERE contains(lower(team_name), 'nation_1') AND games >= 20"), current=CURRENT))
def rankings_current_search(spark, sf_dir):
    h, teams = history(spark, sf_dir), view(spark, sf_dir, "teams")
    current = R.current_teams(view(spark, sf_dir, "games"), teams, ["nation_2"])
    return R.rankings(E.snapshot(h), teams, R.latest_change(h), current, search="Nation_1", least_games=20)


@query(with_views("SELECT * FROM current", current=CURRENT))
def current_teams(spark, sf_dir):
    return R.current_teams(view(spark, sf_dir, "games"), view(spark, sf_dir, "teams"), ["nation_2"])


@query(ranked("""SELECT pool, team_id, round(post, 2) AS elo, games_before + 1 AS games, game_date AS last_date FROM (
  SELECT *, row_number() OVER (PARTITION BY pool, team_id ORDER BY game_date DESC, game_id DESC) AS rn FROM history WHERE game_date <= DATE '1998-06-30') WHERE rn = 1"""))
def rankings_as_of(spark, sf_dir):
    return R.as_of(history(spark, sf_dir), date(1998, 6, 30)).drop("ruleset")


@query(ranked("SELECT pool, team_id, elo, rank() OVER (PARTITION BY pool ORDER BY elo DESC) AS rank FROM snapshot"))
def competition_rank(spark, sf_dir):
    return R.competition_rank(E.snapshot(history(spark, sf_dir))).select("pool", "team_id", "elo", "rank")


@query(ranked("""SELECT pool, team_id, round(arg_min(pre, (game_date, game_id)), 2) AS start_elo, round(arg_max(post, (game_date, game_id)), 2) AS end_elo, round(sum(change), 2) AS elo_change,
  count(*) AS games, min(game_date) AS first_date, max(game_date) AS last_date FROM history JOIN (SELECT pool, max(game_date) AS until FROM history GROUP BY pool) USING (pool)
WHERE game_date >= until - 365 GROUP BY pool, team_id"""))
def movers(spark, sf_dir):
    return R.movers(history(spark, sf_dir)).drop("ruleset")


@query(ranked("""SELECT pool, team_id, game_date, game_id, round(post, 2) AS elo, rn, total FROM (
  SELECT *, row_number() OVER (PARTITION BY pool, team_id, bucket ORDER BY distance, rn) AS pick FROM (
    SELECT *, CASE WHEN total <= 40 THEN rn ELSE round((rn - 1) * 39::DOUBLE / (total - 1)) END AS bucket,
      CASE WHEN total <= 40 THEN 0 ELSE abs((rn - 1) * 39::DOUBLE / (total - 1) - round((rn - 1) * 39::DOUBLE / (total - 1))) END AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY pool, team_id ORDER BY game_date, game_id) AS rn, count(*) OVER (PARTITION BY pool, team_id) AS total FROM history))) WHERE pick = 1"""))
def rating_evolution(spark, sf_dir):
    return R.evolution(history(spark, sf_dir), 40)


@query(ranked("""SELECT pool, team_id, game_id, rn, total, round(post, 2) AS elo FROM (
  SELECT *, row_number() OVER (PARTITION BY pool, team_id ORDER BY game_date, game_id) AS rn, count(*) OVER (PARTITION BY pool, team_id) AS total FROM history)
WHERE total <= 60 OR rn - 1 IN (SELECT floor(i * (total - 1) / 59::DOUBLE + 0.5) FROM range(60) r(i))"""))
def rating_even_sample(spark, sf_dir):
    return R.even_sample(history(spark, sf_dir), 60)


FORM = """
SELECT pool, team_id, count(*) FILTER (actual = 1) AS wins, count(*) FILTER (actual <> 1) AS losses, round(sum(change), 2) AS change, round(avg(opponent_pre), 2) AS avg_opponent,
  arg_max(opponent_id, (opponent_pre, game_id)) FILTER (actual = 1) AS best_win, arg_min(opponent_id, (opponent_pre, game_id)) FILTER (actual <> 1) AS worst_loss
FROM (SELECT h.*, o.pre AS opponent_pre, row_number() OVER (PARTITION BY h.pool, h.team_id ORDER BY h.game_date DESC, h.game_id DESC) AS rn
  FROM history h JOIN history o ON o.pool = h.pool AND o.game_id = h.game_id AND o.team_id = h.opponent_id) WHERE rn <= {n} GROUP BY pool, team_id"""


@query(ranked(FORM.format(n=5)))
def team_form_5(spark, sf_dir):
    return R.form(history(spark, sf_dir), 5).drop("ruleset")


@query(ranked(FORM.format(n=10)))
def team_form_10(spark, sf_dir):
    return R.form(history(spark, sf_dir), 10).drop("ruleset")


RESAMPLE = """
SELECT pool, team_id, CASE WHEN period = last_period THEN last_date ELSE CAST(period + INTERVAL {step} AS DATE) - 1 END AS point_date,
  round(last_value(post IGNORE NULLS) OVER (PARTITION BY pool, team_id ORDER BY period), 2) AS elo, post IS NULL AS filled FROM (
  SELECT g.pool, g.team_id, g.period, g.last_period, g.last_date, l.post FROM (SELECT pool, team_id, max(date_trunc('{unit}', game_date)::TIMESTAMP) AS last_period, max(game_date) AS last_date,
    unnest(generate_series(min(date_trunc('{unit}', game_date)::TIMESTAMP), max(date_trunc('{unit}', game_date)::TIMESTAMP), INTERVAL {step})) AS period FROM history GROUP BY pool, team_id) g
  LEFT JOIN (SELECT pool, team_id, date_trunc('{unit}', game_date)::TIMESTAMP AS period, arg_max(post, (game_date, game_id)) AS post FROM history GROUP BY ALL) l USING (pool, team_id, period))"""


@query(ranked(RESAMPLE.format(unit="month", step="1 MONTH")))
def rating_by_month(spark, sf_dir):
    return R.resample(history(spark, sf_dir), "month")


@query(ranked(RESAMPLE.format(unit="week", step="7 DAYS")))
def rating_by_week(spark, sf_dir):
    return R.resample(history(spark, sf_dir), "week")


@query(with_views("SELECT pool, game_date, dense_rank() OVER (PARTITION BY pool ORDER BY game_date) AS date_index FROM (SELECT DISTINCT pool, game_date FROM rated_games)"))
def date_index(spark, sf_dir):
    return R.date_index(view(spark, sf_dir, "rated_games"))


@query(ranked("""SELECT pool, team_id, game_date, game_id, round(post, 2) AS elo FROM (
  SELECT *, row_number() OVER (PARTITION BY pool, team_id ORDER BY abs(game_date - DATE '1997-03-15'), game_date, game_id) AS rn FROM history) WHERE rn = 1"""))
def nearest_rating(spark, sf_dir):
    return R.nearest_point(history(spark, sf_dir), date(1997, 3, 15))


@query(ranked("""SELECT g.game_id, competition_name, h.team_name AS home_name, a.team_name AS away_name, home_score, away_score, round(f.h, 2) AS home_pre, round(f.a, 2) AS away_pre,
  round(e, 4) AS expected, round(m, 4) AS multiplier, round(d, 2) AS change FROM games g JOIN fold f USING (game_id) JOIN competitions c ON c.competition_id = g.competition_id
JOIN teams h ON h.team_id = g.home_id JOIN teams a ON a.team_id = g.away_id"""))
def game_explanation(spark, sf_dir):
    return R.explain(view(spark, sf_dir, "games"), history(spark, sf_dir), view(spark, sf_dir, "teams"), view(spark, sf_dir, "competitions"))


@query(ranked("""SELECT game_id, g.game_date, home_id, away_id, h.elo AS home_elo, a.elo AS away_elo, round(h.elo - a.elo, 2) AS gap FROM games g
LEFT JOIN snapshot h ON h.pool = g.pool AND h.team_id = g.home_id LEFT JOIN snapshot a ON a.pool = g.pool AND a.team_id = g.away_id WHERE status = 'scheduled' AND home_score IS NULL"""))
def upcoming_games(spark, sf_dir):
    return R.upcoming(view(spark, sf_dir, "games"), E.snapshot(history(spark, sf_dir)))


@query(ranked("""SELECT game_id, team_id, opponent_id, round(h.pre, 2) AS pre, round(o.pre, 2) AS opponent_pre FROM history h JOIN history o USING (pool, game_id) WHERE o.team_id = h.opponent_id""".replace(
    "SELECT game_id, team_id, opponent_id", "SELECT game_id, h.team_id, h.opponent_id")))
def opponent_ratings(spark, sf_dir):
    return R.with_opponent(history(spark, sf_dir)).select("game_id", "team_id", "opponent_id", F.round("pre", 2).alias("pre"), F.round("opponent_pre", 2).alias("opponent_pre"))


#: The registered backtest: a custom model beside the adjusted ruleset.
MODEL = custom("adjusted-v1", name="model", k=28.0, home_advantage=85.0, most=2.0)
WARM, SCORED = (date(1995, 1, 1), date(1996, 12, 31)), (date(1997, 7, 1), date(1999, 12, 31))
LAB_GAMES = "SELECT * FROM rated_games WHERE game_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' OR game_date BETWEEN DATE '1997-07-01' AND DATE '1999-12-31'"


def _lab(sql: str) -> str:
    """SQL over `pred`: stored predictions of both models."""
    views: dict[str, str] = {"lab_games": LAB_GAMES}
    parts = []
    for tag, rules in (("a", MODEL), ("b", ADJUSTED)):
        own = fold(rules, "lab_games")
        views[f"seq_{tag}"] = own["seq"]
        views[f"fold_{tag}"] = own["fold"].replace("FROM fold f JOIN seq s", f"FROM fold_{tag} f JOIN seq_{tag} s")
        parts.append(f"""SELECT '{rules.name}' AS ruleset, pool, rn, game_id, game_date, competition_id, season, home_id, away_id, round(e, 4) AS p, round(diff / {D(rules.points)}, 2) + 0 AS predicted_margin,
  round(abs(margin - round(diff / {D(rules.points)}, 2)), 2) AS margin_error, (e >= 0.5) = (won = 1) AS correct, won = 1 AS home_won, d, h + d AS home_post, a - d AS away_post FROM fold_{tag} WHERE rn > 0""")
    views["tested"] = " UNION ALL ".join(parts)
    views["pred"] = "SELECT * FROM tested WHERE game_date BETWEEN DATE '1997-07-01' AND DATE '1999-12-31'"
    return with_views(sql, recursive=True, **views)


def tested(spark, sf_dir):
    return E.backtest(view(spark, sf_dir, "games"), [MODEL, ADJUSTED], WARM, SCORED)


@query(_lab("SELECT ruleset, pool, game_id, game_date, competition_id, season, home_id, away_id, p, predicted_margin, margin_error, correct, home_won FROM pred"))
def backtest_predictions(spark, sf_dir):
    return E.predictions(tested(spark, sf_dir))


METRICS = """count(*) AS games, count(*) FILTER (correct) AS n_correct, round(avg(correct::INT::DOUBLE) * 100, 1) AS accuracy, round(avg((p - home_won::INT) * (p - home_won::INT)), 4) AS brier,
  round(avg(-ln(least(greatest(CASE WHEN home_won THEN p ELSE 1 - p END, 0.001), 0.999))), 4) AS log_loss, round(avg(margin_error), 2) AS avg_margin_error, round(avg(p) * 100, 1) AS avg_p"""


@query(_lab(f"SELECT ruleset, {METRICS} FROM pred GROUP BY ruleset"))
def backtest_summary(spark, sf_dir):
    p = E.predictions(tested(spark, sf_dir))
    return p.groupBy("ruleset").agg(*E.metrics(p))


@query(_lab(f"SELECT ruleset, strftime(game_date, '%Y-%m') AS month, {METRICS} FROM pred GROUP BY ALL"))
def backtest_months(spark, sf_dir):
    p = E.predictions(tested(spark, sf_dir)).withColumn("month", F.date_format("game_date", "yyyy-MM"))
    return p.groupBy("ruleset", "month").agg(*E.metrics(p))


SEGMENTS = f"""SELECT ruleset, CASE WHEN GROUPING(season) = 0 THEN 'season' WHEN GROUPING(competition_id) = 0 THEN 'competition' WHEN GROUPING(month) = 0 THEN 'month' ELSE 'run' END AS segment_type,
  coalesce(season, competition_id::VARCHAR, month, 'all') AS segment, {METRICS} FROM (SELECT *, strftime(game_date, '%Y-%m') AS month FROM pred)
  GROUP BY GROUPING SETS ((ruleset), (ruleset, season), (ruleset, competition_id), (ruleset, month))"""


@query(_lab(SEGMENTS))
def backtest_breakdown(spark, sf_dir):
    return E.breakdown(E.predictions(tested(spark, sf_dir)))


@query(_lab(f"SELECT m.* EXCLUDE (ruleset), b.accuracy AS base_accuracy, b.brier AS base_brier, b.log_loss AS base_log_loss, round(b.brier - m.brier, 4) AS brier_gain FROM ({SEGMENTS}) m LEFT JOIN ({SEGMENTS}) b ON b.segment_type = m.segment_type AND b.segment = m.segment AND b.ruleset = 'adjusted-v1' WHERE m.ruleset = 'model'"))
def backtest_against_baseline(spark, sf_dir):
    return E.against_baseline(E.breakdown(E.predictions(tested(spark, sf_dir))), "model", "adjusted-v1")


@query(_lab("""SELECT ruleset, pool, team_id, round(sum(change), 2) AS movement, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY ruleset, pool, team_id ORDER BY game_date DESC, game_id DESC) AS rn FROM (
    SELECT ruleset, pool, game_date, game_id, home_id AS team_id, d AS change FROM tested UNION ALL SELECT ruleset, pool, game_date, game_id, away_id, -d FROM tested)) WHERE rn <= 5 GROUP BY ruleset, pool, team_id"""))
def backtest_movement(spark, sf_dir):
    return E.recent_movement(tested(spark, sf_dir))


@query(_lab("SELECT ruleset, game_id, p, margin_error FROM pred WHERE ruleset = 'model' AND NOT correct ORDER BY margin_error DESC, game_id LIMIT 12"))
def backtest_misses(spark, sf_dir):
    p = E.predictions(tested(spark, sf_dir)).filter("ruleset = 'model' and not correct")
    return p.orderBy(F.desc("margin_error"), "game_id").limit(12).select("ruleset", "game_id", "p", "margin_error")


@query(ranked("SELECT pool, team_id, elo, games FROM snapshot ORDER BY elo DESC, pool, team_id LIMIT 10 OFFSET 10"))
def rankings_page_2(spark, sf_dir):
    rows = E.snapshot(history(spark, sf_dir)).select("pool", "team_id", "elo", "games")
    return R.page(rows, [F.desc("elo"), "pool", "team_id"], 2, 10, rows.count())


@query(with_views("""SELECT competition_id, competition_name, pool, CASE WHEN count(*) OVER (PARTITION BY lower(competition_name)) > 1 THEN concat(competition_name, ' (', country, ')') ELSE competition_name END AS label
FROM competitions WHERE pool = 'europe'"""))
def lab_scope(spark, sf_dir):
    competitions = view(spark, sf_dir, "competitions")
    return E.scope(competitions, competitions.filter("pool = 'europe'").select("competition_id"))[1].select("competition_id", "competition_name", "pool", "label")
