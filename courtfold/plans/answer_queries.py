"""Queries over newspaper text and composed answers: the games browser, team detail, coverage by eras."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.text import SERBIAN
from ..operators import answers as A
from ..operators import rankings as R
from ..operators import rating as E
from ..sources import newspaper as N
from .adapter import piece_of, view, with_views
from .game_queries import COVERAGE_VIEWS, DAY, TODAY, _covered
from .rating_queries import CURRENT, history, ranked
from .registry import query

#: Clubs with names that are far from each other, and an article for each season of a competition: results as they are, without dash, with a letter lost or changed, two on a
#: line, columns of a table, an unknown team, prose; every eleventh printed twice, rounds and days only above some.
PAPER = {
    "letters": "SELECT team_id, translate(substr(md5(team_name), 1, 9), '0123456789abcdef', 'AEIOUBDGKLMNPRST') AS x FROM teams",
    "clubs": "SELECT team_id, CASE WHEN team_id % 2 = 0 THEN concat(substr(x, 1, 4), ' ', substr(x, 5, 5)) ELSE x END AS name FROM letters",
    "printed": """SELECT game_id, competition_id, season, game_date, home_id, away_id, home_score AS hs, away_score AS aw, h.name AS h, a.name AS a FROM games
JOIN clubs h ON h.team_id = home_id JOIN clubs a ON a.team_id = away_id WHERE home_score IS NOT NULL AND away_score IS NOT NULL""",
    "pieces": """SELECT game_id, competition_id, season, concat(CASE WHEN game_id % 3 = 0 THEN concat(game_id % 34 + 1, '. kolo', chr(10)) ELSE '' END,
  CASE WHEN game_id % 5 = 0 THEN concat(day(game_date), '.', month(game_date), '. ', year(game_date), chr(10)) ELSE '' END) AS above, CASE game_id % 8
  WHEN 0 THEN concat(h, '-', a, ' ', hs, ':', aw) WHEN 1 THEN concat('KK ', lower(h), '  ', a, '   ', hs, ' : ', aw, ' (40)') WHEN 2 THEN concat(substr(h, 1, 2), substr(h, 4), ' – ', a, ' ', hs, ':', aw)
  WHEN 3 THEN concat(h, ' - ', substr(a, 1, length(a) - 1), 'X ', hs, '-', aw) WHEN 4 THEN concat(h, ' - ', a, ' ', hs, ':', aw, ', ', a, ' - ', h, ' ', aw, ':', hs, '.')
  WHEN 5 THEN concat(h, ' - ', a, ' 14:70') WHEN 6 THEN concat('Olimpija Qqqq - ', a, ' ', hs, ':', aw) ELSE concat(h, ' won against ', a) END AS line FROM printed""",
}
JUDGED = """SELECT page, nth, round_name, game_date, home_id, away_id, home_score, away_score, coalesce(reason, CASE WHEN row_number() OVER (
  PARTITION BY game_date, home_id, away_id, home_score, away_score, reason ORDER BY page, game_id, k, nth) > 1 THEN 'repeated' END) AS reason FROM (
  SELECT concat(competition_id, ' ', season) AS page, game_id, k, CASE WHEN game_id % 8 = 7 THEN NULL ELSE nth END AS nth,
    CAST(last_value(CASE WHEN game_id % 3 = 0 THEN game_id % 34 + 1 END IGNORE NULLS) OVER w AS VARCHAR) AS round_name,
    coalesce(last_value(CASE WHEN game_id % 5 = 0 THEN game_date END IGNORE NULLS) OVER w, CAST(concat(substr(season, 1, 4), '-09-01') AS DATE)) AS game_date,
    CASE WHEN game_id % 8 > 4 THEN NULL WHEN nth = 0 THEN home_id ELSE away_id END AS home_id, CASE WHEN game_id % 8 > 4 THEN NULL WHEN nth = 0 THEN away_id ELSE home_id END AS away_id,
    (CASE WHEN game_id % 8 = 7 THEN NULL WHEN game_id % 8 = 5 THEN 14 WHEN nth = 0 THEN hs ELSE aw END)::INT AS home_score, (CASE WHEN game_id % 8 = 7 THEN NULL WHEN game_id % 8 = 5 THEN 70 WHEN nth = 0 THEN aw ELSE hs END)::INT AS away_score,
    CASE game_id % 8 WHEN 5 THEN 'score out of range' WHEN 6 THEN 'fewer than two teams' WHEN 7 THEN 'no score' END AS reason
  FROM printed, (VALUES (0), (1)) n(nth), (VALUES (0), (1)) t(k) WHERE (nth = 0 OR game_id % 8 = 4) AND (k = 0 OR game_id % 11 = 0) WINDOW w AS (PARTITION BY competition_id, season ORDER BY game_id))"""


@query(with_views(JUDGED, **PAPER))
def newspaper_results(spark, sf_dir):
    line = F.concat("above", "line", F.when(F.col("game_id") % 11 == 0, F.concat(F.lit("\n"), "line")).otherwise(""))
    own = view(spark, sf_dir, "pieces", PAPER).groupBy("competition_id", "season", piece_of("game_id")).agg(F.array_sort(F.collect_list(F.struct("game_id", line.alias("line")))).alias("p"))
    articles = own.select(F.concat_ws(" ", F.col("competition_id").cast("string"), "season").alias("page"), "piece", F.to_date(F.concat(F.substring("season", 1, 4), F.lit("-09-01"))).alias("published"), F.array_join(F.col("p.line"), "\n").alias("text"))
    return N.newspaper_results(articles, view(spark, sf_dir, "clubs", PAPER), SERBIAN).drop("piece", "line_no")


#: Games of which those that aren't eligible have a reason, or a blank one.
REASONED = {"reasoned": "SELECT *, CASE WHEN NOT eligible THEN CASE WHEN game_id % 2 = 0 THEN concat('source ', source) ELSE ' ' END END AS exclusion_reason FROM games"}
BROWSED = f"""SELECT game_id, game_date, season, source, status, home_id, away_id, league, l.country, h.team_name AS home_team, a.team_name AS away_team, home_score, away_score, concat_ws('; ',
  CASE WHEN NOT eligible THEN concat('Excluded from ELO', CASE WHEN game_id % 2 = 0 THEN concat(': source ', source) ELSE '' END) END,
  CASE WHEN status = 'finished' AND (home_score IS NULL OR away_score IS NULL) THEN 'Finished game is missing a score' END,
  CASE WHEN status <> 'finished' AND game_date < {DAY} - 2 THEN 'Game date is more than two days old but status is not finished' END) AS reasons
FROM reasoned JOIN (SELECT competition_id, competition_name AS league, country FROM competitions) l USING (competition_id) JOIN teams h ON h.team_id = home_id JOIN teams a ON a.team_id = away_id"""
FOUND = """SELECT * FROM browsed WHERE country IN ('EUROPE', 'AFRICA', 'ASIA') AND source = 'src1' AND game_date >= DATE '1995-01-01' AND game_date <= DATE '2001-06-30'
  AND (home_team ILIKE '%n_1%' OR away_team ILIKE '%n_1%' OR league ILIKE '%n_1%' OR season ILIKE '%n_1%' OR status ILIKE '%n_1%')"""
BROWSE = REASONED | {"browsed": BROWSED, "found": FOUND}


def _named(spark, sf_dir):
    return A.named_games(view(spark, sf_dir, "reasoned", REASONED), view(spark, sf_dir, "teams"), view(spark, sf_dir, "competitions"), F.lit(TODAY))


def _found(spark, sf_dir):
    named = _named(spark, sf_dir).filter(F.col("country").isin("EUROPE", "AFRICA", "ASIA"))
    return A.browse(named, source="src1", search="n_1", first=date(1995, 1, 1), last=date(2001, 6, 30))


SHOWN = ["game_id", "game_date", "league", "country", "season", "home_team", "away_team", "home_score", "away_score", "status", "reasons"]


@query(with_views(f"SELECT {', '.join(SHOWN)} FROM found", **BROWSE))
def games_answer(spark, sf_dir):
    return _found(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "; ")).select(*SHOWN)


@query(with_views(f"""SELECT {', '.join(SHOWN)} FROM browsed WHERE season ILIKE '%95-1%' OR status ILIKE '%95-1%' OR league ILIKE '%95-1%' OR home_team ILIKE '%95-1%' OR away_team ILIKE '%95-1%'
  ORDER BY game_date DESC, game_id DESC LIMIT 25 OFFSET 25""", **BROWSE))
def games_answer_page_2(spark, sf_dir):
    rows = A.browse(_named(spark, sf_dir), search="95-1").withColumn("reasons", F.array_join("reasons", "; "))
    return R.page(rows.select(*SHOWN), [F.desc("game_date"), F.desc("game_id")], 2, 25, rows.count())


@query(with_views("""SELECT (SELECT count(*) FROM browsed) AS n_all, count(*) AS n_kept, count(*) FILTER (status = 'finished') AS n_finished, count(*) FILTER (status <> 'finished') AS n_open,
  count(*) FILTER (reasons <> '') AS n_review, min(game_date) AS first_date, max(game_date) AS last_date FROM found""", **BROWSE))
def games_answer_summary(spark, sf_dir):
    return A.browse_summary(_named(spark, sf_dir), _found(spark, sf_dir))


@query(with_views(" UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS value, count(*) AS n FROM browsed GROUP BY {v}" for k, v in
                  {"country": "country", "league": "league", "season": "season", "source": "source", "status": "status", "year": "year(game_date)::VARCHAR"}.items()), **BROWSE))
def games_answer_options(spark, sf_dir):
    return A.browse_options(_named(spark, sf_dir))


FORM = """SELECT pool, team_id, concat_ws('-', count(*) FILTER (actual = 1), count(*) FILTER (actual <> 1)) AS form_{n}, round(sum(change), 2) AS change_{n} FROM (
  SELECT *, row_number() OVER (PARTITION BY pool, team_id ORDER BY game_date DESC, game_id DESC) AS rn FROM history) WHERE rn <= {n} GROUP BY pool, team_id"""


@query(ranked(f"""SELECT s.pool, s.team_id, t.team_name, t.country, s.elo, s.games, 1 + (SELECT count(*) FROM snapshot o JOIN current c ON c.pool = o.pool AND c.team_id = o.team_id WHERE o.pool = s.pool AND o.elo > s.elo) AS rank,
  l.latest_change, l.last_day, EXISTS (SELECT 1 FROM current c WHERE c.pool = s.pool AND c.team_id = s.team_id) AS is_current, l.leagues, f.form_5, f.change_5, e.form_10, e.change_10
FROM snapshot s JOIN teams t ON t.team_id = s.team_id JOIN (
  SELECT x.pool, x.team_id, round(arg_max(x.change, (x.game_date, x.game_id)), 2) AS latest_change, max(x.game_date) AS last_day, array_to_string(list_sort(list_distinct(list(competition_name))), ', ') AS leagues
  FROM history x JOIN (SELECT pool, game_id, competition_name FROM games JOIN (SELECT competition_id, competition_name FROM competitions) USING (competition_id)) g ON g.pool = x.pool AND g.game_id = x.game_id GROUP BY x.pool, x.team_id) l ON l.pool = s.pool AND l.team_id = s.team_id
JOIN ({FORM.format(n=5)}) f ON f.pool = s.pool AND f.team_id = s.team_id JOIN ({FORM.format(n=10)}) e ON e.pool = s.pool AND e.team_id = s.team_id""", current=CURRENT))
def team_detail(spark, sf_dir):
    h = history(spark, sf_dir)
    games, teams, competitions = (view(spark, sf_dir, n) for n in ("games", "teams", "competitions"))
    return A.team_detail(h, E.snapshot(h), games, teams, competitions, R.current_teams(games, teams, ["nation_2"])).drop("ruleset")


#: Seasons four years apart from 1945 on, for the leagues that go by eras.
ERA_SEASON = "CASE WHEN competition_id IN (1, 4) THEN concat(1945 + (substr(season, 1, 4)::INT - 1994) * 4, '-', 1946 + (substr(season, 1, 4)::INT - 1994) * 4) ELSE season END"
LEAST = "CASE substr(season, 1, 4) WHEN '1949' THEN 540 WHEN '1953' THEN 280 WHEN '1957' THEN 280 WHEN '1961' THEN 340 WHEN '1965' THEN 340 WHEN '1969' THEN 420 WHEN '1973' THEN 420 WHEN '1977' THEN 850 ELSE 0 END"


@query(with_views(f"SELECT competition_id, season, n, CASE WHEN competition_id IN (1, 4) THEN n < {LEAST} ELSE low END AS low FROM (SELECT * REPLACE ({ERA_SEASON} AS season) FROM covered)", **COVERAGE_VIEWS))
def coverage_by_era(spark, sf_dir):
    by_era = F.col("competition_id").isin(1, 4)
    y = F.lit(1945) + (F.substring("season", 1, 4).cast("int") - 1994) * 4
    rows = _covered(spark, sf_dir).withColumn("season", F.when(by_era, F.concat_ws("-", y, y + 1)).otherwise(F.col("season")))
    return A.low_by_era(rows, by_era).select("competition_id", "season", "n", "low")
