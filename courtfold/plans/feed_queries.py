"""Queries over feeds: games written in each shape by the adapter's rows and read back, merged or repaired."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import feeds as S
from ..sources import files as files_
from .adapter import view, with_views
from .registry import query


def _cells(**columns):
    pairs = [F.struct(F.lit(k).alias("k"), F.coalesce(v.cast("string"), F.lit("")).alias("v")) for k, v in columns.items()]
    return F.map_from_entries(F.array(*pairs)).alias("cells")


def _team(column: str):
    return F.concat(F.lit("T"), F.col(column))


@query(with_views("""SELECT substr(sha256(concat_ws('|', game_date::VARCHAR, concat('cup ', competition_id), concat('T', home_id), concat('T', away_id))), 1, 24) AS source_game_id,
  game_date::TIMESTAMP + INTERVAL 18 HOUR AS game_ts, concat('Cup ', competition_id) AS competition, concat('T', home_id) AS home, concat('T', away_id) AS away, home_score::INT AS home_score, away_score::INT AS away_score,
  CASE game_id % 5 WHEN 0 THEN 'postponed' WHEN 1 THEN 'finished' WHEN 2 THEN 'scheduled' WHEN 3 THEN 'cancelled' ELSE CASE WHEN home_score IS NOT NULL THEN 'live' ELSE 'scheduled' END END AS status FROM games"""))
def daily_games(spark, sf_dir):
    """A daily page in local time, two hours before UTC's."""
    g = view(spark, sf_dir, "games")
    word = F.element_at(F.array(*map(F.lit, ("Postp.", "FT", "20:30", "Cancelled", "Q3"))), (F.col("game_id") % 5 + 1).cast("int"))
    rows = g.select(F.col("season").alias("page"), F.lit(0).alias("row_no"), _cells(
        date=F.col("game_date"), time=F.lit("20:00"), competition=F.concat(F.lit("Cup "), "competition_id"), home=_team("home_id"), away=_team("away_id"), home_score=F.col("home_score"),
        away_score=F.col("away_score"), status=word))
    return S.daily_games(rows, "Etc/GMT-2")


@query(with_views("""SELECT source_game_id, concat('T', home_id) AS home, concat('T', away_id) AS away, CASE WHEN game_id % 2 = 0 THEN home_score + 1 ELSE home_score END::INT AS home_score, away_score::INT AS away_score,
  game_date, CAST(game_id % 30 AS INT) AS round_no FROM games"""))
def league_games(spark, sf_dir):
    """A league's nested JSON, half of it delivered again with other scores on a later page."""
    g = view(spark, sf_dir, "games")

    def pages(rows, page_no, more):
        match = F.struct(F.col("source_game_id").alias("id"), F.col("home_id").alias("home"), F.col("away_id").alias("away"), (F.col("home_score") + more).cast("string").alias("home_points"), F.col("away_score").cast("string").alias("away_points"))
        day = F.struct((F.col("game_id") % 30).cast("int").alias("number"), F.col("game_date").cast("string").alias("date"), F.array(match).alias("matches"))
        names = F.array(*[F.struct(F.col(c).alias("id"), _team(c).alias("name")) for c in ("home_id", "away_id")])
        body = F.struct(F.array(F.struct(F.col("season").alias("id"), F.array(day).alias("days"))).alias("championships"), names.alias("teams"))
        return rows.select(F.lit(page_no).alias("page_no"), F.to_json(body).alias("body"))

    return S.league_games(pages(g, 1, 0).unionByName(pages(g.filter("game_id % 2 = 0"), 2, 1)), "page_no")


OFFICIAL = """SELECT source_game_id AS id, CASE WHEN game_id % 7 <> 1 OR game_id % 2 = 0 THEN concat('T', home_id) END AS home_team, concat('T', away_id) AS away_team, home_score::INT AS hs, away_score::INT AS aw, game_date,
  CASE WHEN game_id % 5 = 0 THEN 'not official' WHEN game_id % 7 = 1 AND game_id % 2 <> 0 THEN 'malformed' WHEN home_score IS NULL THEN 'without score' ELSE 'accepted' END AS kind,
  CASE WHEN game_id % 7 = 1 AND game_id % 2 = 0 THEN 'inferred' ELSE 'as given' END AS parser FROM games"""


@query(with_views(OFFICIAL))
def official_matches(spark, sf_dir):
    """Official JSON in which some home teams are missing, half of them named by fixes."""
    g = view(spark, sf_dir, "games")
    home = F.when(F.col("game_id") % 7 != 1, _team("home_id"))
    match = F.struct(F.col("source_game_id").alias("id"), F.when(F.col("game_id") % 5 == 0, "DRAFT").otherwise("OFFICIAL").alias("status"), home.alias("home"), _team("away_id").alias("guest"),
                     F.col("home_score").cast("string").alias("home_score"), F.col("away_score").cast("string").alias("guest_score"), F.col("game_date").cast("string").alias("date"))
    fixes = g.filter("game_id % 7 = 1 and game_id % 2 = 0").select(F.col("source_game_id").alias("id"), _team("home_id").alias("team"))
    return S.official_matches(g.select(F.to_json(F.struct(F.array(match).alias("matches"))).alias("body")), fixes)


@query(with_views("SELECT kind, count(*) AS n FROM official GROUP BY kind", official=OFFICIAL))
def official_counts(spark, sf_dir):
    return official_matches(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


#: Group games by their days, some later ones of the playoffs known: quarter finals by theirs, semifinals half a year on, finals of even seasons a year on.
STAGED = """SELECT game_id, season, CASE game_id % 4 WHEN 0 THEN 'group' WHEN 1 THEN 'quarter' WHEN 2 THEN 'semi' ELSE 'final' END AS stage,
  CASE WHEN game_id % 4 = 0 OR game_id % 16 = 1 THEN game_date WHEN game_id % 8 = 2 THEN game_date + CAST(game_id % 200 AS INT) WHEN game_id % 16 = 3 AND season < '1995-1996' THEN game_date + 400 END AS game_date FROM games"""
#: Ends stage by stage, as a season is read.
ENDS = {
    "sizes": """SELECT season, max(game_date) FILTER (stage = 'group') AS g, max(game_date) FILTER (stage = 'quarter') AS qk, max(game_date) FILTER (stage = 'semi') AS sk, max(game_date) FILTER (stage = 'final') AS fk,
  CAST(count(*) FILTER (stage = 'quarter' AND game_date IS NULL) AS INT) AS qu, CAST(count(*) FILTER (stage = 'semi' AND game_date IS NULL) AS INT) AS su FROM staged GROUP BY season""",
    "quarters": "SELECT *, greatest(g + qu, coalesce(qk, g)) AS q FROM sizes",
    "semis": "SELECT *, greatest(q, coalesce(sk, q)) AS s0, greatest(q, coalesce(sk, q)) + su AS s FROM quarters",
}


@query(with_views("""SELECT game_id, coalesce(game_date, ends + CAST(nth AS INT)) AS game_date FROM (
  SELECT s.game_id, s.game_date, row_number() OVER (PARTITION BY s.season, s.stage ORDER BY s.game_date IS NOT NULL, s.game_id) AS nth,
    CASE s.stage WHEN 'quarter' THEN e.g WHEN 'semi' THEN e.s0 WHEN 'final' THEN greatest(e.s, coalesce(e.fk, e.s)) END AS ends FROM staged s JOIN semis e ON e.season = s.season)""", staged=STAGED, **ENDS))
def filled_dates(spark, sf_dir):
    """Playoff games without dates; known days of their own stages may be later than the stage before."""
    return S.filled_dates(view(spark, sf_dir, "staged", {"staged": STAGED}), "season", ["group", "quarter", "semi", "final"], "game_id", ("quarter",)).select("game_id", "game_date")


@query(with_views("""SELECT season, source_game_id, game_date, home_score FROM (SELECT *, row_number() OVER (PARTITION BY season, lo, hi ORDER BY place, source_game_id) AS rn FROM (
  SELECT season, place, source_game_id, lo, hi, home_score, coalesce(game_date, min(game_date) OVER (PARTITION BY season, lo, hi)) AS game_date FROM (
    SELECT season, 0 AS place, source_game_id, least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi, home_score, CASE WHEN game_id % 3 <> 0 THEN game_date END AS game_date FROM games WHERE game_id % 2 = 0
    UNION ALL SELECT season, 1, concat('x', source_game_id), least(home_id, away_id), greatest(home_id, away_id), home_score, game_date FROM games WHERE game_id % 5 <> 0))) WHERE rn = 1"""))
def merged_sources(spark, sf_dir):
    """Two schedules of which the first lacks dates; teams stand in either order."""
    g = view(spark, sf_dir, "games")
    first = g.filter("game_id % 2 = 0").select("season", "source_game_id", _team("home_id").alias("home"), _team("away_id").alias("away"), "home_score", F.when(F.col("game_id") % 3 != 0, F.col("game_date")).alias("game_date"))
    second = g.filter("game_id % 5 <> 0").select("season", F.concat(F.lit("x"), "source_game_id").alias("source_game_id"), _team("away_id").alias("home"), _team("home_id").alias("away"), "home_score", "game_date")
    return S.merged_sources(first, second, ["season"]).select("season", "source_game_id", "game_date", "home_score")


@query(with_views("""SELECT season, game_date, concat('T', home_id) AS home, concat('T', away_id) AS away, min(home_score) AS home_score,
  substr(sha256(concat_ws('|', season, game_date::VARCHAR, concat('T', home_id), concat('T', away_id))), 1, 24) AS source_game_id FROM games GROUP BY season, game_date, home_id, away_id"""))
def team_pages(spark, sf_dir):
    """Each game on the pages of both its teams, a few only on the away team's."""
    g = view(spark, sf_dir, "games").groupBy("season", "game_date", "home_id", "away_id").agg(F.min("home_score").alias("home_score"), F.min("game_id").alias("game_id"))

    def page(rows, own, other, at_home):
        mine, theirs = ("home_score", "game_id") if at_home else ("game_id", "home_score")
        return rows.select("season", "game_date", _team(own).alias("team"), _team(other).alias("opponent"), F.lit(at_home).alias("at_home"), F.col(mine).alias("own_score"), F.col(theirs).alias("other_score"))

    both = page(g.filter("game_id % 6 <> 0"), "home_id", "away_id", True).unionByName(page(g, "away_id", "home_id", False))
    return S.team_pages(both, "season").select("season", "game_date", "home", "away", "home_score", "source_game_id")


RICH = """SELECT competition_id, season, source_game_id, CAST(game_id % 3 AS INT) AS source_no, game_id % 41 <> 0 OR game_id % 3 > 0 AS resolved, round_name = 'Final' AS knockout FROM games"""


@query(with_views("""SELECT competition_id, season, source_game_id, source_no FROM rich JOIN (
  SELECT competition_id, season, coalesce(max(CASE WHEN source_no = 0 AND n >= 20 AND whole THEN 1 END), 0) = 1 AS good, arg_max(source_no, (n, -source_no)) AS best FROM (
    SELECT competition_id, season, source_no, count(*) AS n, bool_and(resolved) AS whole FROM rich GROUP BY ALL) GROUP BY ALL) USING (competition_id, season)
WHERE (good AND source_no = 0) OR (NOT good AND (source_no = best OR (source_no = 0 AND knockout)))""", rich=RICH))
def best_sources(spark, sf_dir):
    """For each competition's season the main source, or the richest where that is too small or unresolved."""
    k = F.col("game_id")
    rows = view(spark, sf_dir, "games").select(
        "competition_id", "season", "source_game_id", (k % 3).cast("int").alias("source_no"), ((k % 41 != 0) | (k % 3 > 0)).alias("resolved"), (F.col("round_name") == "Final").alias("knockout"))
    return S.best_source(rows, ["competition_id", "season"], 20).select("competition_id", "season", "source_game_id", "source_no")


@query(with_views("""SELECT source_game_id, CASE WHEN round_name = 'Final' THEN 'Finals' ELSE 'Opening' END AS competition, CASE WHEN home_score IS NULL THEN 'score_pending' ELSE 'finished' END AS status,
  home_score IS NOT NULL AS eligible, CASE WHEN home_score IS NULL THEN 'no score in the archive' END AS exclusion_reason, game_id % 2 = 0 AS late FROM games WHERE round_name IN ('Final', 'Round 1')"""))
def staged_games(spark, sf_dir):
    """An archive's pages by stage, half of the rows given twice."""
    g = view(spark, sf_dir, "games").select("source_game_id", F.upper("round_name").alias("stage"), "home_score", "away_score", F.lit(1).alias("row_no"), F.lit(False).alias("late"), "game_id")
    again = g.filter("game_id % 2 = 0").withColumns({"row_no": F.lit(2), "late": F.lit(True)})
    return S.staged_games(g.unionByName(again), {"final": "Finals", "round 1": "Opening"}, "row_no").select("source_game_id", "competition", "status", "eligible", "exclusion_reason", "late")


ROUTES = [("archive", "a", 1990, 1999), ("api", "a", 1999, 2010), ("archive", "b", 1995, 1996), ("feed", "b", 1997, 2001), ("feed", "b", 2000, 2003)]
ROUTES_SQL = f"SELECT * FROM (VALUES {', '.join(map(str, ROUTES))}) r(provider, league, first, last)"


@query(f"""SELECT league, concat(y, '-', y + 1) AS season, CASE WHEN count(DISTINCT provider) = 1 THEN min(provider) END AS provider, count(DISTINCT provider) AS n FROM (
  SELECT provider, league, unnest(generate_series(first, last)) AS y FROM ({ROUTES_SQL})) GROUP BY league, y""")
def routed_seasons(spark, sf_dir):
    """Seasons with their provider; one that several claim has none."""
    one, many = S.routed_seasons(spark.createDataFrame(ROUTES, "provider string, league string, first int, last int"))
    return one.withColumn("n", F.lit(1).cast("long")).unionByName(many.withColumn("provider", F.lit(None).cast("string")).select("league", "season", "provider", F.col("n").cast("long")))


NAMES = ["FIBA EuroBasket", "eurobasket qualifiers ", "AfroBasket", "Summer Olympics", "Friendly"]
REGIONS = ["Europe", "europe", "Africa", "World", "Europe"]
KEYS = ["eurobasket", "eurobasket", "afrobasket", "olympics", None]


@query(with_views(f"""SELECT game_id, CASE game_id % 5 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KEYS) if k)} END || '-' || season AS cycle FROM games"""))
def cycle_keys(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("game_id") % 5 + 1).cast("int"))
    return view(spark, sf_dir, "games").select("game_id", T.cycle_key(pick(REGIONS), pick(NAMES), F.col("season")).alias("cycle"))


@query(with_views("""SELECT game_id, CASE game_id % 6 WHEN 0 THEN 'Euroleague' WHEN 1 THEN 'ACB' WHEN 2 THEN 'LNB' WHEN 3 THEN 'Greek Cup' WHEN 4 THEN 'NBA' END AS competition FROM games"""))
def named_competitions(spark, sf_dir):
    names = ("Turkish Airlines EuroLeague - Playoffs", "Liga ENDESA", "Betclic Elite", "greek cup group stage", "NBA", "Chess Open")
    return view(spark, sf_dir, "games").select("game_id", T.competition_of(F.element_at(F.array(*map(F.lit, names)), (F.col("game_id") % 6 + 1).cast("int"))).alias("competition"))


@query(with_views("""SELECT game_id, CASE WHEN home_id % 6 = 0 THEN 'non_franchise' WHEN season < '1994' THEN 'season_not_reviewed' WHEN month(game_date) < 3 THEN 'before_opener' END AS reason FROM games"""))
def excluded_games(spark, sf_dir):
    opener = F.make_date(F.year("game_date"), F.lit(3), F.lit(1))
    reason = T.exclusion_reason(F.col("home_id") % 6 != 0, F.col("season") >= "1994", F.col("game_date"), opener)
    return view(spark, sf_dir, "games").select("game_id", reason.alias("reason"))


@query("""SELECT o_orderkey AS id, o_orderdate + INTERVAL 5 HOUR AS utc, o_orderdate::DATE + CAST(o_orderkey % 9 // 2 AS INT) AS middle FROM orders""")
def repaired_times(spark, sf_dir):
    """Local times as UTC, and dates halfway between two."""
    o, day = view(spark, sf_dir, "orders"), F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("id"), T.to_utc(F.col("o_orderdate"), "Etc/GMT+5").alias("utc"), T.midpoint(day, F.date_add(day, (F.col("o_orderkey") % 9).cast("int"))).alias("middle"))


@query("""SELECT n_nationkey AS id, replace(n_name, 'A', 'A') AS plain, lower(n_name) || 'zh' AS latin FROM nation""")
def plain_letters(spark, sf_dir):
    """Names with marks, and in Serbian letters, brought to plain Latin ones."""
    marked = F.replace(F.col("n_name"), F.lit("A"), F.lit("Ă"))
    return view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), T.without_marks(marked).alias("plain"), T.transliterated(F.concat(F.col("n_name"), F.lit("З"), F.lit("h")), T.SERBIAN).alias("latin"))


@query(with_views("SELECT game_id, game_date, home_score::INT AS home_score, away_score::INT AS away_score FROM games WHERE game_id % 4 <> 0"))
def archive_games(spark, sf_dir):
    """An archive of which copies and another league's rows don't count, and the last of two rows of an id does."""
    g = view(spark, sf_dir, "games")
    rows = g.select(F.col("game_id").cast("string").alias("game_id"), F.when(F.col("game_id") % 8 == 0, "ABA").otherwise("NBA").alias("lg_id"), F.when(F.col("game_id") % 8 == 4, "1").otherwise("0").alias("_iscopy"),
                    F.date_format("game_date", "M/d/yyyy").alias("date_game"), F.year("game_date").cast("string").alias("year_id"), _team("home_id").alias("fran_id"), _team("away_id").alias("opp_fran"),
                    F.col("home_score").cast("string").alias("pts"), F.col("away_score").cast("string").alias("opp_pts"), F.lit(2).alias("line"))
    one = files_.last_row_wins(rows.unionByName(rows.withColumns({"line": F.lit(1), "pts": F.lit("0")})), "game_id", "line")
    return files_.archive_games(one).select(F.col("game_id").cast("long").alias("game_id"), "game_date", "home_score", "away_score")


#: Leagues of eight to ten customers, an odd one among them, and every game between two of them; one league lacks a game.
MATRICES = {
    "sides": "SELECT CAST(floor(c_custkey / 10) AS BIGINT) AS page_no, c_custkey AS team_no FROM customer WHERE floor(c_custkey / 10) % 2 = 0 OR c_custkey % 10 < 8",
    "pages_of": """SELECT concat('p', page_no) AS page, CAST(1950 + page_no % 40 AS INT) AS start_year, concat('T', 1000000 + team_no * 7 % 1000) AS team, CAST(row_number() OVER (PARTITION BY page_no ORDER BY team_no) - 1 AS INT) AS row_no FROM sides""",
    "grids": """SELECT h.page, h.start_year, h.row_no AS home_no, a.row_no AS away_no, h.team AS home, a.team AS away, CAST(60 + (h.row_no * 7 + a.row_no) % 30 AS INT) AS home_score, 50 AS away_score
FROM pages_of h JOIN pages_of a ON a.page = h.page AND a.row_no <> h.row_no WHERE NOT (h.page = 'p7' AND h.row_no = 0 AND a.row_no = 1)""",
}


@query(with_views("""SELECT page, home, away, home_score, away_score, round_no, anchor + offs AS game_date FROM (
  SELECT *, anchor_day - CAST((dayofweek(anchor_day) + 1) % 7 AS INT) AS anchor, [0, 6, 13, 18, 21, 28, 28, 36, 56, 63][least(round_no, 10)] AS offs FROM (
    SELECT g.*, make_date(start_year, 9, 30) AS anchor_day, CAST(1 + CASE WHEN lo = 0 THEN (2 * n - 2 - hi) % (n - 1) ELSE ((4 * n - 4 - lo - hi) * (n // 2)) % (n - 1) END + CASE WHEN home > away THEN n - 1 ELSE 0 END AS INT) AS round_no FROM (
      SELECT g.*, least(home_no, away_no) AS lo, greatest(home_no, away_no) AS hi, c.n FROM grids g JOIN (SELECT page, count(*) AS n FROM pages_of GROUP BY page) c ON c.page = g.page
      JOIN (SELECT page, count(*) AS got FROM grids GROUP BY page) k ON k.page = g.page AND k.got = c.n * (c.n - 1) WHERE c.n % 2 = 0) g))""", **MATRICES))
def scheduled_matrices(spark, sf_dir):
    """Rounds and days of full matrices; odd and incomplete ones give nothing."""
    teams, grids = (view(spark, sf_dir, n, MATRICES) for n in ("pages_of", "grids"))
    return files_.scheduled(grids, teams, [0, 6, 13, 18, 21, 28, 28, 36, 56, 63]).select("page", "home", "away", "home_score", "away_score", "round_no", "game_date")
