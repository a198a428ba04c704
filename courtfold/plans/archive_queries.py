"""Queries over archives of linked pages: games of the editions, what is missing of them, official events with written data and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archive as S
from ..sources import files
from .adapter import PAGES, dealt, piece_of, view, with_views, written
from .registry import query

#: Games on an archive's pages: finals by week, the others by page, some cards once more on a later page with another score, some without score or team.
PLACED = {
    "placed": """SELECT game_id, competition_id, CAST(substr(season, 1, 4) AS INT) AS edition, game_date, home_id, away_id, home_score, away_score, round_name = 'Final' AS is_final,
  CASE WHEN round_name = 'Final' THEN CASE WHEN game_id % 3 = 1 THEN 'stage' ELSE 'week' END WHEN game_id % 4 = 1 THEN 'stage' ELSE 'page' END AS kind,
  CAST(CASE WHEN round_name = 'Final' THEN CASE WHEN game_id % 3 = 1 THEN 0 ELSE game_id % 3 + 1 END WHEN game_id % 4 = 1 THEN 0 ELSE game_id % 4 END AS INT) AS number,
  concat('cup-', competition_id, '/') AS slug FROM games""",
    "located": """SELECT *, concat(competition_id * 100000 + edition * 10, CASE WHEN is_final THEN '1' ELSE '0' END) AS round_id,
  concat('/competition/basketball/cup-', competition_id, '-', edition, '-town/', CASE WHEN is_final THEN 'final/' ELSE 'group-stage/' END, competition_id * 100000 + edition * 10, CASE WHEN is_final THEN '1' ELSE '0' END, '/') AS path,
  NOT (kind = 'page' AND number = 3 AND competition_id = 2 AND edition % 2 = 0) AND NOT (is_final AND kind = 'week' AND number = 3 AND competition_id = 1) AS fetched,
  NOT (is_final AND competition_id = 3 AND edition = 1996) AS kept, NOT (competition_id = 4 AND edition = 1995) AS listed FROM placed""",
}
#: A game's last card is the one on page 2 for those of page 0 that are printed twice.
TWICE = "game_id % 4 = 0 AND game_id % 7 = 0 AND NOT is_final"


def _card(more):
    """HTML of one card; `more` is added to the home score."""
    team = lambda side: F.concat(F.lit('<div class="gsa-c-match-c'), F.lit("2" if side == "home" else "4"), F.lit('" onClick="gotoUrl('), f"{side}_id", F.lit(", 'x')\"><span class=\"gsa-c-team_full\">Tom &amp; "), f"{side}_id", F.lit('</span><span class="gsa-c-team_tla">abc</span></div>'))
    score = F.when(F.col("home_score").isNull() | F.col("away_score").isNull(), "- : -").otherwise(F.concat(F.col("home_score") + more, F.lit(" : "), "away_score"))
    away = F.when(F.col("game_id") % 29 == 0, F.lit('<div class="gsa-c-match-c4"></div>')).otherwise(team("away"))
    return F.concat(F.lit('<a href="/match/basketball/'), F.col("game_date").cast("string"), F.lit("/a-b/"), "game_id", F.lit('/"><div class="gsa-c-match-c1">'),
                    F.when(F.col("game_id") % 13 == 0, "soon").otherwise("8:30"), F.lit("</div>"), team("home"), F.lit('<div class="gsa-c-match-c3"> '), score, F.lit(" </div>"), away, F.lit("</a>\n"))


def _archive(spark, sf_dir):
    g = view(spark, sf_dir, "located", PLACED)
    one = g.withColumn("card", _card(F.lit(0)))
    again = g.filter(TWICE).withColumns({"card": _card(F.lit(100)), "number": F.lit(2), "kind": F.lit("page")})
    keys = ["competition_id", "edition", "path", "round_id", "is_final", "kept", "listed", "kind", "number"]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("game_id", "card"))), lambda x: x["card"]), "").alias("cards")
    made = one.filter("fetched").unionByName(again).groupBy(*keys, piece_of("game_id")).agg(body)
    parts = made.filter("kind <> 'stage'").select("round_id", "kind", "number", "piece", F.col("cards").alias("body"))
    control = F.when(F.col("is_final"), '<input id="maxweek" value="3"><input id="curweek" value="2">').otherwise('<i onclick="changePage(1, 4)"></i><input id="cur_page" value="1">')
    finals = g.filter("is_final").groupBy("competition_id", "edition").agg(F.max("path").alias("final_path"))
    own = g.select("competition_id", "edition", "path", "is_final", "kept").distinct().join(finals, ["competition_id", "edition"], "left")
    onward = F.when(~F.col("is_final") & F.col("final_path").isNotNull(), F.concat(F.lit("<a class='x' href='https://a.example"), "final_path", F.lit("'>Final</a>"))).otherwise("")
    pages = own.filter("kept").select("path", F.lit(-1).cast("long").alias("piece"), F.concat(control, onward).alias("body"))
    pages = pages.unionByName(made.filter("kept and kind = 'stage'").select("path", "piece", F.col("cards").alias("body")))
    links = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<a href="'), "path", F.lit('">Cup</a>')))), "")
    seeds = own.filter("not is_final").filter("not (competition_id = 4 and edition = 1995)").groupBy(F.concat(F.lit("/seed/"), "competition_id").alias("path"), F.lit(0).cast("long").alias("piece")).agg(links.alias("body"))
    league = F.concat(F.lit("cup "), "competition_id").alias("league")
    editions = g.select("competition_id", "edition").distinct()
    wanted = editions.select(league, "edition", F.concat(F.lit("/seed/"), "competition_id").alias("seed")).unionByName(
        editions.select(league, F.lit(2050).alias("edition"), F.when(F.col("competition_id") > 1, F.lit("/seed/none")).alias("seed")).distinct())
    null = F.lit(None).cast("string")
    slugs = editions.select(league, F.concat(F.lit("cup-"), "competition_id").alias("slug"), F.when(F.col("competition_id") == 0, "group").alias("keep"), null.alias("leave")).distinct()
    saved = lambda name, rows: written(spark, sf_dir, name, lambda: rows, **PAGES)
    return S.read_editions(wanted, slugs, saved("archive pages", pages.unionByName(seeds)), saved("archive parts", parts))


REACHED = "listed AND NOT (competition_id = 0 AND is_final) AND kept"
SHOWN = f"""SELECT concat('cup ', competition_id) AS league, edition, concat('gsa-', game_id) AS source_game_id, home_score IS NULL OR away_score IS NULL AS pending, is_final, game_id, game_date, home_id, away_id, away_score,
  home_score + CASE WHEN {TWICE} THEN 100 ELSE 0 END AS home_score FROM located WHERE {REACHED} AND (fetched OR ({TWICE})) AND game_id % 29 <> 0"""


@query(with_views("""SELECT league, edition, source_game_id, CASE WHEN game_id % 13 = 0 THEN game_date::TIMESTAMP ELSE game_date + INTERVAL 510 MINUTE END AS game_ts, CASE WHEN pending THEN 'score_pending' ELSE 'finished' END AS status,
  CASE WHEN pending THEN 'source_missing_final_score' END AS exclusion_reason, CASE WHEN is_final THEN 'Final Phase' ELSE 'Group Stage' END AS phase, CASE WHEN is_final THEN 'Final' ELSE 'Group Stage' END AS round_name,
  concat('GSA-', home_id) AS home_source_id, concat('Tom & ', home_id) AS home_team, 'ABC' AS home_country, CASE WHEN NOT pending THEN home_score END::INT AS home_score,
  concat('GSA-', away_id) AS away_source_id, concat('Tom & ', away_id) AS away_team, 'ABC' AS away_country, CASE WHEN NOT pending THEN away_score END::INT AS away_score FROM shown""", **PLACED, shown=SHOWN))
def archive_editions(spark, sf_dir):
    """Editions found from one page for each cup, read by stage, page and week; a card that comes again on a later page counts there."""
    return _archive(spark, sf_dir)[0]


@query(with_views(f"""SELECT league, edition, path, kind, number, reason FROM (
  SELECT DISTINCT concat('cup ', competition_id) AS league, edition, path, 'stage' AS kind, 0 AS number, 'not on disk' AS reason FROM located WHERE listed AND NOT kept
  UNION ALL SELECT DISTINCT concat('cup ', competition_id), edition, concat('/seed/', competition_id), 'edition', 0, 'no stage is linked' FROM located WHERE NOT listed
  UNION ALL SELECT DISTINCT concat('cup ', competition_id), 2050, CASE WHEN competition_id > 1 THEN '/seed/none' END, 'edition', 0, CASE WHEN competition_id > 1 THEN 'not on disk' ELSE 'no page is known' END FROM located
  UNION ALL SELECT concat('cup ', s.competition_id), s.edition, s.path, n.kind, n.number, 'not on disk' FROM (SELECT DISTINCT competition_id, edition, path, is_final FROM located WHERE {REACHED}) s
    JOIN (VALUES (false, 'page', 0), (false, 'page', 2), (false, 'page', 3), (true, 'week', 1), (true, 'week', 3)) n(f, kind, number) ON n.f = s.is_final
    WHERE NOT EXISTS (SELECT 1 FROM located g WHERE g.path = s.path AND ((g.fetched AND g.kind = n.kind AND g.number = n.number) OR (n.kind = 'page' AND n.number = 2 AND {TWICE.replace("game_id", "g.game_id").replace("is_final", "g.is_final")})))
  UNION ALL SELECT concat('cup ', competition_id), edition, concat('/match/basketball/', game_date::VARCHAR, '/a-b/', game_id, '/'), 'card', game_id::INT,
    CASE WHEN game_id % 29 = 0 THEN 'a team is missing' WHEN home_score IS NULL OR away_score IS NULL THEN 'no final score' ELSE 'unknown time' END
    FROM (SELECT * FROM located WHERE {REACHED} AND fetched UNION ALL SELECT * FROM located WHERE {REACHED} AND {TWICE}) WHERE game_id % 29 = 0 OR game_id % 13 = 0 OR home_score IS NULL OR away_score IS NULL)""", **PLACED))
def archive_gaps(spark, sf_dir):
    """Editions without page or stages, stages, pages and weeks that aren't on disk, cards that can't be read in full."""
    return _archive(spark, sf_dir)[1]


#: Official events: the years of a league's rows in its history, an event's games as data in the page, as cards, or both.
EVENTS = {"events_of": """SELECT game_id, competition_id, CAST(substr(season, 1, 4) AS INT) AS edition, game_date, home_id, away_id, coalesce(home_score, 0) AS hs, coalesce(away_score, 0) AS aw,
  concat('/en/history/', competition_id, '-cup/', substr(season, 1, 4)) AS path FROM games WHERE home_score IS NULL OR away_score IS NOT NULL"""}


@query(with_views("SELECT DISTINCT concat(competition_id, '-cup') AS family, edition, path FROM events_of WHERE edition % 3 > 0 UNION ALL SELECT DISTINCT concat(competition_id, '-cup'), edition, concat('/en/events/cup-', edition) FROM events_of WHERE edition % 3 = 0", **EVENTS))
def official_editions(spark, sf_dir):
    """Rows of a history, with links to editions and events, to other families and to teams."""
    e = view(spark, sf_dir, "events_of", EVENTS).select("competition_id", "edition", "path").distinct()
    link = F.when(F.col("edition") % 3 == 0, F.concat(F.lit("https://www.a.example/en/events/cup-"), "edition")).otherwise(F.concat("path", F.lit("/games?x=1")))
    row = F.concat(F.lit("<tr class=x><td>"), "edition", F.lit("</td><td><a href='"), link, F.lit("'>Cup</a> <a href='/en/history/99-other/5'>x</a><a href='/en/teams/7'>y</a></td></tr>\n"))
    return S.official_editions(e.groupBy(F.concat("competition_id", F.lit("-cup")).alias("family")).agg(F.array_join(F.collect_list(row), "").alias("body")))


def _events(spark, sf_dir):
    g = dealt(view(spark, sf_dir, "events_of", EVENTS).withColumn("piece", piece_of("game_id")), "path", "piece")
    open_ = F.col("hs") + F.col("aw") == 0
    score = lambda c: F.when(open_ & (F.col("game_id") % 2 == 0), "null").otherwise(F.col(c).cast("string"))
    team = lambda k, s: F.concat(F.lit(f'"team{k}":{{"teamId":'), f"{s}_id", F.lit(',"code":'), F.when(F.col(f"{s}_id") % 5 == 0, "null").otherwise(F.concat(F.lit('"C'), f"{s}_id", F.lit('"'))), F.lit(',"shortName":"Club '), f"{s}_id", F.lit('"},'))
    data = F.concat(F.lit('{"gameId":'), "game_id", F.lit(',"gameDateTimeUTC":"'), F.col("game_date").cast("string"), F.lit('T18:00:00Z",'), team("A", "home"), team("B", "away"), F.lit('"teamAScore":'), score("hs"), F.lit(',"teamBScore":'), score("aw"),
                    F.lit(',"round":{"id":1,"roundCode":"R'), F.col("game_id") % 3, F.lit('","roundName":"Round '), F.col("game_id") % 3, F.lit('"}}'))
    code = lambda s: F.when(F.col("game_id") % 31 == 0, "TBD").otherwise(F.concat(F.lit("c"), f"{s}_id"))
    card = F.concat(F.lit("<h3>"), F.date_format("game_date", "d MMMM yyyy"), F.lit("</h3><div class='y' data-testid='ui-game-card'><a href='"), "path", F.lit("/games/"), "game_id", F.lit("-"), code("home"), F.lit("-"), code("away"),
                    F.lit("'><b>A</b> "), "hs", F.lit(" <b>B</b> "), "aw", F.lit("</a></div>"))
    k = F.col("game_id") % 3
    text = lambda when, what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("game_id", what.alias("x"))))), lambda r: r["x"]), "")
    pages = g.groupBy("path", "piece").agg(F.concat(text(k != 1, card), F.lit("<script>"), F.replace(text(k > 0, data), F.lit('"'), F.lit('\\"')), F.lit("</script>")).alias("body"))
    return S.official_games(pages)


CODE = "CASE WHEN game_id % 3 = 0 THEN concat('C', {0}) WHEN {0} % 5 = 0 THEN concat('FIBA:', {0}) ELSE concat('C', {0}) END"


@query(with_views(f"""SELECT path, game_id::VARCHAR AS source_game_id, CASE WHEN game_id % 3 > 0 THEN game_date + INTERVAL 18 HOUR ELSE game_date::TIMESTAMP END AS game_ts, CASE WHEN hs = 0 AND aw = 0 THEN 'scheduled' ELSE 'final' END AS status,
  {CODE.format("home_id")} AS home_code, {CODE.format("away_id")} AS away_code, CASE WHEN game_id % 3 > 0 THEN concat('Club ', home_id) ELSE concat('C', home_id) END AS home_team,
  CASE WHEN game_id % 3 > 0 THEN concat('Club ', away_id) ELSE concat('C', away_id) END AS away_team, CASE WHEN hs + aw > 0 THEN hs END::INT AS home_score, CASE WHEN hs + aw > 0 THEN aw END::INT AS away_score,
  CASE WHEN game_id % 3 > 0 THEN concat('Round ', game_id % 3) END AS phase, CASE WHEN game_id % 3 > 0 THEN concat('R', game_id % 3) END AS round_name, CASE WHEN game_id % 3 > 0 THEN 'data' ELSE 'card' END AS origin
FROM events_of WHERE game_id % 3 > 0 OR game_id % 31 > 0""", **EVENTS))
def official_games(spark, sf_dir):
    """Games of which a third is on cards only, a third in the page's data only, a third in both; some cards wait for their teams."""
    return _events(spark, sf_dir)[0]


@query(with_views("""SELECT season, p.n AS page, CASE WHEN p.n % 4 = 1 THEN 'errors: {"rate":"limit"}' ELSE 'missing' END AS reason FROM (SELECT season, count(*) % 5 + 3 AS total FROM games GROUP BY season) s, range(1, 9) p(n)
  WHERE p.n <= total AND p.n % 4 IN (1, 3)"""))
def api_gaps(spark, sf_dir):
    """Answers of an API in pages: each third of four is missing, each first is an error."""
    s = view(spark, sf_dir, "games").groupBy("season").agg((F.count("*") % 5 + 3).alias("total"))
    p = s.select("season", "total", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias("n")).filter("n % 4 <> 3")
    paging = F.concat(F.lit(',"paging":{"current":'), "n", F.lit(',"total":'), "total", F.lit('},"response":[]}'))
    body = F.concat(F.when(F.col("n") % 4 == 1, '{"errors":{"rate":"limit"}').otherwise('{"errors":[]'), paging)
    return files.api_gaps(p.select("season", F.col("n").alias("page"), body.alias("body")), ["season"])
