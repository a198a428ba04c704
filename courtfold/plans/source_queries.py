"""Queries over sources: games written in each format by the adapter's rows, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files as S
from ..sources import wiki as W
from .adapter import dealt, piece_of, view, with_views
from .registry import query


@query(with_views("SELECT game_id, game_date::VARCHAR AS game_date, status, concat('T', home_id) AS home, concat('T', away_id) AS away, home_score::INT AS home_score, away_score::INT AS away_score FROM games"))
def api_games(spark, sf_dir):
    """Games as pages of nested JSON."""
    side = lambda c: F.struct(F.col(c).alias("id"), F.concat(F.lit("T"), c).alias("name"))
    total = lambda c: F.struct(F.col(c).cast("string").alias("total"))
    one = F.struct(
        F.col("game_id").alias("id"), F.col("game_date").cast("string").alias("date"), F.struct(F.col("status").alias("long")).alias("status"),
        F.struct(side("home_id").alias("home"), side("away_id").alias("away")).alias("teams"), F.struct(total("home_score").alias("home"), total("away_score").alias("away")).alias("scores"),
    )
    pages = view(spark, sf_dir, "games").select(F.to_json(F.struct(F.array(one).alias("response"), F.lit("x").alias("unknown"))).alias("body"))
    return S.api_games(pages)


@query(with_views("SELECT source_game_id, game_date, concat('T', home_id) AS home, concat('T', away_id) AS away, home_score::INT AS home_score, away_score::INT AS away_score FROM games"))
def feed_games(spark, sf_dir):
    """Games as delimited feed records."""
    field = lambda k, v: F.concat(F.lit(f"{k}÷"), F.coalesce(v.cast("string"), F.lit("")), F.lit("¬"))
    team = lambda c: F.concat(F.lit("T"), c)
    noon = F.unix_timestamp("game_date") + 43200
    feed = F.concat(
        F.lit("SA÷1¬~"), field("AA", F.col("source_game_id")), field("AD", noon), field("AE", team("home_id")), field("AF", team("away_id")), field("AG", F.col("home_score")),
        field("AH", F.col("away_score")), field("AE", F.lit("later")),
    )
    return S.feed_games(S.delimited_records(view(spark, sf_dir, "games").select(feed.alias("feed"))))


@query(with_views("""SELECT season AS page, substr(sha256(concat_ws('|', season, game_date::VARCHAR, concat('T', home_id), concat('T', away_id), '1')), 1, 24) AS source_game_id, game_date, concat('T', home_id) AS home,
  concat('T', away_id) AS away, home_score::INT AS home_score, away_score::INT AS away_score, CASE WHEN home_score IS NOT NULL AND away_score IS NOT NULL THEN 'finished' WHEN game_id % 2 = 0 THEN 'postponed' ELSE 'scheduled' END AS status FROM games"""))
def schedule_games(spark, sf_dir):
    """Games as rows of an HTML schedule."""
    cell = lambda k, v: F.concat(F.lit(f'<td data-stat="{k}"><a>'), F.coalesce(v.cast("string"), F.lit("")), F.lit("</a></td>"))
    html = F.concat(
        F.lit("<table><tr><th>Date</th></tr><tr>"), cell("date_game", F.col("game_date")), cell("home_team_name", F.concat(F.lit("T"), "home_id")), cell("visitor_team_name", F.concat(F.lit("T"), "away_id")),
        cell("home_pts", F.col("home_score")), cell("visitor_pts", F.col("away_score")), cell("game_remarks", F.when(F.col("game_id") % 2 == 0, "Postponed")), F.lit("</tr></table>"),
    )
    return S.schedule_games(S.table_rows(dealt(view(spark, sf_dir, "games"), "game_id").select("season", html.alias("html")), "season"))


@query(with_views("""SELECT CAST(r.r_regionkey AS VARCHAR) AS page, h.n_name AS home, a.n_name AS away, (60 + h.n_nationkey)::INT AS home_score, (60 + a.n_nationkey * 2)::INT AS away_score FROM region r
JOIN nation h ON h.n_regionkey = r.r_regionkey JOIN nation a ON a.n_regionkey = r.r_regionkey WHERE h.n_nationkey <> a.n_nationkey"""))
def matrix_games(spark, sf_dir):
    """Games of the nations of a region as a score matrix."""
    nation = view(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("page"), "n_name", "n_nationkey")
    own = nation.select("page", "n_name", F.col("n_nationkey").alias("h"))
    cell = F.struct("n_nationkey", F.when(F.col("h") == F.col("n_nationkey"), "x").otherwise(F.concat((60 + F.col("h")).cast("string"), F.lit("-"), (60 + 2 * F.col("n_nationkey")).cast("string"))).alias("c"))
    rows = own.join(nation.select("page", "n_nationkey"), "page").groupBy("page", "n_name", "h").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    order = F.array_position(F.transform("cells", lambda c: c["n_nationkey"]), F.col("h")) - 1
    return S.matrix_games(rows.select("page", order.cast("int").alias("row_no"), F.col("n_name").alias("team"), F.transform("cells", lambda c: c["c"]).alias("cells")))


@query("""SELECT o_orderkey AS id, concat(year(o_orderdate), '-', year(o_orderdate) + 1) AS full_label, year(o_orderdate) AS first_year,
  concat(year(o_orderdate) - CASE WHEN month(o_orderdate) < 8 THEN 1 ELSE 0 END, '-', year(o_orderdate) + 1 - CASE WHEN month(o_orderdate) < 8 THEN 1 ELSE 0 END) AS season FROM orders""")
def season_labels(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    short = F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad(((F.year("o_orderdate") + 1) % 100).cast("string"), 2, "0"))
    return orders.select(F.col("o_orderkey").alias("id"), T.full_season(short).alias("full_label"), T.start_year(short).alias("first_year"), T.season_of(F.col("o_orderdate"), 8).alias("season"))


@query(r"""SELECT p_partkey AS id, upper(regexp_replace(p_name, '[^\p{L}\p{Nd}]', '', 'g')) AS compact, trim(regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', ' ', 'g')) AS plain, substr(sha256(concat_ws('|', p_name, p_brand)), 1, 24) AS hash,
  replace(p_name, ' ', '-') AS slug, concat_ws(':', least(p_partkey, p_size), greatest(p_partkey, p_size)) AS pair FROM part""")
def name_keys(spark, sf_dir):
    return view(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), T.compact_name(F.col("p_name")).alias("compact"), T.plain_name(F.col("p_brand")).alias("plain"), T.short_hash(F.col("p_name"), F.col("p_brand")).alias("hash"),
        T.slug(F.col("p_name")).alias("slug"), T.pair_key(F.col("p_partkey"), F.col("p_size")).alias("pair"),
    )


@query(with_views("""SELECT game_id, CASE WHEN n = 1 THEN known ELSE hidden END AS game_date FROM (SELECT game_id, hidden, min(hidden) OVER w AS known, count(DISTINCT hidden) OVER w AS n FROM (
  SELECT game_id, competition_id, season, round_name, CASE WHEN game_id % 3 <> 0 THEN game_date END AS hidden FROM games) WINDOW w AS (PARTITION BY competition_id, season, round_name))"""))
def repaired_dates(spark, sf_dir):
    """A third of the dates hidden, and repaired from the round's one date where there is only one."""
    hidden = view(spark, sf_dir, "games").withColumn("game_date", F.when(F.col("game_id") % 3 != 0, F.col("game_date")))
    return S.repaired_dates(hidden, ["competition_id", "season", "round_name"]).select("game_id", "game_date")


#: Games written as wikitext under headings, in a form for each sixth of them; a sixth isn't closed, and one is prose.
_A, _B = "concat('[[T', home_id, '|Team ', home_id, ']]')", "concat('[[Club ', away_id, ']]')"
_SCORES = "concat(home_score, '–', away_score)", "concat(away_score, '-', home_score + 1)", "concat(home_score + 2, ' – ', away_score)"
WIKI = {
    "scored_games": "SELECT * FROM games WHERE home_score IS NOT NULL AND away_score IS NOT NULL",
    "written_games": f"""SELECT season, competition_id, game_id, concat(chr(10), '=== ', round_name, ' ===', chr(10), CASE game_id % 6
  WHEN 0 THEN concat('{{{{TwoLegResult|', {_A}, '|{{{{flag|A=1|{{{{b|c}}}}}}}}|9–9|', {_B}, '|{{{{flag|B}}}}|', {_SCORES[0]}, '|', {_SCORES[1]}, '}}}}')
  WHEN 1 THEN concat('{{{{ThreeLegResult|', {_A}, '||', '|', {_B}, '||', {_SCORES[0]}, '<ref>Un partido de desempate, en {{{{flag|C}}}} campo: ', {_B}, ' - ', {_A}, ' ', {_SCORES[2]}, '</ref>|', {_SCORES[1]}, '|', {_SCORES[2]}, '|note=x}}}}')
  WHEN 2 THEN concat('{{|', chr(10), '|-', chr(10), '| ', {_A}, ' || 1–1 || ', {_B}, ' || ', {_SCORES[0]}, chr(10), '| ', {_SCORES[1]}, chr(10), '|-', chr(10), '| standings || 1 || 2', chr(10), '|}}')
  WHEN 3 THEN concat('{{{{4TeamBracket|RD1-team1=', {_A}, '{{{{flag|D}}}}|RD1-team2=', {_B}, '|RD1-score1-1=', home_score, '|RD1-score2-1=', away_score, '|RD1-score1-2=', away_score, '|RD1-score2-2=', home_score + 1, '|RD1-team3=bye|RD1-team4=x}}}}')
  WHEN 4 THEN concat('{{{{TwoLegResult|', {_A}, '|1–1|', {_B}, '|', {_SCORES[0]}) ELSE concat({_A}, ' beat ', {_B}, ' by ', {_SCORES[0]}) END) AS piece FROM scored_games""",
}
_HOME, _AWAY = "concat('Team ', home_id)", "concat('Club ', away_id)"


def _leg(kind: str, n: int, rest: int, scores: tuple[str, str], turned: bool) -> str:
    home, away = (_AWAY, _HOME) if turned else (_HOME, _AWAY)
    return f"""SELECT concat(competition_id, ' ', season) AS page, '{kind}' AS kind, season AS phase, round_name, {n} AS leg, {home} AS home, {away} AS away, ({scores[0]})::INT AS home_score, ({scores[1]})::INT AS away_score
FROM scored_games WHERE game_id % 6 = {rest}"""


_FIRST, _SECOND, _THIRD = ("home_score", "away_score"), ("home_score + 1", "away_score"), ("home_score + 2", "away_score")
_LEGS = [
    _leg("twoleg", 1, 0, _FIRST, False), _leg("twoleg", 2, 0, _SECOND, True), _leg("threeleg", 1, 1, _FIRST, False), _leg("threeleg", 2, 1, _SECOND, True), _leg("threeleg", 3, 1, _THIRD, False),
    _leg("tie-break", 1, 1, _THIRD, True), _leg("table", 1, 2, _FIRST, False), _leg("table", 2, 2, _SECOND, True), _leg("bracket", 1, 3, _FIRST, False), _leg("bracket", 2, 3, _SECOND, True),
]


@query(with_views(" UNION ALL ".join(_LEGS), **WIKI))
def wiki_games(spark, sf_dir):
    """A page for each competition's season, and further ones of it as its games get many."""
    pieces = dealt(view(spark, sf_dir, "written_games", WIKI).withColumn("part", piece_of("game_id")), "competition_id", "season", "part").groupBy("competition_id", "season", "part").agg(F.array_sort(F.collect_list(F.struct("game_id", "piece"))).alias("p"))
    text = F.concat(F.lit("== "), "season", F.lit(" =="), F.array_join(F.col("p.piece"), "\n"))
    pages = pieces.select(F.concat_ws(" ", F.col("competition_id").cast("string"), "season").alias("page"), text.alias("wikitext"))
    return W.wiki_games(pages, "page").drop("seq", "source_game_id")
