"""Queries over seasons, names, places and orders: semi-joins, as-of joins, fallbacks, and lists in a given order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes as C
from ..operators import identity as I
from .adapter import view, with_views
from .identity_queries import COMPACT, FINDINGS, findings
from .registry import query

LINKS = "SELECT game_id, concat('c', game_id % 4) AS cycle FROM games UNION ALL SELECT game_id, concat('c', (game_id + 1) % 4) FROM games WHERE game_id % 3 = 0"


def links(spark, sf_dir):
    g = view(spark, sf_dir, "games").select("game_id")
    return g.select("game_id", F.concat(F.lit("c"), F.col("game_id") % 4).alias("cycle")).unionByName(
        g.filter("game_id % 3 = 0").select("game_id", F.concat(F.lit("c"), (F.col("game_id") + 1) % 4).alias("cycle")))


@query(with_views("SELECT game_id, season FROM games g WHERE EXISTS (SELECT 1 FROM links l WHERE l.game_id = g.game_id AND cycle IN ('c1', 'c2'))", links=LINKS))
def games_of_cycles(spark, sf_dir):
    """A game in two of the wanted cycles comes once."""
    wanted = links(spark, sf_dir).filter(F.col("cycle").isin("c1", "c2"))
    return view(spark, sf_dir, "games").join(wanted, "game_id", "left_semi").select("game_id", "season")


@query(with_views("""SELECT g.game_id, competition_name, l.cycle FROM games g JOIN competitions c ON c.competition_id = g.competition_id
LEFT JOIN (SELECT game_id, min(cycle) AS cycle FROM links WHERE cycle <> 'c0' GROUP BY game_id) l ON l.game_id = g.game_id""", links=LINKS))
def games_with_cycles(spark, sf_dir):
    cycles = links(spark, sf_dir).filter("cycle <> 'c0'").groupBy("game_id").agg(F.min("cycle").alias("cycle"))
    return view(spark, sf_dir, "games").join(view(spark, sf_dir, "competitions"), "competition_id").join(cycles, "game_id", "left").select("game_id", "competition_name", "cycle")


LABELS = "SELECT DISTINCT competition_id, season AS label FROM games UNION ALL SELECT DISTINCT competition_id, split_part(season, '-', 1) FROM games WHERE game_id % 2 = 0 UNION ALL SELECT 1, '1950'"


@query(with_views("""SELECT l.competition_id, l.label AS legacy, f.label FROM labels_ l JOIN labels_ f ON f.competition_id = l.competition_id
  AND f.label = concat(l.label, '-', CAST(l.label AS INT) + 1) WHERE NOT contains(l.label, '-')""".replace("CAST(l.label AS INT)", "try_cast(l.label AS INT)"), labels_=LABELS))
def legacy_seasons(spark, sf_dir):
    g = view(spark, sf_dir, "games")
    extra = spark.createDataFrame([(1, "1950")], "competition_id long, label string")
    return I.canonical_labels(
        g.select("competition_id", F.col("season").alias("label")).distinct()
        .unionByName(g.filter("game_id % 2 = 0").select("competition_id", F.split_part("season", F.lit("-"), F.lit(1)).alias("label")).distinct()).unionByName(extra))


SPANS = f"""SELECT alias_id AS team_id, source AS place, {COMPACT.format("alias_name")} AS name, make_date(valid_from + 4, 1, 1) AS first, make_date(valid_to, 12, 31) AS last FROM aliases"""


@query(with_views("""SELECT a.team_id AS earlier_id, b.team_id AS later_id, min(b.first - a.last) AS gap FROM spans a JOIN spans b ON a.place = b.place AND a.team_id <> b.team_id
WHERE b.first - a.last BETWEEN 0 AND 370 AND CASE WHEN least(length(a.name), length(b.name)) < 4 THEN a.name = b.name
  ELSE contains(a.name, b.name) OR contains(b.name, a.name) OR 1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) >= 0.86 END GROUP BY 1, 2""".replace("GROUP BY 1, 2", "GROUP BY a.team_id, b.team_id"), spans=SPANS))
def succeeding_teams(spark, sf_dir):
    a = view(spark, sf_dir, "aliases")
    spans = a.select(F.col("alias_id").alias("team_id"), F.col("source").alias("place"), F.make_date(F.col("valid_from") + 4, F.lit(1), F.lit(1)).alias("first"), F.make_date("valid_to", F.lit(12), F.lit(31)).alias("last"))
    return I.succeeding(spans, a.select(F.col("alias_id").alias("team_id"), T.compact_name(F.col("alias_name")).alias("name")))


MOVED = "SELECT game_id AS other_id, game_date + CAST(game_id % 4 AS INT) - 1 AS game_date, home_score, away_score, home_id, away_id FROM games WHERE game_id % 3 = 0 AND home_score IS NOT NULL"


@query(with_views("""SELECT game_id, other_id, distance FROM (SELECT *, count(*) OVER (PARTITION BY game_id) AS a, count(*) OVER (PARTITION BY other_id) AS b FROM (
  SELECT g.game_id, other_id, abs(g.game_date - m.game_date) AS distance FROM games g JOIN moved m USING (home_id, away_id, home_score, away_score) WHERE abs(g.game_date - m.game_date) <= 1)) WHERE a = 1 AND b = 1""", moved=MOVED))
def date_variants(spark, sf_dir):
    """A second source whose dates are moved by -1 to 2 days."""
    g = view(spark, sf_dir, "games")
    moved = g.filter("game_id % 3 = 0 and home_score is not null").withColumn("game_date", F.date_add("game_date", (F.col("game_id") % 4).cast("int") - 1)).withColumnRenamed("game_id", "other_id")
    return I.date_variants(g, moved, ["home_id", "away_id", "home_score", "away_score"])


SEASONS = "SELECT concat(y, '-', y + 1) AS label, make_date(y, 10, 1) AS first, make_date(y + 1, 5, 31) AS last FROM (SELECT CAST(unnest(generate_series(1990, 2026)) AS INT) AS y)"


@query(with_views("SELECT game_id, label FROM games JOIN seasons ON game_date BETWEEN first AND last", seasons=SEASONS))
def season_as_of(spark, sf_dir):
    y = F.col("y").cast("int")
    seasons = spark.range(1990, 2027).withColumnRenamed("id", "y").select(
        F.concat_ws("-", y.cast("string"), (y + 1).cast("string")).alias("label"), F.make_date(y, F.lit(10), F.lit(1)).alias("first"), F.make_date(y + 1, F.lit(5), F.lit(31)).alias("last"))
    return I.within_season(view(spark, sf_dir, "games").select("game_id", "game_date"), seasons, "game_date").select("game_id", "label")


WANTED = """SELECT alias_id AS want_id, CASE alias_id % 3 WHEN 0 THEN alias_name WHEN 1 THEN upper(alias_name) ELSE concat(alias_name, ' x') END AS name, 1994 + CAST(alias_id % 5 AS INT) AS year FROM aliases"""


@query(with_views(f"""SELECT w.want_id, b.team_id, b.step FROM wanted w LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY want_id ORDER BY step, alias_id) AS rn FROM (
  SELECT want_id, team_id, alias_id, CASE WHEN (valid_from IS NULL OR valid_from <= year) AND (valid_to IS NULL OR valid_to >= year) THEN 1 ELSE 2 END AS step FROM wanted JOIN aliases ON alias_name = name
  UNION ALL SELECT want_id, team_id, alias_id, 3 FROM wanted JOIN aliases ON {COMPACT.format("alias_name")} = {COMPACT.format("name")})) WHERE rn = 1) b ON b.want_id = w.want_id""", wanted=WANTED))
def resolved_names(spark, sf_dir):
    i = F.col("alias_id")
    a = view(spark, sf_dir, "aliases")
    wanted = a.select(
        i.alias("want_id"), F.when(i % 3 == 0, F.col("alias_name")).when(i % 3 == 1, F.upper("alias_name")).otherwise(F.concat("alias_name", F.lit(" x"))).alias("name"), (1994 + (i % 5)).cast("int").alias("year"))
    return I.resolve_names(wanted, a)


@query(with_views("""SELECT lower(trim(country)) AS country, lower(trim(competition)) AS competition, count(*) AS n, min(feed_date) AS first_date, max(feed_date) AS last_date FROM (
  SELECT raw_status AS country, concat(CASE WHEN feed_id % 2 = 0 THEN ' Cup ' ELSE 'CUP ' END, feed_id % 7) AS competition, feed_date FROM feed) WHERE NOT (lower(trim(country)) = 'view' AND lower(trim(competition)) IN ('cup 1', 'cup 2')) GROUP BY 1, 2"""
                  .replace("GROUP BY 1, 2", "GROUP BY lower(trim(country)), lower(trim(competition))")))
def unmatched_competitions(spark, sf_dir):
    i = F.col("feed_id")
    feed = view(spark, sf_dir, "feed").select(F.col("raw_status").alias("country"), F.concat(F.when(i % 2 == 0, " Cup ").otherwise("CUP "), i % 7).alias("competition"), "feed_date")
    known = spark.createDataFrame([("VIEW", "Cup 1"), ("view ", "cup 2")], "country string, competition string")
    return I.unmatched(feed, known)


@query(with_views("SELECT finding_id, status, severity FROM findings ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'deferred' THEN 1 ELSE 2 END, severity <> 'blocker', finding_id LIMIT 15", findings=FINDINGS))
def first_findings(spark, sf_dir):
    """Open before deferred before completed, blockers first."""
    rank = F.when(F.col("status") == "open", 0).when(F.col("status") == "deferred", 1).otherwise(2)
    return findings(spark, sf_dir).orderBy(rank, F.col("severity") != "blocker", "finding_id").limit(15).select("finding_id", "status", "severity")


@query(with_views("SELECT team_id, team_name, list_position([19, 3, 12, 7], team_id)::BIGINT AS position FROM teams WHERE team_id IN (19, 3, 12, 7)"))
def teams_in_given_order(spark, sf_dir):
    """Ids of a supplied list, broken ones dropped, with the place that each has in it."""
    ids = spark.createDataFrame([(T.id_list(" 19, x, 3,3, 12,7 "),)], "ids array<long>").select(F.posexplode("ids").alias("position", "team_id"))
    return view(spark, sf_dir, "teams").join(F.broadcast(ids), "team_id").select("team_id", "team_name", (F.col("position") + 1).cast("long").alias("position")).orderBy("position")


@query("SELECT r_name AS region, row_number() OVER (ORDER BY r_name <> 'ASIA', r_name) AS position FROM region")
def regions_with_one_first(spark, sf_dir):
    w = Window.orderBy(F.col("r_name") != "ASIA", "r_name")
    return view(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.row_number().over(w).cast("long").alias("position"))


PLACES = """SELECT c_custkey AS row_id, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS BIGINT) END AS id, CASE WHEN c_custkey % 4 <= 1 THEN concat(' ', lower(chr(65 + c_nationkey)), 'x') END AS code,
  CASE WHEN c_custkey % 4 <= 2 THEN concat(' ', replace(n_name, 'A', 'Á')) WHEN c_custkey % 4 = 3 THEN 'nowhere' END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey"""


@query(f"WITH places AS ({PLACES}) SELECT row_id, CASE WHEN name = 'nowhere' THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS place_id FROM places JOIN customer ON c_custkey = row_id")
def resolved_places(spark, sf_dir):
    """Places by id, by code, and by a name with marks."""
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey")
    nation = view(spark, sf_dir, "nation")
    code = lambda c: F.concat(F.char(F.lit(65) + c), F.lit("X"))
    rows = view(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == n).select(
        F.col("c_custkey").alias("row_id"), F.when(k == 0, n.cast("long")).alias("id"), F.when(k <= 1, F.concat(F.lit(" "), F.lower(code(n)))).alias("code"),
        F.when(k <= 2, F.concat(F.lit(" "), F.replace(F.col("n_name"), F.lit("A"), F.lit("Á")))).otherwise("nowhere").alias("name"))
    catalog = nation.select(F.col("n_nationkey").cast("long").alias("place_id"), code(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"))
    return T.resolve_place(rows, catalog)


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN '{"season":"1999-2000"}' ELSE concat('{"k":"', json_extract_string(props, '$.k'), '","season":"1999-2000"}') END AS document, event_id % 5 <> 0 AS had_k FROM events""")
def job_summaries(spark, sf_dir):
    """JSON documents, a fifth of them broken, with a key set."""
    e = view(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props")).alias("props"))
    return e.select("id", T.json_set(F.col("props"), "season", F.lit("1999-2000")).alias("document"), T.json_has(F.col("props"), "k").alias("had_k"))


@query(with_views("""SELECT finding_id, concat_ws('|', lower(finding_type), concat_ws(':', least(left_id, right_id), greatest(left_id, right_id)), CASE WHEN finding_id % 2 = 0 THEN 'all' ELSE lower(trim(evidence)) END) AS key FROM findings""", findings=FINDINGS))
def decision_keys(spark, sf_dir):
    scope = F.when(F.col("finding_id") % 2 != 0, F.upper("evidence"))
    return findings(spark, sf_dir).select("finding_id", T.decision_key(F.col("finding_type"), F.col("left_id"), F.col("right_id"), scope).alias("key"))


CODES = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'uk' WHEN 1 THEN ' EL' WHEN 2 THEN 'ESP' WHEN 3 THEN 'fr' WHEN 4 THEN '' ELSE 'YUG' END AS code FROM part"


@query(f"""SELECT id, CASE id % 6 WHEN 0 THEN 'GB' WHEN 1 THEN 'GR' WHEN 2 THEN 'ES' WHEN 3 THEN 'FR' WHEN 4 THEN NULL ELSE 'YUG' END AS code,
CASE id % 6 WHEN 0 THEN 'Britain' WHEN 1 THEN 'Greece' WHEN 2 THEN 'Spain' WHEN 3 THEN 'FR' WHEN 4 THEN NULL ELSE 'YUG' END AS name, id % 6 = 1 AS is_greece FROM ({CODES})""")
def country_names(spark, sf_dir):
    """Codes brought to one form, names by override and catalog, and equality of codes."""
    raw = F.element_at(F.array(*map(F.lit, ("uk", " EL", "ESP", "fr", "", "YUG"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), raw.alias("code"))
    name = T.display_name(F.col("code"), {"GB": "Britain"}, {"GB": "United Kingdom", "GR": "Greece", "ES": "Spain"})
    return rows.select("id", T.country_code(F.col("code")).alias("code"), name.alias("name"), T.same_country(F.col("code"), F.lit("gre")).alias("is_greece"))


@query(with_views("""SELECT game_id, game_date, home_id = 4 OR away_id = 4 AS of_left FROM games WHERE home_id IN (4, 11) OR away_id IN (4, 11) ORDER BY game_date DESC, game_id DESC LIMIT 12"""))
def evidence_games(spark, sf_dir):
    return I.evidence(view(spark, sf_dir, "games"), 4, 11).select("game_id", "game_date", "of_left")


@query(with_views("""SELECT game_id, CASE WHEN home_id = (SELECT team_id FROM aliases WHERE alias_id = 11) AND source = (SELECT source FROM aliases WHERE alias_id = 11) THEN 99 ELSE home_id END AS home_id,
CASE WHEN away_id = (SELECT team_id FROM aliases WHERE alias_id = 11) AND source = (SELECT source FROM aliases WHERE alias_id = 11) THEN 99 ELSE away_id END AS away_id FROM games"""))
def extracted_alias(spark, sf_dir):
    teams, aliases, games = (view(spark, sf_dir, n) for n in ("teams", "aliases", "games"))
    return C.extract_alias(teams, aliases, games, 11, 99)[2].select("game_id", "home_id", "away_id")


@query(with_views("""SELECT s.game_id, s.home_id, CASE WHEN s.manual THEN s.home_score ELSE d.home_score END AS home_score, CASE WHEN s.manual THEN s.status ELSE d.status END AS status, s.manual FROM (
  SELECT CASE WHEN game_id % 10 = 1 THEN NULL ELSE game_id END AS game_id, home_id, home_score, status, game_id % 4 = 0 AS manual FROM games WHERE game_id % 2 = 0 AND game_id % 10 <> 1) s
  JOIN (SELECT game_id, home_score + 1 AS home_score, 'finished' AS status FROM games) d ON d.game_id = s.game_id
UNION ALL SELECT NULL, 1, 70, 'finished', false"""))
def ingested_games(spark, sf_dir):
    """A delivery that comes twice, the later row first in order, over stored games of which some were set by hand; and a stored row without an id, which stays."""
    g = view(spark, sf_dir, "games").filter("game_id % 2 = 0")
    stored = g.select("game_id", "home_id", "home_score", F.lit(0).cast("long").alias("away_score"), "status", (F.col("game_id") % 4 == 0).alias("manual"), F.lit(0).alias("version"))
    stored = stored.unionByName(spark.createDataFrame([(None, 1, 70, 0, "finished", False, 0)], stored.schema))
    new = g.select("game_id", "home_id", (F.col("home_score") + 1).alias("home_score"), F.lit(0).cast("long").alias("away_score"), F.lit("finished").alias("status"), F.lit(False).alias("manual"), F.lit(2).alias("version"))
    twice = new.unionByName(new.withColumns({"home_score": F.lit(-1).cast("long"), "version": F.lit(1)}))
    return C.ingest(stored, twice, ["game_id"], [F.desc("version")]).select("game_id", "home_id", "home_score", "status", "manual")
