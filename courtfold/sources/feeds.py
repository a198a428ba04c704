"""Feeds of several shapes read into games: daily pages with local times, league JSON, official status JSON, merged and repaired schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_name, feed_status, pair_key, short_hash, to_utc

LEAGUE = (
    "championships array<struct<id:string,days:array<struct<number:int,date:string,matches:array<struct<id:string,home:bigint,away:bigint,home_points:string,away_points:string>>>>>>, "
    "teams array<struct<id:bigint,name:string>>"
)
OFFICIAL = "matches array<struct<id:string,status:string,home:string,guest:string,home_score:string,guest_score:string,date:string>>"


def daily_games(rows: DataFrame, zone: str) -> DataFrame:
    """Games of a daily page's rows (page, row_no, cells) whose cells hold a local time, a word of status, teams and scores; the id is a hash of day, competition and teams."""
    c = lambda k: F.trim(F.element_at("cells", F.lit(k)))
    hs, aw = c("home_score").try_cast("int"), c("away_score").try_cast("int")
    local = F.try_to_timestamp(F.concat_ws(" ", c("date"), c("time")), F.lit("yyyy-MM-dd HH:mm"))
    ident = short_hash(c("date"), F.lower(c("competition")), compact_name(c("home")), compact_name(c("away")))
    return rows.filter(c("home").isNotNull() & c("away").isNotNull() & local.isNotNull()).select(
        ident.alias("source_game_id"), to_utc(local, zone).alias("game_ts"), c("competition").alias("competition"), c("home").alias("home"), c("away").alias("away"),
        hs.alias("home_score"), aw.alias("away_score"), feed_status(c("status"), hs.isNotNull() & aw.isNotNull()).alias("status"),
    )


def league_games(pages: DataFrame, order: str, column: str = "body") -> DataFrame:
    """Games of a league's JSON: championships, their days and matches, with names by the page's teams; of equal ids the last by `order` and day counts."""
    body = pages.select(F.col(order).alias("page_no"), F.from_json(column, LEAGUE).alias("b"))
    days = body.select("page_no", "b.teams", F.explode("b.championships").alias("c")).select("page_no", "teams", F.explode("c.days").alias("d"))
    m = days.select("page_no", "teams", F.col("d.number").alias("round_no"), F.try_to_date("d.date", "yyyy-MM-dd").alias("game_date"), F.explode("d.matches").alias("m"))
    names = F.map_from_entries("teams")
    out = m.select(
        "page_no", "round_no", "game_date", F.col("m.id").alias("source_game_id"), F.element_at(names, F.col("m.home")).alias("home"), F.element_at(names, F.col("m.away")).alias("away"),
        F.col("m.home_points").try_cast("int").alias("home_score"), F.col("m.away_points").try_cast("int").alias("away_score"),
    )
    w = Window.partitionBy("source_game_id").orderBy(F.desc("page_no"), F.desc("round_no"), F.desc("game_date"))
    return out.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "page_no")


def official_matches(pages: DataFrame, fixes: DataFrame | None = None, column: str = "body") -> DataFrame:
    """All matches of official JSON with their kind: accepted, not official, without score, or malformed (a team missing that no fix names).

    fixes(id, team) name the one missing team of a match; such a match says so in `parser`.
    """
    m = pages.select(F.explode(F.from_json(column, OFFICIAL).getField("matches")).alias("m")).select("m.*")
    if fixes is not None:
        m = m.join(fixes.select("id", F.col("team").alias("fix")), "id", "left")
    else:
        m = m.withColumn("fix", F.lit(None).cast("string"))
    one = F.col("home").isNull() != F.col("guest").isNull()
    home, away = (F.coalesce(F.col(c), F.when(one, F.col("fix"))) for c in ("home", "guest"))
    hs, aw = F.col("home_score").try_cast("int"), F.col("guest_score").try_cast("int")
    kind = F.when(F.col("status").isNull() | (F.col("status") != "OFFICIAL"), "not official").when(home.isNull() | away.isNull(), "malformed").when(hs.isNull() | aw.isNull(), "without score").otherwise("accepted")
    return m.select("id", home.alias("home_team"), away.alias("away_team"), hs.alias("hs"), aw.alias("aw"), F.try_to_date("date", "yyyy-MM-dd").alias("game_date"), kind.alias("kind"),
                    F.when(one & F.col("fix").isNotNull(), "inferred").otherwise("as given").alias("parser"))


def filled_dates(games: DataFrame, season: str, stages: list[str], order: str, early: tuple[str, ...] = ()) -> DataFrame:
    """Undated games of all stages but the first get consecutive days after the later of the stage before's end and the last known day of their own; dated ones stay.

    Undated games of an `early` stage follow the stage before, whatever days of their own stage are known. A stage ends with the latest of the end before, its known days
    and the days it was given, so every end is a running maximum of known days less the undated games before them. A season whose first stage has no day stays as it is.
    """
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    g = games.withColumn("stage_no", rank)
    per = g.groupBy(season, "stage_no", "stage").agg(F.max("game_date").alias("known_end"), F.count_if(F.col("game_date").isNull()).alias("n"))
    per = per.withColumn("undated", F.when(F.col("stage_no") > 1, F.col("n")).otherwise(0))
    w = Window.partitionBy(season).orderBy("stage_no")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    follows = F.col("stage").isin(*early) if early else F.lit(False)
    per = per.withColumns({"extra": F.sum("undated").over(upto), "known": F.unix_date("known_end"), "first_end": F.first("known_end").over(upto), "least_no": F.first("stage_no").over(upto)})
    per = per.withColumn("base", F.col("known") + F.when(follows, 0).otherwise(F.col("undated")) - F.col("extra"))
    ended = F.max("base").over(before) + F.col("extra") - F.col("undated")
    start = F.when(follows, ended).otherwise(F.greatest(ended, "known"))
    whole = (F.col("least_no") == 1) & F.col("first_end").isNotNull() & (F.col("stage_no") > 1)
    per = per.withColumn("before_end", F.when(whole, F.date_from_unix_date(start.cast("int")))).select(season, "stage_no", "before_end")
    nth = F.row_number().over(Window.partitionBy(season, "stage_no").orderBy(F.col("game_date").isNotNull(), order))
    out = g.join(per, [season, "stage_no"]).withColumn("nth", nth)
    return out.withColumn("game_date", F.coalesce("game_date", F.date_add("before_end", F.col("nth")))).drop("stage_no", "before_end", "nth")


def _game_key() -> Column:
    return pair_key(compact_name(F.col("home")), compact_name(F.col("away")))


def merged_sources(first: DataFrame, second: DataFrame, scope: list[str]) -> DataFrame:
    """Games of two sources, the first one's before the second's, met by teams in either order; a missing date is taken from the other."""
    both = first.withColumn("place", F.lit(0)).unionByName(second.withColumn("place", F.lit(1))).withColumn("key", _game_key())
    w = Window.partitionBy(*scope, "key")
    dated = both.withColumns({"rn": F.row_number().over(w.orderBy("place", "source_game_id")), "known": F.min("game_date").over(w)})
    return dated.filter("rn = 1").withColumn("game_date", F.coalesce("game_date", "known")).drop("rn", "known", "key", "place")


def team_pages(rows: DataFrame, season: str) -> DataFrame:
    """Games from each team's own schedule (team, opponent, at_home, own_score, other_score, game_date), each game once: the home team's row, else the other's turned round."""
    home = F.col("at_home")
    g = rows.select(
        season, "game_date", F.when(home, F.col("team")).otherwise(F.col("opponent")).alias("home"), F.when(home, F.col("opponent")).otherwise(F.col("team")).alias("away"),
        F.when(home, F.col("own_score")).otherwise(F.col("other_score")).alias("home_score"), F.when(home, F.col("other_score")).otherwise(F.col("own_score")).alias("away_score"), home.alias("own_page"),
    )
    w = Window.partitionBy(season, "game_date", "home", "away").orderBy(F.desc("own_page"), "home_score", "away_score")
    one = g.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "own_page")
    return one.withColumn("source_game_id", short_hash(F.col(season), F.col("game_date").cast("string"), F.col("home"), F.col("away")))


def best_source(rows: DataFrame, scope: list[str], least: int = 50) -> DataFrame:
    """For each scope the rows of its main source if they are `least` or more and all resolved, else of the richest source, and the main one's knockout games beside it.

    rows(.., source_no, resolved, knockout, source_game_id): source 0 is the main one.
    """
    n = rows.groupBy(*scope, "source_no").agg(F.count("*").alias("n"), F.bool_and("resolved").alias("whole"))
    main = n.filter("source_no = 0").select(*scope, ((F.col("n") >= least) & F.col("whole")).alias("good"))
    richest = n.groupBy(*scope).agg(F.max_by("source_no", F.struct("n", -F.col("source_no"))).alias("best"))
    chosen = richest.join(main, scope, "left").select(*scope, F.coalesce("good", F.lit(False)).alias("good"), "best")
    own = rows.join(chosen, scope)
    kept = own.filter((F.col("good") & (F.col("source_no") == 0)) | (~F.col("good") & ((F.col("source_no") == F.col("best")) | ((F.col("source_no") == 0) & F.col("knockout")))))
    w = Window.partitionBy(*scope, "source_game_id").orderBy(F.col("source_no") != F.col("best"), "source_no")
    return kept.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "good", "best")


def staged_games(rows: DataFrame, stages: dict[str, str], order: str) -> DataFrame:
    """Games of an archive's pages by stage: the last row of an id counts, the stage says the competition, and games without score wait with their reason.

    stages maps a stage's name in lower case to a competition; rows of other stages are left out.
    """
    w = Window.partitionBy("source_game_id").orderBy(F.desc(order))
    one = rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in stages.items() for x in kv]), F.lower(F.trim("stage")))
    missing = F.col("home_score").isNull() | F.col("away_score").isNull()
    return one.withColumn("competition", name).filter("competition is not null").withColumns({
        "status": F.when(missing, "score_pending").otherwise("finished"), "eligible": ~missing, "exclusion_reason": F.when(missing, "no score in the archive"),
    })


def routed_seasons(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seasons of routes(provider, league, first, last) with their one provider, and those that several providers claim."""
    years = routes.select("provider", "league", F.explode(F.sequence("first", "last")).alias("y"))
    n = years.groupBy("league", "y").agg(F.count_distinct("provider").alias("n"), F.min("provider").alias("provider"))
    season = F.concat_ws("-", F.col("y").cast("string"), (F.col("y") + 1).cast("string")).alias("season")
    return n.filter("n = 1").select("league", season, "provider"), n.filter("n > 1").select("league", season, "n")
