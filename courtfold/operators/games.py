"""Filters, review, browsing and coverage of games."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_called_off, is_finished


def filtered(games: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every argument that isn't blank."""
    for name, value in wanted.items():
        if value is not None and str(value).strip():
            games = games.filter(F.col(name) == value)
    return games


def season_matches(season: Column, wanted: str) -> Column:
    """Equal to the label, or to the single year that old rows carry."""
    return season.isin(wanted, wanted.split("-")[0])


def in_year(day: Column, year: int) -> Column:
    return (day >= F.lit(date(year, 1, 1))) & (day < F.lit(date(year + 1, 1, 1)))


def between_days(at: Column, first: date | None, last: date | None) -> Column:
    """From the start of the first day to the end of the last; None is open."""
    keep = F.lit(True)
    if first:
        keep = keep & (at >= F.lit(first))
    if last:
        keep = keep & (at < F.date_add(F.lit(last), 1))
    return keep


def _done_anywhere(status: Column) -> Column:
    """The filter's notion of finished: 'final' anywhere counts, unlike in the reasons."""
    return F.regexp_like(F.lower(status), F.lit("finished|after overtime|after over time|final|completed"))


def review(games: DataFrame, kind: str, as_of: Column) -> DataFrame:
    """needs_review, excluded, missing_score, or stale: two days past without a final status."""
    off, done = is_called_off(F.col("status")), _done_anywhere(F.col("status"))
    missing = done & (F.col("home_score").isNull() | F.col("away_score").isNull())
    stale = ~done & (F.col("game_date") < F.date_sub(as_of, 2))
    kinds = {"excluded": ~F.col("eligible"), "missing_score": missing, "stale": stale & ~off, "needs_review": ~off & (~F.col("eligible") | missing | stale)}
    return games.filter(kinds[kind])


def review_reasons(games: DataFrame, as_of: Column) -> DataFrame:
    """Each game with the list of what is wrong with it; games called off have none."""
    done = is_finished(F.col("status"))
    reasons = F.array_compact(F.array(
        F.when(~F.col("eligible"), "excluded"), F.when(done & (F.col("home_score").isNull() | F.col("away_score").isNull()), "missing score"),
        F.when(~done & (F.col("game_date") < F.date_sub(as_of, 2)), "stale"),
    ))
    return games.withColumn("reasons", F.when(is_called_off(F.col("status")), F.array().cast("array<string>")).otherwise(reasons))


def write_errors(games: DataFrame) -> DataFrame:
    """Rows that must not be written: a finished game needs two different scores from 0 to 300, others none or both."""
    bad_range = ~F.col("home_score").between(0, 300) | ~F.col("away_score").between(0, 300)
    error = (
        F.when((F.col("status") == "finished") & (F.col("home_score").isNull() | F.col("away_score").isNull()), "finished without score")
        .when(F.col("home_score").isNull() != F.col("away_score").isNull(), "one score").when(bad_range, "out of range")
        .when((F.col("status") == "finished") & (F.col("home_score") == F.col("away_score")), "level")
    )
    return games.withColumn("error", error).filter("error is not null")


def appearances(games: DataFrame) -> DataFrame:
    """A row for each side of each game."""
    return games.withColumn("side", F.explode(F.array(
        F.struct(F.col("home_id").alias("team_id"), F.lit(True).alias("is_home")), F.struct(F.col("away_id").alias("team_id"), F.lit(False).alias("is_home"))
    ))).select("*", "side.*").drop("side")


def missing_scores(games: DataFrame) -> Column:
    return F.count_if(F.col("home_score").isNull() | F.col("away_score").isNull())


def coverage(catalog: DataFrame, games: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every league and season of the catalog with its games, its last job, the league's median and whether its count looks low.

    catalog(competition_id, kind, first, last): kind is league, cup or super. A league season under 65 % of the median is low, a cup under the
    larger of 4 and 35 % unless it has 4 games and the median is at most 20, a super cup without games.
    """
    seasons = catalog.select("competition_id", "kind", F.explode(F.sequence("first", "last")).alias("y")).select("competition_id", "kind", F.concat_ws("-", "y", F.col("y") + 1).alias("season"))
    counted = games.groupBy("competition_id", "season").agg(F.count("*").alias("n"), F.count_if(F.col("home_score").isNotNull()).alias("n_done"))
    last = Window.partitionBy("competition_id", "season").orderBy(F.desc("job_id"))
    job = jobs.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("competition_id", "season", F.col("status").alias("job_status"))
    rows = seasons.join(counted, ["competition_id", "season"], "left").join(job, ["competition_id", "season"], "left").fillna(0, ["n", "n_done"])
    middle = rows.filter("n > 0").groupBy("competition_id").agg(F.median("n").alias("median"))
    rows = rows.join(middle, "competition_id", "left")
    low = (
        F.when(F.coalesce(F.col("median"), F.lit(0)) <= 0, False).when(F.col("kind") == "super", F.col("n") == 0)
        .when((F.col("kind") == "cup") & (F.col("n") >= 4) & (F.col("median") <= 20), False)
        .when(F.col("kind") == "cup", F.col("n") < F.greatest(F.lit(4.0), F.col("median") * 0.35)).otherwise(F.col("n") < F.col("median") * 0.65)
    )
    return rows.withColumn("low", low)


def summary(games: DataFrame, *keys: str) -> DataFrame:
    """Games, finished games, different teams and the first and last day for each value of the keys, in one shuffle of both sides."""
    home = F.col("is_home")
    return appearances(games).groupBy(*keys).agg(
        F.count_if(home).alias("games"), F.count_if(home & (F.col("status") == "finished")).alias("n_finished"), F.count_distinct("team_id").alias("teams"),
        F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"),
    )


def season_list(games: DataFrame) -> DataFrame:
    """Seasons whatever their case, in the least spelling, with their games and last day."""
    return games.groupBy(F.lower("season").alias("key")).agg(F.min("season").alias("season"), F.count("*").alias("games"), F.max("game_date").alias("last_date")).drop("key")


def pool_catalog(games: DataFrame, pools: list[str]) -> DataFrame:
    """Every known pool with its games and last game, which may be none."""
    known = games.sparkSession.createDataFrame([(p,) for p in pools], "pool string")
    counted = games.groupBy("pool").agg(F.count("*").alias("n"), F.max("game_date").alias("last_date"))
    return known.join(counted, "pool", "left").select("pool", F.coalesce("n", F.lit(0)).alias("games"), "last_date")


def totals(games: DataFrame) -> DataFrame:
    """One row for the whole table."""
    return games.agg(
        F.count("*").alias("games"), F.count_if(F.col("status") == "finished").alias("n_finished"), F.count_if("eligible").alias("n_eligible"),
        F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"), missing_scores(games).alias("n_missing"),
    )


def unrated(games: DataFrame, history: DataFrame) -> DataFrame:
    """Games with both scores that no history row rates."""
    return games.filter("home_score is not null and away_score is not null").join(history.select("pool", "game_id"), ["pool", "game_id"], "left_anti")


def admin_coverage(games: DataFrame, history: DataFrame, most: int = 25) -> DataFrame:
    """Competitions' seasons with the most games that miss a rating: a report of `most` rows."""
    rated = history.filter("is_home").select("pool", "game_id", F.lit(True).alias("rated"))
    done = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    grouped = games.join(rated, ["pool", "game_id"], "left").groupBy("competition_id", "season").agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(done & F.col("rated").isNull()).alias("n_unrated"), F.max("game_date").alias("last_date")
    )
    return grouped.orderBy(F.desc("n_unrated"), F.desc("total"), "competition_id", "season").limit(most)


def season_audit(games: DataFrame) -> DataFrame:
    """For each season: games, games without scores, and copies beyond the first of (day, home, away)."""
    once = games.groupBy("season", "game_date", "home_id", "away_id").agg(F.count("*").alias("n"), missing_scores(games).alias("m"))
    return once.groupBy("season").agg(F.sum("n").alias("games"), F.sum("m").alias("n_missing"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("n_copies"))


def merged_metrics(parts: DataFrame, keys: list[str], names: list[str], n: str = "n") -> DataFrame:
    """Means of parts as means of wholes, weighted by their counts; null where the counts add up to zero."""
    return parts.groupBy(*keys).agg(F.sum(n).alias(n), *[F.try_divide(F.sum(F.col(x) * F.col(n)), F.sum(n)).alias(x) for x in names])


def league_cards(rows: DataFrame) -> DataFrame:
    """Competitions of coverage rows: seasons, seasons with games, and the seasons of most and fewest games (the first of equals)."""
    some = F.col("n") > 0
    return rows.groupBy("competition_id").agg(
        F.count("*").alias("n_seasons"), F.count_if(some).alias("n_with_games"), F.bool_or(F.coalesce(F.col("low"), F.lit(False))).alias("any_low"),
        F.min("season").alias("first_season"), F.min_by("season", F.struct(-F.col("n"), F.col("season"))).alias("fullest"), F.min_by("season", F.struct("n", "season")).alias("emptiest"),
    )


def first_scored(games: DataFrame) -> DataFrame:
    """Each season's first day with a finished game, or its first day if none is finished."""
    return games.groupBy("season").agg(F.coalesce(F.min(F.when(F.col("status") == "finished", F.col("game_date"))), F.min("game_date")).alias("opener"))


def options(games: DataFrame) -> DataFrame:
    """(kind, value): what each filter of the games browser can take."""
    kinds = {"season": F.col("season"), "source": F.col("source"), "year": F.year("game_date").cast("string"), "round": F.col("round_name"), "status": F.col("status")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("o")
    return games.select(pairs).select("o.*").filter("value is not null").distinct()


def search(games: DataFrame, teams: DataFrame, text: str | None, exact_case: bool = False) -> DataFrame:
    """Games of which a team's name holds the text: as a LIKE pattern in any case, or as it is written."""
    if not text or not text.strip():
        return games
    name = F.contains(F.col("team_name"), F.lit(text)) if exact_case else F.col("team_name").ilike(f"%{text.strip()}%")
    hit = teams.filter(name).select("team_id")
    home = games.join(hit.withColumnRenamed("team_id", "home_id"), "home_id", "left_semi")
    away = games.join(hit.withColumnRenamed("team_id", "home_id"), "home_id", "left_anti").join(hit.withColumnRenamed("team_id", "away_id"), "away_id", "left_semi")
    return home.unionByName(away)


def top_teams(snapshot: DataFrame, games: DataFrame, n: int) -> DataFrame:
    """The n best rated teams of each competition, of those that played in it."""
    members = appearances(games).select("competition_id", "pool", "team_id").distinct()
    w = Window.partitionBy("competition_id").orderBy(F.desc("elo"), "team_id")
    return members.join(snapshot, ["pool", "team_id"]).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("competition_id", "place", "team_id", "elo")


def tier_summary(snapshot: DataFrame, games: DataFrame, competitions: DataFrame) -> DataFrame:
    """Games, teams and the mean rating of the teams of each tier and pool."""
    own = appearances(games).join(competitions.select("competition_id", "tier"), "competition_id")
    teams = own.groupBy("pool", "tier", "team_id").agg(F.count_if("is_home").alias("n"))
    rated = teams.join(snapshot.select("pool", "team_id", "elo"), ["pool", "team_id"], "left")
    return rated.groupBy("pool", "tier").agg(F.count("*").alias("teams"), F.sum("n").alias("games"), F.round(F.avg("elo"), 2).alias("avg_elo"))
