"""Rankings, movers, rating series and team form over rating history."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_POINTS, FEWEST_POINTS = 120, 2


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def points_for(n: int) -> int:
    """Points of a series: 120 if none or too many are asked for, 2 at least."""
    return MOST_POINTS if n <= 0 else clamp(n, FEWEST_POINTS, MOST_POINTS)


def as_of(history: DataFrame, cutoff: date) -> DataFrame:
    """Rating, games and last game of each team at the end of a day."""
    w = Window.partitionBy("pool", "ruleset", "team_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    last = history.filter(F.col("game_date") <= F.lit(cutoff)).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return last.select("pool", "ruleset", "team_id", F.round("post", 2).alias("elo"), (F.col("games_before") + 1).alias("games"), F.col("game_date").alias("last_date"))


def latest_change(history: DataFrame) -> DataFrame:
    """Change of each team's last game."""
    return history.groupBy("pool", "ruleset", "team_id").agg(F.round(F.max_by("change", F.struct("game_date", "game_id")), 2).alias("latest_change"))


def current_teams(games: DataFrame, teams: DataFrame, historical: list[str] = ()) -> DataFrame:
    """(pool, team_id) of the teams that count as current: active ones in 'nba', those of the last July season in 'europe', and not historical identities elsewhere."""
    sides = games.select("pool", "season", F.explode(F.array("home_id", "away_id")).alias("team_id")).distinct()
    last = sides.filter("pool = 'europe'").agg(F.max("season").alias("season"))
    europe = sides.filter("pool = 'europe'").join(F.broadcast(last), "season", "left_semi").select("pool", "team_id")
    nba = sides.filter("pool = 'nba'").join(teams.filter("is_active"), "team_id", "left_semi").select("pool", "team_id")
    gone = F.upper("team_name").isin([h.upper() for h in historical]) if historical else F.lit(False)
    national = sides.filter("pool not in ('nba', 'europe')").join(teams.filter(gone), "team_id", "left_anti").select("pool", "team_id")
    return europe.unionByName(nba).unionByName(national).distinct()


def rankings(
    snapshot: DataFrame, teams: DataFrame, changes: DataFrame, current: DataFrame | None = None,
    search: str | None = None, country: str | None = None, least_games: int = 0,
) -> DataFrame:
    """Teams by rating: the rank among all of the pool, and the rank in the filtered list. Search ignores case."""
    order = (F.desc("elo"), "team_name")
    named = snapshot.join(teams, "team_id")
    if current is not None:
        named = named.join(current, ["pool", "team_id"], "left_semi")
    all_ = named.withColumn("global_rank", F.row_number().over(Window.partitionBy("pool", "ruleset").orderBy(*order)))
    if search and search.strip():
        all_ = all_.filter(F.contains(F.lower("team_name"), F.lower(F.lit(search.strip()))))
    if country:
        all_ = all_.filter(F.col("country") == country)
    kept = all_.filter(F.col("games") >= least_games).withColumn("list_rank", F.row_number().over(Window.partitionBy("pool", "ruleset").orderBy(*order)))
    return kept.join(changes, ["pool", "ruleset", "team_id"], "left").select("pool", "team_id", "team_name", "country", "elo", "games", "global_rank", "list_rank", "latest_change")


def competition_rank(snapshot: DataFrame) -> DataFrame:
    """1 + the number of teams of the pool rated higher: equal ratings share a rank."""
    return snapshot.withColumn("rank", F.rank().over(Window.partitionBy("pool", "ruleset").orderBy(F.desc("elo"))))


def movers(history: DataFrame, days: int = 365, least_games: int = 1, window_end: str = "pool") -> DataFrame:
    """First and last rating, summed change and games of each team in the last days before its pool's latest game."""
    days = clamp(days, 7, 3650)
    end = history.groupBy("pool").agg(F.max("game_date").alias("until"))
    recent = history.join(end, "pool").filter(F.col("game_date") >= F.date_sub("until", days))
    key = F.struct("game_date", "game_id")
    return (
        recent.groupBy("pool", "ruleset", "team_id")
        .agg(
            F.round(F.min_by("pre", key), 2).alias("start_elo"), F.round(F.max_by("post", key), 2).alias("end_elo"), F.round(F.sum("change"), 2).alias("elo_change"),
            F.count("*").alias("games"), F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"),
        ).filter(F.col("games") >= least_games)
    )


def _bucket(rn: Column, total: Column, points: int) -> Column:
    return F.round((rn - 1) * (points - 1) / (total - 1))


def evolution(history: DataFrame, points: int = 0) -> DataFrame:
    """Rating series of each team thinned to evenly spread points; short series whole.

    Of the rows that fall to a bucket the nearest to its centre stays, the earlier of equals.
    """
    points = points_for(points)
    team = Window.partitionBy("pool", "ruleset", "team_id")
    numbered = history.withColumn("rn", F.row_number().over(team.orderBy("game_date", "game_id"))).withColumn("total", F.count("*").over(team))
    exact = (F.col("rn") - 1) * (points - 1) / F.when(F.col("total") > 1, F.col("total") - 1)
    dealt = numbered.withColumn("bucket", F.when(F.col("total") <= points, F.col("rn")).otherwise(F.round(exact))).withColumn(
        "distance", F.when(F.col("total") <= points, F.lit(0.0)).otherwise(F.abs(exact - F.round(exact)))
    )
    nearest = Window.partitionBy("pool", "ruleset", "team_id", "bucket").orderBy("distance", "rn")
    return dealt.withColumn("pick", F.row_number().over(nearest)).filter("pick = 1").select("pool", "team_id", "game_date", "game_id", F.round("post", 2).alias("elo"), "rn", "total")


def even_sample(history: DataFrame, points: int = 0) -> DataFrame:
    """Rows i(n-1)/(N-1), rounded, of each team's n: first and last stay."""
    points = points_for(points)
    team = Window.partitionBy("pool", "ruleset", "team_id")
    numbered = history.withColumn("rn", F.row_number().over(team.orderBy("game_date", "game_id"))).withColumn("total", F.count("*").over(team))
    # row rn is chosen if some i rounds to rn - 1: the least i that can is the ceiling below, and the next is too far
    share = (F.col("rn") - 1.5) * (points - 1) / F.when(F.col("total") > 1, F.col("total") - 1)
    i = F.greatest(F.ceil(share), F.lit(0))
    chosen = (F.col("total") <= points) | (F.floor(i * (F.col("total") - 1) / (points - 1) + 0.5) == F.col("rn") - 1)
    return numbered.filter(chosen).select("pool", "team_id", "game_id", "rn", "total", F.round("post", 2).alias("elo"))


def with_opponent(history: DataFrame) -> DataFrame:
    """Each row beside the opponent's rating before the same game."""
    other = history.select("pool", "ruleset", "game_id", F.col("team_id").alias("opponent_id"), F.col("pre").alias("opponent_pre"))
    return history.join(other, ["pool", "ruleset", "game_id", "opponent_id"])


def form(history: DataFrame, n: int = 5) -> DataFrame:
    """Of the last n games: wins, losses, summed change, mean opponent rating, best win and worst loss by opponent rating."""
    w = Window.partitionBy("pool", "ruleset", "team_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    last = with_opponent(history).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    won = F.col("actual") == 1
    return last.groupBy("pool", "ruleset", "team_id").agg(
        F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.round(F.sum("change"), 2).alias("change"),
        F.round(F.coalesce(F.avg("opponent_pre"), F.lit(0.0)), 2).alias("avg_opponent"),
        F.max_by("opponent_id", F.when(won, F.struct("opponent_pre", "game_id"))).alias("best_win"),
        F.min_by("opponent_id", F.when(~won, F.struct("opponent_pre", "game_id"))).alias("worst_loss"),
    )


def resample(history: DataFrame, unit: str = "month") -> DataFrame:
    """A team's rating at the end of each month or ISO week before its last game, the last at or before it, and at the last game itself; `filled` where the period has no game."""
    step = {"month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAYS"}[unit]
    inside = Window.partitionBy("pool", "ruleset", "team_id", "period").orderBy(F.desc("game_date"), F.desc("game_id"))
    last = history.withColumn("period", F.trunc("game_date", unit)).withColumn("rn", F.row_number().over(inside)).filter("rn = 1")
    bounds = last.groupBy("pool", "ruleset", "team_id").agg(F.min("period").alias("a"), F.max("period").alias("b"), F.max("game_date").alias("last_date"))
    grid = bounds.select("pool", "ruleset", "team_id", "b", "last_date", F.explode(F.expr(f"sequence(a, b, {step})")).alias("period"))
    upto = Window.partitionBy("pool", "ruleset", "team_id").orderBy("period")
    filled = grid.join(last.select("pool", "ruleset", "team_id", "period", "post"), ["pool", "ruleset", "team_id", "period"], "left")
    end = F.last_day("period") if unit == "month" else F.date_add("period", 6)
    return filled.select("pool", "team_id", F.when(F.col("period") == F.col("b"), F.col("last_date")).otherwise(end).alias("point_date"), F.round(F.last("post", ignorenulls=True).over(upto), 2).alias("elo"), F.col("post").isNull().alias("filled"))


def date_index(history: DataFrame) -> DataFrame:
    """Dates of a pool with their place among its different dates."""
    dates = history.select("pool", "game_date").distinct()
    return dates.select("pool", "game_date", F.dense_rank().over(Window.partitionBy("pool").orderBy("game_date")).alias("date_index"))


def nearest_point(history: DataFrame, day: date) -> DataFrame:
    """Each team's row nearest to a day, the earlier of equals."""
    far = F.struct(F.abs(F.datediff("game_date", F.lit(day))).alias("d"), F.col("game_date").alias("g"), F.col("game_id").alias("i"))
    return history.groupBy("pool", "ruleset", "team_id").agg(F.min_by(F.struct("game_date", "game_id", F.round("post", 2).alias("elo")), far).alias("p")).select("pool", "team_id", "p.*")


def explain(games: DataFrame, history: DataFrame, teams: DataFrame, competitions: DataFrame) -> DataFrame:
    """How each game moved its teams: names, both ratings before, expectation, multiplier and change."""
    t = teams.select("team_id", "team_name")
    home = history.filter("is_home").select("pool", "ruleset", "game_id", F.col("pre").alias("home_pre"), "expected", "multiplier", "change")
    away = history.filter("not is_home").select("pool", "ruleset", "game_id", F.col("pre").alias("away_pre"))
    return (
        games.join(home, ["pool", "game_id"]).join(away, ["pool", "ruleset", "game_id"])
        .join(competitions.select("competition_id", "competition_name"), "competition_id")
        .join(t.withColumnsRenamed({"team_id": "home_id", "team_name": "home_name"}), "home_id").join(t.withColumnsRenamed({"team_id": "away_id", "team_name": "away_name"}), "away_id")
        .select("game_id", "competition_name", "home_name", "away_name", "home_score", "away_score", F.round("home_pre", 2).alias("home_pre"), F.round("away_pre", 2).alias("away_pre"),
                F.round("expected", 4).alias("expected"), F.round("multiplier", 4).alias("multiplier"), F.round("change", 2).alias("change"))
    )


def upcoming(games: DataFrame, snapshot: DataFrame, least: int = 0) -> DataFrame:
    """Games without a result beside both teams' ratings (which may be missing) and their gap."""
    elo = snapshot.select("pool", "team_id", "elo")
    home, away = (elo.withColumnsRenamed({"team_id": f"{s}_id", "elo": f"{s}_elo"}) for s in ("home", "away"))
    open_ = games.filter("status = 'scheduled' and home_score is null")
    return open_.join(home, ["pool", "home_id"], "left").join(away, ["pool", "away_id"], "left").select(
        "game_id", "game_date", "home_id", "away_id", "home_elo", "away_elo", F.round(F.col("home_elo") - F.col("away_elo"), 2).alias("gap")
    )


def page(rows: DataFrame, order: list, number: int, size: int, total: int, sizes: tuple[int, int] = (10, 100)) -> DataFrame:
    """One page in the given order; page number and size are brought into range."""
    size = clamp(size, *sizes)
    number = clamp(number, 1, max(1, -(-total // size)))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
