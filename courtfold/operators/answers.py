"""Composed answers: the games browser with names, options and summary, team detail, and coverage by eras."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_called_off, is_finished, same_country, start_year
from . import games as G
from . import rankings as R

#: First and last starting year of an era and the least games of a complete season in it. Fixed values.
ERAS = (
    (1946, 1946, 340), (1947, 1947, 200), (1948, 1948, 370), (1949, 1949, 540), (1950, 1960, 280), (1961, 1965, 340), (1966, 1975, 420), (1976, 1979, 850), (1980, 1987, 900),
    (1988, 1997, 1000), (1998, 1998, 760), (1999, 2003, 1180), (2004, 2010, 1250), (2011, 2011, 1020), (2012, 2018, 1250), (2019, 2019, 1080), (2020, 2020, 1100), (2021, 9999, 1250),
)
#: What the reasons say. Fixed values.
EXCLUDED, NO_SCORE, STALE = "Excluded from ELO", "Finished game is missing a score", "Game date is more than two days old but status is not finished"


def least_games(season: Column) -> Column:
    """Least games of a complete season by its era; null before the first one."""
    eras = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit(n).alias("least")) for a, b, n in ERAS])
    return F.get(F.filter(eras, lambda e: start_year(season).between(e["first"], e["last"])), F.lit(0))["least"]


def low_by_era(coverage: DataFrame, by_era: Column) -> DataFrame:
    """Coverage rows whose `low` goes by eras where by_era holds: fewer games than the era's least, and never where no era is known."""
    return coverage.withColumn("low", F.when(by_era, F.coalesce(F.col("n") < least_games(F.col("season")), F.lit(False))).otherwise(F.col("low")))


def named_games(games: DataFrame, teams: DataFrame, competitions: DataFrame, as_of: Column) -> DataFrame:
    """Games with the names of teams, league and country and the list of reasons to review them; a name that isn't known is null.

    games may have a column exclusion_reason, which goes into the reason.
    """
    t = teams.select("team_id", "team_name")
    home, away = (t.withColumnsRenamed({"team_id": f"{s}_id", "team_name": f"{s}_team"}) for s in ("home", "away"))
    league = competitions.select("competition_id", F.col("competition_name").alias("league"), "country")
    done = is_finished(F.col("status"))
    because = F.nullif(F.trim("exclusion_reason"), F.lit("")) if "exclusion_reason" in games.columns else F.lit(None).cast("string")
    reasons = F.array_compact(F.array(
        F.when(~F.col("eligible"), F.concat_ws(": ", F.lit(EXCLUDED), because)), F.when(done & (F.col("home_score").isNull() | F.col("away_score").isNull()), NO_SCORE),
        F.when(~done & (F.col("game_date") < F.date_sub(as_of, 2)), STALE),
    ))
    return games.join(league, "competition_id", "left").join(home, "home_id", "left").join(away, "away_id", "left").withColumn(
        "reasons", F.when(is_called_off(F.col("status")), F.array().cast("array<string>")).otherwise(reasons))


def browse(
    named: DataFrame, *, country: str | None = None, source: str | None = None, league: str | None = None, season: str | None = None, year: int | None = None, status: str | None = None,
    team_id: int | None = None, team: str | None = None, search: str | None = None, first: date | None = None, last: date | None = None,
) -> DataFrame:
    """Named games by every filter that isn't blank: a team by id, or else by a pattern of either name; search in both names, league, season and status, where % and _ stay wildcards.

    All filters are on one row, so games are scanned once and those on their own columns reach the scan.
    """
    kept = G.filtered(named, source=source, status=status, league=league.strip() if league else None)
    if country and country.strip():
        kept = kept.filter((F.col("country") == country) | same_country(F.col("country"), F.lit(country)))
    if season and season.strip():
        kept = kept.filter(G.season_matches(F.col("season"), season))
    if year is not None and 1 <= year <= 9998:
        kept = kept.filter(G.in_year(F.col("game_date"), year))
    holds = lambda text, *cols: F.coalesce(F.greatest(*[F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in cols]), F.lit(False))
    if team_id is not None:
        kept = kept.filter((F.col("home_id") == team_id) | (F.col("away_id") == team_id))
    elif team and team.strip():
        kept = kept.filter(holds(team, "home_team", "away_team"))
    if search and search.strip():
        kept = kept.filter(holds(search, "home_team", "away_team", "league", "season", "status"))
    return kept.filter(G.between_days(F.col("game_date"), first, last))


def browse_summary(named: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: all games, and of those kept their number, how many are finished, open and to review, and the first and last day."""
    done = is_finished(F.col("status"))
    own = kept.agg(
        F.count("*").alias("n_kept"), F.count_if(done).alias("n_finished"), F.count_if(~done).alias("n_open"), F.count_if(F.size("reasons") > 0).alias("n_review"),
        F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"),
    )
    return named.agg(F.count("*").alias("n_all")).join(own, F.lit(True))  # one row each


def browse_options(named: DataFrame) -> DataFrame:
    """(kind, value, n): what each filter of the browser can take, with the games it would leave; blanks are no options."""
    kinds = {"country": F.col("country"), "league": F.col("league"), "season": F.col("season"), "source": F.col("source"), "status": F.col("status"), "year": F.year("game_date").cast("string")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("o")
    return named.select(pairs).select("o.*").filter("trim(value) <> ''").groupBy("kind", "value").agg(F.count("*").alias("n"))


def team_detail(history: DataFrame, snapshot: DataFrame, games: DataFrame, teams: DataFrame, competitions: DataFrame, current: DataFrame) -> DataFrame:
    """A row for each rated team of a pool: name, country, rating, rank, games, last change and day, whether it is current, its leagues in order, and its form of five and ten games.

    The rank is one more than the number of current teams rated higher, whether the team itself is current or not. A pool's teams are one group of that window.
    """
    keys = ["pool", "ruleset", "team_id"]
    known = snapshot.join(current.select("pool", "team_id", F.lit(True).alias("is_current")), ["pool", "team_id"], "left").fillna(False, ["is_current"])
    is_current = F.col("is_current").cast("int")
    upto = Window.partitionBy("pool", "ruleset").orderBy(F.desc("elo")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = known.withColumn("rank", 1 + F.sum(is_current).over(upto) - F.sum(is_current).over(Window.partitionBy("pool", "ruleset", "elo")))
    league = games.select("pool", "game_id", "competition_id").join(competitions.select("competition_id", "competition_name"), "competition_id")
    played = history.select(*keys, "game_id").join(league, ["pool", "game_id"]).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("competition_name")), ", ").alias("leagues"))
    day = history.groupBy(*keys).agg(F.max("game_date").alias("last_day"))
    forms = [R.form(history, n).select(*keys, F.concat_ws("-", "wins", "losses").alias(f"form_{n}"), F.col("change").alias(f"change_{n}")) for n in (5, 10)]
    out = ranked.join(teams.select("team_id", "team_name", "country"), "team_id").join(day, keys).join(R.latest_change(history), keys, "left").join(played, keys, "left")
    for form in forms:
        out = out.join(form, keys, "left")
    return out.select("pool", "ruleset", "team_id", "team_name", "country", "elo", "rank", "games", "latest_change", "last_day", "is_current", "leagues", "form_5", "change_5", "form_10", "change_10")
