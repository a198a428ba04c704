"""Deliveries ingested as one plan: what each row becomes, and the tables of games, seasons and reviews after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact_name
from .changes import first_wins
from .store import kept

#: Hours between two sources' times of one game.
HOURS = 36
PLACE = ["source", "source_game_id", "competition_id", "season", "game_ts", "home_id", "away_id"]
RESULT = ["home_score", "away_score", "status", "round_name", "eligible", "exclusion_reason"]
GAMES = ["game_id", *PLACE, *RESULT, "manual"]


def nearest_in_time(rows: DataFrame, others: DataFrame, keys: list[str], hours: int = HOURS, apart: str | None = "source") -> DataFrame:
    """(row_id, other_id, distance, ambiguous): each row's one nearest of the others with equal keys within hours, none where several are equally near.

    rows(row_id, ts, keys, apart), others(other_id, ts, keys, apart); a column `apart` must differ. Others of one instant are counted first, and each row finds the nearest instants before and
    after it in a window, so no pairs are formed however many play at a time. Windows are dealt by keys and stretch of hours, so what plays often doesn't meet in one task.
    """
    step = hours * 3600
    own = [apart] if apart else []
    r = rows.select("row_id", F.unix_seconds("ts").alias("s"), *keys, *own).dropna(subset=["s", *keys, *own])
    o = others.select("other_id", F.unix_seconds("ts").alias("s"), *keys, *own).dropna(subset=["s", *keys, *own])
    told = o.groupBy(*keys, "s", *own).agg(F.count("*").alias("n"), F.min("other_id").alias("other_id"))
    # an instant's one value of `apart`, null if it has several or none is asked for, and the nearest instants on both sides that have another
    one = F.when(F.count("*") == 1, F.min(apart)) if apart else F.lit(None).cast("string")
    times = told.groupBy(*keys, "s").agg(one.alias("one")).withColumn("stretch", F.explode(F.array(*[F.floor(F.col("s") / step) + k for k in (-1, 0, 1)])))
    forth, back = (Window.partitionBy(*keys, "stretch").orderBy(order) for order in (F.col("s"), F.desc("s")))
    for name, w in (("earlier", forth), ("later", back)):
        other = ~F.col("one").eqNullSafe(F.lag("one").over(w))
        times = times.withColumn("_last", F.when(other, F.lag("s").over(w))).withColumn(name, F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_last")
    points = times.select(*keys, "stretch", "s", F.struct("s", "one", "earlier", "later").alias("t"))
    asked = r.withColumn("stretch", F.floor(F.col("s") / step))
    both = asked.unionByName(points, allowMissingColumns=True)
    for name, w in (("_b", forth), ("_a", back)):
        both = both.withColumn(name, F.last("t", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    side = lambda c, far: F.when(F.col(f"{c}.one") == F.col(apart), F.col(f"{c}.{far}")).otherwise(F.col(f"{c}.s")) if apart else F.col(f"{c}.s")
    met = both.filter("t is null").withColumns({"_b": side("_b", "earlier"), "_a": side("_a", "later")})
    met = met.withColumn("distance", F.least(F.col("s") - F.col("_b"), F.col("_a") - F.col("s"))).filter(F.col("distance") <= step)
    hits = F.array_distinct(F.filter(F.array("_b", "_a"), lambda x: F.abs(x - F.col("s")) == F.col("distance")))
    near = met.select("row_id", "distance", *keys, *([F.col(apart).alias("_apart")] if apart else []), F.explode(hits).alias("s")).join(told, [*keys, "s"])
    if apart:
        near = near.filter(F.col(apart) != F.col("_apart"))
    return near.groupBy("row_id").agg(
        F.when(F.sum("n") == 1, F.min("other_id")).alias("other_id"), F.min("distance").alias("distance"), (F.sum("n") > 1).alias("ambiguous"))


def claimed(near: DataFrame) -> DataFrame:
    """Of nearest_in_time() rows that found the same other one the nearest, the first by row_id of equals; the ambiguous ones, too. The rest found nothing."""
    w = Window.partitionBy("other_id").orderBy("distance", "row_id")
    one = near.filter("not ambiguous").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return one.unionByName(near.filter("ambiguous"))


def _new_id(*parts: str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def duplicates_of(rows: DataFrame, games: DataFrame, teams: DataFrame) -> DataFrame:
    """Rows of which games holds one from another source: same season, day and scores (null equal to null), and on each side the same team or one of the same country."""
    def sided(df):
        for side in ("home", "away"):
            df = df.join(teams.select(F.col("team_id").alias(f"{side}_id"), F.col("country").alias(f"{side}_country")), f"{side}_id", "left")
        return df.withColumn("day", F.to_date("game_ts"))

    cols = ["source", "season", "day", "home_score", "away_score", "home_id", "away_id", "home_country", "away_country"]
    g = sided(games).select(*[F.col(c).alias(f"g_{c}") for c in cols])
    side = lambda s: (F.col(f"{s}_id") == F.col(f"g_{s}_id")) | (F.col(f"{s}_country") == F.col(f"g_{s}_country"))
    same = F.col("season").eqNullSafe(F.col("g_season")) & (F.col("day") == F.col("g_day"))
    for c in ("home_score", "away_score"):
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    found = sided(rows).join(g, same & (F.col("source") != F.col("g_source")) & side("home") & side("away"), "left_semi")
    return found.select(*rows.columns)


def backfill_outcomes(games: DataFrame, delivery: DataFrame, teams: DataFrame, live: str = "live", hours: int = HOURS) -> DataFrame:
    """The delivery's rows, one an id (the last by row_no), with outcome and game_id.

    In this order a row is: updated, where games holds its source and id; reconciled with the one nearest game of the live source, of the same competition and teams and within hours, or
    ambiguous where several are equally near, which nothing takes; duplicate, see duplicates_of(); or inserted. Of rows that would
    reconcile with one game the nearest does; rows of the live source never do. delivery(PLACE, home_score, away_score, status, round_name, exclusion_reason, row_no).
    """
    keys = ["source", "source_game_id"]
    rows = first_wins(delivery, keys, [F.desc("row_no")]).withColumn("row_id", F.struct(*keys))
    rows = kept(rows.join(games.select(*keys, F.col("game_id").alias("own_id")), keys, "left"))
    others = games.filter(F.col("source") == live).select(F.col("game_id").alias("other_id"), F.col("game_ts").alias("ts"), "competition_id", "home_id", "away_id")
    free = rows.filter(F.col("own_id").isNull() & (F.col("source") != live)).withColumn("ts", F.col("game_ts"))
    found = claimed(kept(nearest_in_time(free, others, ["competition_id", "home_id", "away_id"], hours, None))).drop("distance")
    rows = rows.join(found, "row_id", "left")
    rest = rows.filter("own_id is null and other_id is null and not coalesce(ambiguous, false)")
    known = duplicates_of(rest, games, teams).select("row_id", F.lit(True).alias("known"))
    rows = rows.join(known, "row_id", "left")
    outcome = (
        F.when(F.col("own_id").isNotNull(), "updated").when(F.col("ambiguous"), "ambiguous").when(F.col("other_id").isNotNull(), "reconciled")
        .when(F.col("known"), "duplicate").otherwise("inserted")
    )
    game = F.coalesce("own_id", "other_id", F.when(outcome == "inserted", _new_id(*keys)))
    return kept(rows.withColumns({"outcome": outcome, "game_id": game})).drop("row_id", "own_id", "other_id", "ambiguous", "known")


def _applied(games: DataFrame, changes: DataFrame, kept_result: Column, kept_place: Column, moved: list[str]) -> DataFrame:
    """games with changes(GAMES, outcome): rows by game_id, results and the columns `moved` of a place staying where their condition over o and n holds; inserted rows added."""
    o = games.select(F.struct(*GAMES).alias("o"))
    n = changes.filter("outcome in ('updated', 'reconciled')").select(F.struct(*GAMES, "outcome").alias("n"))
    joined = o.join(n, F.col("o.game_id") == F.col("n.game_id"), "left")
    none = F.col("n").isNull()
    stays = {c: F.coalesce(kept_result, F.lit(False)) for c in RESULT} | {c: F.coalesce(kept_place, F.lit(False)) for c in moved} | {c: F.lit(True) for c in ("game_id", "manual")}
    out = joined.select(*[F.when(none | stays.get(c, F.lit(False)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in GAMES])
    return out.unionByName(changes.filter("outcome = 'inserted'").select(*GAMES))


def _with_seasons(seasons: DataFrame, rows: DataFrame) -> DataFrame:
    """seasons(competition_id, season) and those that rows need besides."""
    need = rows.select("competition_id", "season").distinct()
    return seasons.unionByName(need.join(seasons, ["competition_id", "season"], "left_anti"))


def backfill(games: DataFrame, delivery: DataFrame, teams: DataFrame, seasons: DataFrame, live: str = "live", hours: int = HOURS) -> dict[str, DataFrame]:
    """games, seasons and outcomes after a delivery of past games; see backfill_outcomes().

    Places are always the delivery's, the source's id of a reconciled game too. A result set by hand stays, and that of a finished game which a schedule without
    scores was reconciled with. The same delivery again changes nothing, unless an ambiguous row has become clear.
    """
    out = backfill_outcomes(games, delivery, teams, live, hours)
    new = out.withColumns({"eligible": F.col("exclusion_reason").isNull(), "manual": F.lit(False)})
    unplayed = (F.col("n.status") == "scheduled") & F.col("n.home_score").isNull() & F.col("n.away_score").isNull()
    stays = F.col("o.manual") | ((F.col("n.outcome") == "reconciled") & (F.col("o.status") == "finished") & unplayed)
    return {
        "games": _applied(games, new, stays, F.lit(False), []), "seasons": _with_seasons(seasons, out.filter("outcome in ('updated', 'reconciled', 'inserted')")),
        "outcomes": out.select("source", "source_game_id", "outcome", "game_id"),
    }


def _resolved(rows: DataFrame, aliases: DataFrame, side: str, source: str) -> DataFrame:
    """rows with <side>_id and <side>_reason: the one team of the source's id, else the one of the name in the competition's country."""
    by_id = aliases.filter(F.col("source") == source).groupBy(F.col("source_team_id").alias(f"{side}_source_id")).agg(
        F.when(F.count_distinct("team_id") == 1, F.min("team_id")).alias("_by_id"))
    by_name = aliases.groupBy(F.col("country").alias("competition_country"), compact_name(F.col("alias_name")).alias("_name")).agg(
        F.count_distinct("team_id").alias("_n"), F.min("team_id").alias("_by_name"))
    out = rows.withColumn("_name", compact_name(F.col(side))).join(by_id, f"{side}_source_id", "left").join(by_name, ["competition_country", "_name"], "left")
    reason = F.when(F.col(f"{side}_id").isNotNull(), None).when(F.col("_n") > 1, f"ambiguous_{side}_team").otherwise(f"unresolved_{side}_team")
    return out.withColumn(f"{side}_id", F.coalesce("_by_id", F.when(F.col("_n") == 1, F.col("_by_name")))).withColumn(f"{side}_reason", reason).drop("_name", "_by_id", "_by_name", "_n")


def daily_outcomes(
    games: DataFrame, candidates: DataFrame, reviews: DataFrame, competitions: DataFrame, aliases: DataFrame, source: str, hours: int = HOURS,
) -> DataFrame:
    """The candidates, one an id (the last by row_no), with their competition, teams, season, outcome, game_id and all reasons, joined.

    In this order a candidate is: review, where its competition is unknown; skipped, where that is inactive; review, where a team isn't known for certain or a finished
    game lacks scores; ignored, where its review says so; updated, where games holds its id; reconciled with the game that a review assigned, or with the one nearest game of
    another source that is scheduled for the same competition and teams within hours; review, where several are equally near; or inserted. Seasons begin in July.

    candidates(source_game_id, country, competition, game_ts, home, away, home_source_id, away_source_id, home_score, away_score, status, stage, row_no),
    reviews(source_game_id, status, reasons, assigned_game_id), competitions(competition_id, competition_name, country, active), aliases(team_id, source, source_team_id, alias_name, country).
    """
    named = competitions.select(
        "competition_id", "active", F.col("country").alias("competition_country"), F.lower(F.trim("competition_name")).alias("_competition"), F.lower(F.trim("country")).alias("_country"))
    rows = first_wins(candidates, ["source_game_id"], [F.desc("row_no")]).withColumns({"_competition": F.lower(F.trim("competition")), "_country": F.lower(F.trim("country"))})
    rows = rows.join(named, ["_competition", "_country"], "left").drop("_competition", "_country")
    rows = _resolved(_resolved(rows, aliases, "home", source), aliases, "away", source)
    scores = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    start = F.year("game_ts") - F.when(F.month("game_ts") < 7, 1).otherwise(0)
    invalid = F.when((F.col("status") == "finished") & ~scores, "invalid_result")
    rows = rows.withColumns({
        "source": F.lit(source), "season": F.concat_ws("-", start.cast("string"), (start + 1).cast("string")), "row_id": F.col("source_game_id"), "ts": F.col("game_ts"),
        "reasons": F.when(F.col("competition_id").isNull(), "unknown_competition").otherwise(F.concat_ws(",", "home_reason", "away_reason", invalid)),
    })
    own = games.filter(F.col("source") == source).select("source_game_id", F.col("game_id").alias("own_id"))
    told = reviews.select("source_game_id", F.col("status").alias("review_status"), "assigned_game_id")
    assigned = games.select(F.col("game_id").alias("assigned_game_id"), F.col("game_id").alias("assigned_id"))
    rows = kept(rows.join(own, "source_game_id", "left").join(told, "source_game_id", "left").join(assigned, "assigned_game_id", "left"))
    fixed = F.coalesce("own_id", "assigned_id")
    ready = (F.col("reasons") == "") & F.col("active") & (F.coalesce("review_status", F.lit("")) != "ignored")
    planned = games.filter("status = 'scheduled'").select(F.col("game_id").alias("other_id"), F.col("game_ts").alias("ts"), "source", "competition_id", "home_id", "away_id")
    found = claimed(kept(nearest_in_time(rows.filter(ready & fixed.isNull()), planned, ["competition_id", "home_id", "away_id"], hours))).drop("distance")
    rows = rows.join(found, "row_id", "left")
    outcome = (
        F.when(F.col("competition_id").isNull(), "review").when(~F.col("active"), "skipped").when(F.col("reasons") != "", "review").when(F.col("review_status") == "ignored", "ignored")
        .when(F.col("own_id").isNotNull(), "updated").when(F.col("assigned_id").isNotNull(), "reconciled").when(F.col("ambiguous"), "review").when(F.col("other_id").isNotNull(), "reconciled")
        .otherwise("inserted")
    )
    reasons = F.when(F.col("reasons") != "", F.col("reasons")).when(F.col("ambiguous"), "ambiguous_planned_fixture")
    game = F.coalesce("own_id", "assigned_id", "other_id", F.when(outcome == "inserted", _new_id("source", "source_game_id")))
    out = rows.withColumns({"outcome": outcome, "game_id": F.when(outcome.isin("updated", "reconciled", "inserted"), game), "reasons": F.when(outcome == "review", reasons)})
    return kept(out).drop("row_id", "ts", "own_id", "assigned_id", "assigned_game_id", "other_id", "ambiguous", "home_reason", "away_reason", "active", "competition_country")


def daily(
    games: DataFrame, candidates: DataFrame, reviews: DataFrame, competitions: DataFrame, aliases: DataFrame, seasons: DataFrame, source: str, hours: int = HOURS,
) -> dict[str, DataFrame]:
    """games, seasons, reviews and outcomes after a day's candidates; see daily_outcomes().

    A result set by hand stays, and a reconciled game keeps its source and id. Games that aren't finished don't count, and say so unless they are scheduled. What
    couldn't be taken is an open review with its reasons; one that was ignored stays so unless its competition isn't known. A candidate that was taken resolves its open
    review, and a reconciled one leaves a resolved review that names its game, so that the same candidates again change nothing.
    """
    out = daily_outcomes(games, candidates, reviews, competitions, aliases, source, hours)
    final = (F.col("status") == "finished") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    new = out.withColumns({
        "eligible": final, "exclusion_reason": F.when(~final & (F.col("status") != "scheduled"), "current_result_not_final"), "round_name": F.col("stage"), "manual": F.lit(False),
    })
    moved = _applied(games, new, F.col("o.manual"), F.col("n.outcome") == "reconciled", ["source", "source_game_id"])
    told = out.select(
        "source_game_id", F.col("outcome").alias("_outcome"), F.col("reasons").alias("_reasons"), F.when(F.col("outcome") == "reconciled", F.col("game_id")).alias("_game"))
    both = reviews.join(told, "source_game_id", "full_outer").filter("status is not null or _outcome in ('review', 'reconciled')")
    held = (F.col("_outcome") == "review") & ~((F.col("status") == "ignored").eqNullSafe(True) & (F.col("_reasons") != "unknown_competition"))
    taken = F.col("_outcome").isin("updated", "reconciled", "inserted")
    status = F.when(held, "open").when(taken & (F.col("status").isNull() | (F.col("status") == "open")), "resolved").otherwise(F.coalesce("status", F.lit("open")))
    after = both.select(
        "source_game_id", status.alias("status"), F.when(F.col("_outcome") == "review", F.col("_reasons")).otherwise(F.col("reasons")).alias("reasons"),
        F.coalesce("_game", "assigned_game_id").alias("assigned_game_id"))
    return {
        "games": moved, "seasons": _with_seasons(seasons, out.filter("outcome in ('updated', 'reconciled', 'inserted')")), "reviews": after,
        "outcomes": out.select("source_game_id", "outcome", "game_id", "reasons"),
    }
