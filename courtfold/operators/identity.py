"""Matching of games and teams across sources: nearest fixtures, duplicates, similar names, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SIMILAR, compact_name, full_season, similar
from .ingest import HOURS, nearest_in_time
from .store import dealt, kept


def nearest_fixture(results: DataFrame, fixtures: DataFrame, hours: int = HOURS) -> DataFrame:
    """Each result with the one nearest game of another source that is scheduled in the same competition for the same teams, within hours; `ambiguous` where several are equally near.

    results(feed_id, feed_ts, source, competition_id, home_id, away_id), fixtures(game_id, game_ts, source, competition_id, home_id, away_id, status); distances are in seconds.
    """
    keys = ["competition_id", "home_id", "away_id"]
    rows = results.withColumnsRenamed({"feed_id": "row_id", "feed_ts": "ts"})
    planned = fixtures.filter("status = 'scheduled'").withColumnsRenamed({"game_id": "other_id", "game_ts": "ts"})
    return nearest_in_time(rows, planned, keys, hours).withColumnsRenamed({"row_id": "feed_id", "other_id": "game_id"})


def same_day_duplicates(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Pairs of games of two sources in one season, on one day with the same scores, and on each side the same team or one of the same country."""
    a = games.filter("home_score is not null and away_score is not null").select("game_id", "source", "season", "game_date", "home_score", "away_score", "home_id", "away_id")
    for side in ("home", "away"):
        a = a.join(teams.select(F.col("team_id").alias(f"{side}_id"), F.col("country").alias(f"{side}_country")), f"{side}_id", "left")
    keys = ["season", "game_date", "home_score", "away_score"]
    b = a.select(*keys, *[F.col(c).alias(f"other_{c}") for c in ("source", "home_id", "away_id", "home_country", "away_country")], F.col("game_id").alias("other_id"))
    same = lambda side: (F.col(f"{side}_id") == F.col(f"other_{side}_id")) | (F.col(f"{side}_country") == F.col(f"other_{side}_country"))
    pairs = a.join(b, keys).filter("game_id < other_id and source <> other_source").filter(same("home") & same("away"))
    return pairs.select("game_id", "other_id", "game_date")


def near_duplicates(games: DataFrame, days: int) -> DataFrame:
    """Pairs of one competition within days, same teams in either order, where each is the other's best: nearest, then with the same scores, then lowest id.

    What is a game's best is what the game is to others, so each game's one best is found from its nearest days and no other pair is formed.
    """
    lo, hi = F.least("home_id", "away_id"), F.greatest("home_id", "away_id")
    low_score = F.when(F.col("home_id") < F.col("away_id"), F.col("home_score")).otherwise(F.col("away_score"))
    high_score = F.when(F.col("home_id") < F.col("away_id"), F.col("away_score")).otherwise(F.col("home_score"))
    own = kept(games.filter("home_score is not null and source is not null and game_date is not null and competition_id is not null").select(
        "game_id", "source", F.unix_date("game_date").alias("day"), "competition_id", lo.alias("lo"), hi.alias("hi"), low_score.alias("ls"), high_score.alias("hs")))
    keys = ["competition_id", "lo", "hi"]
    near = kept(own.join(_near_days(own, keys, days), [*keys, "day", "source"]))
    theirs = [F.col(c).alias(f"other_{c}") for c in ("ls", "hs")]
    whole = F.col("ls").isNotNull() & F.col("hs").isNotNull()
    other = lambda id_: id_.withColumnRenamed("day", "at")
    # the lowest game of another source that day with these scores, that day at all, and of games without both scores, which are rare, each with its own
    equal = near.filter(whole).join(other(_two_lowest(own.filter(whole), [*keys, "day", "ls", "hs"])), [*keys, "at", "ls", "hs"]).withColumn("score_match", F.lit(1))
    any_ = near.filter(whole).join(other(_two_lowest(own.filter(whole), [*keys, "day"])), [*keys, "at"]).withColumn("score_match", F.lit(0))
    part = _two_lowest(own, [*keys, "day", "ls", "hs"]).select(*keys, F.col("day").alias("at"), *theirs, "lowest", "second")
    open_ = near.filter(~whole).join(part, [*keys, "at"]).unionByName(near.filter(whole).join(part.filter("other_ls is null or other_hs is null"), [*keys, "at"]))
    open_ = open_.withColumn("score_match", ((F.col("ls") == F.col("other_ls")) & (F.col("hs") == F.col("other_hs"))).cast("int")).drop("other_ls", "other_hs")
    found = equal.unionByName(any_).unionByName(open_)
    found = found.withColumn("other_id", F.when(F.col("lowest.source") != F.col("source"), F.col("lowest.game_id")).otherwise(F.col("second.game_id"))).filter("other_id is not null")
    best = F.min(F.struct("distance", F.coalesce(1 - F.col("score_match"), F.lit(2)).alias("less"), "other_id", "score_match"))
    first = kept(found.groupBy("game_id").agg(best.alias("m")).select("game_id", "m.*"))
    back = first.select(F.col("game_id").alias("other_id"), F.col("other_id").alias("game_id"), "distance", "less")
    return first.filter("game_id < other_id").join(back, ["game_id", "other_id", "distance", "less"]).select("game_id", "other_id", "distance", "score_match")


def _two_lowest(games: DataFrame, by: list[str]) -> DataFrame:
    """(by, lowest, second): the lowest game_id with its source, and the lowest one of any other source; whatever a game's source, one of them is the lowest of another source."""
    each = games.groupBy(*by, "source").agg(F.min("game_id").alias("game_id"))
    w = Window.partitionBy(*by).orderBy("game_id", "source")
    two = each.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    x = F.struct("game_id", "source")
    return two.groupBy(*by).agg(F.min(F.when(F.col("rn") == 1, x)).alias("lowest"), F.min(F.when(F.col("rn") == 2, x)).alias("second"))


def _near_days(games: DataFrame, keys: list[str], days: int) -> DataFrame:
    """(keys, day, source, at, distance): for the games of a day and source the nearest days, at most two and within days, on which another source has one.

    Days are met in order: only the days of a run with one and the same source are passed over for that source, so the last day before the run is the one sought.
    """
    by_day = games.groupBy(*keys, "day").agg(F.min("source").alias("a"), F.max("source").alias("b")).withColumn("only", F.when(F.col("a") == F.col("b"), F.col("a")))
    in_order = Window.partitionBy(*keys).orderBy("day")
    sides = by_day
    for name, w in (("before", in_order), ("after", Window.partitionBy(*keys).orderBy(F.desc("day")))):
        # a run begins where the day passed last isn't of this one source; the day passed last then is the nearest of another source for all of the run
        begins = F.lag("day").over(w).isNull() | F.col("only").isNull() | F.lag("only").over(w).isNull() | (F.lag("only").over(w) != F.col("only"))
        sides = sides.withColumns({f"{name}_last": F.lag("day").over(w), f"{name}_begins": begins, f"{name}_only": F.lag("only").over(w)})
        sides = sides.withColumn(f"{name}_run", F.last(F.when(F.col(f"{name}_begins"), F.struct(F.col(f"{name}_last").alias("d"))), ignorenulls=True).over(w))
        sides = sides.withColumn(f"{name}_skip", F.lag(f"{name}_run").over(w)["d"])
    own = games.select(*keys, "day", "source").distinct().join(sides, [*keys, "day"])
    at = lambda s: F.when(F.col(f"{s}_only") == F.col("source"), F.col(f"{s}_skip")).otherwise(F.col(f"{s}_last"))
    same = F.when(F.col("only").isNull(), F.col("day"))
    seen = own.select(*keys, "day", "source", F.explode(F.array_compact(F.array_distinct(F.array(same, at("before"), at("after"))))).alias("at")).withColumn("distance", F.abs(F.col("at") - F.col("day")))
    least = F.min("distance").over(Window.partitionBy(*keys, "day", "source"))
    return seen.filter(F.col("distance") <= days).withColumn("least", least).filter("distance = least").drop("least")


def _blocks(name: Column) -> Column:
    """Runs of four characters of a compact name, or a shorter name itself: two similar() names share one.

    A name that holds another holds its runs; names that differ by at most 14 % differ by no change up to 7 characters, by one up to 14 and so on, and each
    change touches four of the length - 3 runs.
    """
    n = F.length(name) - 3
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.substring(name, p, 4))).otherwise(F.array(name)))


def rarest_blocks(names: DataFrame) -> DataFrame:
    """(name, blocks, prefix) of names(name): all runs of each name, and its rarest ones by their number of names: four for each change that a similar name may have, and one more.

    Of two names within k changes each lacks at most 4 k of the other's runs, so the first 4 k + 1 runs of both, in one order, have one in common. A partner is longer by 1 / 0.86 at most.
    """
    runs = names.select("name").distinct().select("name", F.explode(_blocks(F.col("name"))).alias("block"))
    counted = runs.join(dealt(runs.groupBy("block").agg(F.count("*").alias("n"))), "block")
    changes = F.floor((1 - SIMILAR) * F.floor(F.length("name") / SIMILAR + 1e-9) + 1e-9).cast("int")
    ordered = counted.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]).alias("blocks"))
    return ordered.withColumn("prefix", F.slice("blocks", F.lit(1), 4 * changes + 1))


def _runs(name: Column, size: Column) -> Column:
    """Different runs of so many characters of a name at least as long."""
    n = F.length(name) - size + 1
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda p: F.substr(name, p, size))).otherwise(F.array().cast("array<string>")))


def rarest_runs(names: DataFrame) -> DataFrame:
    """(name, shorter, longer, run) of names(name): keys of which two similar names of these two lengths, not equal, have one in common.

    Names of lengths `shorter` and `longer` are similar within k = 14 % of the longer changes. Of runs of q characters, where q is the shorter length over k + 1, k changes touch k q at most and
    leave one. Of both names' first k q + 1 runs, rarest first, one is therefore in common. Runs are as long as that allows (four at least), so the more names there are the less often they meet by chance.
    """
    n = F.length("name")
    longest = F.floor(n / SIMILAR + 1e-9).cast("int")
    shortest = F.ceil(n * SIMILAR - 1e-9).cast("int")
    lengths = F.concat(F.transform(F.sequence(n, longest), lambda x: F.struct(n.alias("shorter"), x.alias("longer"))), F.transform(F.sequence(shortest, n), lambda x: F.struct(x.alias("shorter"), n.alias("longer"))))
    each = names.select("name").distinct().filter(n >= 4).select("name", F.inline(F.array_distinct(lengths))).withColumn("k", F.floor((1 - SIMILAR) * F.col("longer") + 1e-9).cast("int")).filter("k > 0")
    each = each.withColumn("q", F.greatest(F.lit(4), F.floor(F.col("shorter") / (F.col("k") + 1)).cast("int")))
    runs = each.select("name", "q").distinct().select("name", "q", F.explode(_runs(F.col("name"), F.col("q"))).alias("run"))
    counted = runs.join(dealt(runs.groupBy("q", "run").agg(F.count("*").alias("n"))), ["q", "run"])
    ordered = counted.groupBy("name", "q").agg(F.array_sort(F.collect_list(F.struct("n", "run"))).alias("runs"))
    return each.join(dealt(ordered), ["name", "q"]).select("name", "shorter", "longer", F.explode(F.slice("runs", F.lit(1), F.col("k") * F.col("q") + 1)).alias("r")).select("name", "shorter", "longer", "r.run")


#: Names this long or longer are sought in others by runs of as many characters. Fixed value.
LONG = 8


def _held(names: DataFrame, size: int, own: Column) -> DataFrame:
    """(a, b): names b that hold a, another one for which `own` is true, met by a's rarest run of `size` characters."""
    runs = kept(names.select("name", F.explode(_runs(F.col("name"), F.lit(size))).alias("run")))
    counted = runs.filter(own).join(dealt(runs.groupBy("run").agg(F.count("*").alias("n"))), "run")
    first = counted.groupBy("name").agg(F.min(F.struct("n", "run")).alias("m")).select(F.col("name").alias("a"), "m.run")
    return first.join(dealt(runs.withColumnRenamed("name", "b")), "run").filter("a <> b and contains(b, a)").select("a", "b")


def similar_names(names: DataFrame) -> DataFrame:
    """(left_id, right_id, left_name, right_name) of names(team_id, name) of different teams that are similar.

    Names that differ meet by their rarest runs of characters, see rarest_runs(); a name that another holds meets it by its one rarest run. So a run that most names have brings together
    only those that have no rarer one.
    """
    every = kept(names.select("name").distinct().filter("name is not null"))
    keys = kept(rarest_runs(every))
    a, b = (keys.withColumnRenamed("name", x) for x in ("a", "b"))
    # the shorter name is on the left; of equally long ones the lower
    close = a.filter(F.length("a") == F.col("shorter")).join(dealt(b.filter(F.length("b") == F.col("longer"))), ["shorter", "longer", "run"]).filter("length(a) < length(b) or a < b").select("a", "b")
    inside = _held(every, 4, F.length("name").between(4, LONG - 1)).unionByName(_held(every, LONG, F.length("name") >= LONG))
    met = close.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().filter(similar(F.col("a"), F.col("b")))
    both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(every.select(F.col("name").alias("a"), F.col("name").alias("b")))
    left, right = names.withColumnsRenamed({"team_id": "left_id", "name": "left_name"}), names.withColumnsRenamed({"team_id": "right_id", "name": "right_name"})
    pairs = left.join(dealt(both), F.col("left_name") == F.col("a")).join(dealt(right), F.col("b") == F.col("right_name")).filter("left_id < right_id")
    return pairs.select("left_id", "right_id", "left_name", "right_name").distinct()


def similar_teams(aliases: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs of teams with similar names that appear in a common competition; a team without any game may be any other, as nothing tells them apart."""
    names = aliases.select("team_id", compact_name(F.col("alias_name")).alias("name")).distinct()
    pairs = similar_names(names).groupBy("left_id", "right_id").agg(F.count("*").alias("n_names"))
    seen = places.select("team_id", "competition_id").distinct()
    a, b = seen.withColumnRenamed("team_id", "left_id"), seen.withColumnRenamed("team_id", "right_id")
    common = pairs.join(dealt(a), "left_id").join(dealt(b), ["right_id", "competition_id"]).select("left_id", "right_id").distinct()
    teams = seen.select("team_id").distinct()
    lone = pairs.join(dealt(teams), pairs.left_id == teams.team_id, "left_anti").unionByName(pairs.join(dealt(teams), pairs.right_id == teams.team_id, "left_anti"))
    return pairs.join(dealt(common.unionByName(lone.select("left_id", "right_id")).distinct()), ["left_id", "right_id"], "left_semi")


#: Teams of a kind that are held in one row, about so many: two rows stand for their square of pairs. Fixed value.
TOGETHER = 2048


def _in_parts(members: DataFrame) -> DataFrame:
    """(kind, part, ids): the teams of members(kind, team_id) in rows of about TOGETHER, dealt by a hash, so no kind is one row or one task's sort."""
    n = members.groupBy("kind").agg(F.ceil(F.count("*") / TOGETHER).alias("n_parts"))
    part = F.pmod(F.xxhash64("team_id"), F.col("n_parts")).alias("part")
    return members.join(dealt(n), "kind").select("kind", "team_id", part).groupBy("kind", "part").agg(F.collect_list("team_id").alias("ids"))


def succeeding(spans: DataFrame, names: DataFrame, days: int = 370) -> DataFrame:
    """(earlier_id, later_id, gap): teams of one place where one begins 0 to `days` days after the other ended, and similar names, so that they may be one.

    spans(team_id, place, first, last), names(team_id, name) with compact names. Kinds of teams, which are those with equal spans and names, are paired; the pairs of teams come from
    their kinds without being grouped again. There are as many as rows asked for, so a million teams of few kinds give thousands of millions: they come from lists of teams, dealt evenly to a few
    tasks a core, and are shuffled no more.
    """
    spans_of = spans.groupBy("team_id").agg(F.array_sort(F.collect_set(F.struct("place", "first", "last"))).alias("spans"))
    names_of = names.groupBy("team_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    teams = spans_of.join(dealt(names_of), "team_id").withColumn("kind", F.sha2(F.to_json(F.struct("spans", "names")), 256))
    members = kept(_in_parts(teams.select("kind", "team_id")))
    kinds = kept(teams.groupBy("kind").agg(F.min(F.struct("spans", "names")).alias("x")).select("kind", "x.*"))
    named = kept(kinds.select("kind", F.explode("names").alias("name")))
    # each name stands for itself, so that kinds and names meet only by names that are alike
    one = named.select(F.col("name").alias("team_id"), "name").distinct()
    alike = similar_names(one).select("left_name", "right_name")
    own = one.select(F.col("name").alias("left_name"), F.col("name").alias("right_name"))
    alike = kept(alike.unionByName(alike.select(F.col("right_name").alias("left_name"), F.col("left_name").alias("right_name"))).unionByName(own))
    bounds = kinds.select("kind", F.inline("spans"))
    a = named.withColumnRenamed("name", "left_name").join(dealt(bounds), "kind").select(F.col("kind").alias("earlier"), "left_name", "place", "last").filter("last is not null")
    b = named.withColumnRenamed("name", "right_name").join(dealt(bounds), "kind").select(F.col("kind").alias("later"), "right_name", "place", "first").filter("first is not null")
    gap = F.datediff("first", "last")
    pairs = a.join(dealt(alike), "left_name").join(dealt(b), ["right_name", "place"]).withColumn("gap", gap).filter(F.col("gap").between(0, days)).groupBy("earlier", "later").agg(F.min("gap").alias("gap"))
    x, y = (members.select(F.col("kind").alias(k), F.col("part").alias(f"{k}_part"), F.col("ids").alias(f"{k}_ids")) for k in ("earlier", "later"))
    blocks = kept(pairs).join(dealt(x), "earlier").join(dealt(y), "later")
    blocks = blocks.repartition(4 * blocks.sparkSession.sparkContext.defaultParallelism, "earlier", "earlier_part", "later", "later_part")
    rows = blocks.select("gap", F.explode("earlier_ids").alias("earlier_id"), "later_ids").select("earlier_id", F.explode("later_ids").alias("later_id"), "gap")
    return rows.filter("earlier_id <> later_id")


def date_variants(games: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(game_id, other_id, distance) of games of two tables with equal keys at most a day apart, where each has just this one partner."""
    o = others.select("other_id", F.col("game_date").alias("other_date"), *keys).withColumn("day", F.explode(F.array(*[F.date_add("other_date", k) for k in (-1, 0, 1)])))
    pairs = games.select("game_id", F.col("game_date").alias("day"), *keys).join(o, ["day", *keys]).withColumn("distance", F.abs(F.datediff("day", "other_date")))
    n = pairs.withColumns({"a": F.count("*").over(Window.partitionBy("game_id")), "b": F.count("*").over(Window.partitionBy("other_id"))})
    return n.filter("a = 1 and b = 1").select("game_id", "other_id", "distance")


def within_season(rows: DataFrame, seasons: DataFrame, day: str) -> DataFrame:
    """Rows with the label of the season whose first to last day holds their day; met by year, so the join is an equality."""
    years = seasons.select("label", "first", "last", F.explode(F.sequence(F.year("first"), F.year("last"))).alias("y"))
    return rows.join(years, (F.year(day) == F.col("y")) & F.col(day).between(F.col("first"), F.col("last"))).drop("y", "first", "last")


def resolve_names(wanted: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted(want_id, name, year) with the team its name stands for: the name in its years, else at any time, else the compact name; the lowest alias of equals."""
    first = F.min(F.struct("alias_id", "team_id")).alias("f")
    # aliases count once for each name and span of years and wishes once for each name and year, so names that many have don't meet row by row
    spans = aliases.groupBy(F.col("alias_name").alias("known"), "valid_from", "valid_to").agg(first)
    asked = wanted.select("name", "year").distinct()
    inside = F.coalesce(F.col("valid_from") <= F.col("year"), F.lit(True)) & F.coalesce(F.col("valid_to") >= F.col("year"), F.lit(True))
    exact = asked.join(spans, F.col("name") == F.col("known")).select("name", "year", F.when(inside, 1).otherwise(2).alias("step"), "f")
    loose = asked.select("name", "year", compact_name(F.col("name")).alias("key")).join(spans.groupBy(compact_name(F.col("known")).alias("key")).agg(F.min("f").alias("f")), "key")
    steps = exact.unionByName(loose.select("name", "year", F.lit(3).alias("step"), "f"))
    best = steps.groupBy(F.col("name").alias("_name"), F.col("year").alias("_year")).agg(F.min(F.struct("step", "f")).alias("best"))
    own = wanted.join(best, (F.col("name") == F.col("_name")) & F.col("year").eqNullSafe(F.col("_year")), "left")
    return own.select("want_id", F.col("best.f.team_id").alias("team_id"), F.col("best.step").alias("step"))


def canonical_labels(seasons: DataFrame) -> DataFrame:
    """(competition_id, legacy, label): seasons under a single year's label that the competition also has in full."""
    full = seasons.select("competition_id", F.col("label").alias("full"))
    legacy = seasons.filter(~F.contains("label", F.lit("-"))).select("competition_id", F.col("label").alias("legacy"), full_season(F.col("label")).alias("full"))
    return legacy.join(full, ["competition_id", "full"], "left_semi").select("competition_id", "legacy", F.col("full").alias("label"))


def unmatched(feed: DataFrame, known: DataFrame) -> DataFrame:
    """Competitions of a feed(country, competition, feed_date) that aren't among the known(country, competition), whatever their case and spaces, with their games and days."""
    k = [F.lower(F.trim(c)).alias(c) for c in ("country", "competition")]
    return feed.select(*k, "feed_date").join(known.select(*k), ["country", "competition"], "left_anti").groupBy("country", "competition").agg(
        F.count("*").alias("n"), F.min("feed_date").alias("first_date"), F.max("feed_date").alias("last_date"))


def evidence(games: DataFrame, a: int, b: int, most: int = 12) -> DataFrame:
    """The last games of either of two teams, newest first, with the side that each was on."""
    own = F.col("home_id").isin(a, b) | F.col("away_id").isin(a, b)
    return games.filter(own).orderBy(F.desc("game_date"), F.desc("game_id")).limit(most).withColumn("of_left", (F.col("home_id") == a) | (F.col("away_id") == a))


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """(source, source_team_id) that stand for one team only."""
    return aliases.groupBy("source", "source_team_id").agg(F.count_distinct("team_id").alias("n"), F.min("team_id").alias("team_id")).filter("n = 1").drop("n")


def split_names(aliases: DataFrame) -> DataFrame:
    """(source, source_team_id) with more than one normalized name, the names in order."""
    names = F.array_sort(F.collect_set(compact_name(F.col("alias_name"))))
    return aliases.groupBy("source", "source_team_id").agg(names.alias("n")).filter(F.size("n") > 1).select("source", "source_team_id", F.array_join("n", "|").alias("names"), F.size("n").cast("long").alias("n_names"))


def alias_usage(aliases: DataFrame, games: DataFrame) -> DataFrame:
    """Games of each alias's team inside its years; an open end is unbounded."""
    from .games import appearances

    played = appearances(games).groupBy("team_id", F.year("game_date").alias("y")).agg(F.count("*").alias("n"))
    hit = (aliases.valid_from.isNull() | (F.col("y") >= F.col("valid_from"))) & (aliases.valid_to.isNull() | (F.col("y") <= F.col("valid_to")))
    return aliases.join(played.withColumnRenamed("team_id", "t"), (aliases.team_id == F.col("t")) & hit, "left").groupBy("alias_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_games"))


def pair_rollup(findings: DataFrame) -> DataFrame:
    """Findings of a pair of teams, in either order, as one row: the most open status, the worst severity, all types, and up to five pieces of evidence."""
    lo, hi = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    status = F.when(F.bool_or(F.col("status") == "open"), "open").when(F.bool_or(F.col("status") == "deferred"), "deferred").otherwise("completed")
    return findings.groupBy(lo.alias("left_id"), hi.alias("right_id")).agg(
        status.alias("status"), F.when(F.bool_or(F.col("severity") == "blocker"), "blocker").otherwise("warning").alias("severity"),
        F.array_join(F.array_sort(F.collect_set("finding_type")), ",").alias("types"), F.count("*").alias("n"),
        F.array_join(F.slice(F.array_sort(F.collect_set("evidence")), 1, 5), ",").alias("evidence"),
    )


def split_sources(aliases: DataFrame) -> DataFrame:
    """(source, source_team_id) that stand for more than one team."""
    return aliases.groupBy("source", "source_team_id").agg(F.count_distinct("team_id").alias("n_teams")).filter("n_teams > 1")


def unanimous(games: DataFrame, competitions: DataFrame) -> DataFrame:
    """The country of teams all of whose games are in competitions of one country."""
    from .games import appearances

    played = appearances(games).select("team_id", "competition_id").distinct().join(competitions.select("competition_id", "country"), "competition_id")
    return played.groupBy("team_id").agg(F.count_distinct("country").alias("n"), F.min("country").alias("country")).filter("n = 1").drop("n")


def one_to_one(games: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of games of two sources that are the only two with equal keys."""
    two = games.filter("home_score is not null and away_score is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("game_id").alias("game_id"), F.max("game_id").alias("other_id"), F.count_distinct("source").alias("sources")
    )
    return two.filter("n = 2 and sources = 2").select("game_id", "other_id")


def team_stats(games: DataFrame) -> DataFrame:
    """Games and last day of each team, at home and away together."""
    from .games import appearances

    return appearances(games).groupBy("team_id").agg(F.count("*").alias("games"), F.max("game_date").alias("last_date"))


def admin_teams(teams: DataFrame, aliases: DataFrame, games: DataFrame) -> DataFrame:
    """Teams with their aliases, their games, and the source of most aliases (the first of equals)."""
    by_source = aliases.groupBy("team_id", "source").agg(F.count("*").alias("n"))
    named = by_source.groupBy("team_id").agg(F.sum("n").alias("n_aliases"), F.min_by("source", F.struct(-F.col("n"), F.col("source"))).alias("top_source"))
    played = team_stats(games).select("team_id", F.col("games").alias("n_games"))
    return teams.join(named, "team_id", "left").join(played, "team_id", "left").select(
        "team_id", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"), F.coalesce("n_games", F.lit(0)).alias("n_games"), "top_source"
    )
