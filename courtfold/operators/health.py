"""Health of identities: findings by five rules as one table, those already decided left out, the state of a check, and pairs of teams to review with what is known of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact_name, decision_key, same_country
from . import identity as I
from .store import dealt, kept

#: Kinds of findings and the ones that are about a pair of teams. Fixed values.
METADATA, OBSERVED, SPLIT, DUPLICATE, ACROSS, SEASONS = "missing_metadata", "alias_observation", "source_team_split", "possible_duplicate", "possible_cross_source_match", "possible_cross_season_split"
PAIRS = (DUPLICATE, ACROSS, SEASONS)
COLUMNS = ("finding_type", "severity", "source", "source_team_id", "team_id", "other_source", "other_source_team_id", "other_id", "competition_id", "evidence", "suggestion")


def _unknown(country):
    return F.coalesce(F.trim(country).isin("", "UNK"), F.lit(True))


def _shaped(rows: DataFrame, kind, severity: str) -> DataFrame:
    rows = rows.withColumns({"finding_type": F.lit(kind) if isinstance(kind, str) else kind, "severity": F.lit(severity)})
    text = ("source", "source_team_id", "other_source", "other_source_team_id", "evidence", "suggestion")
    types = {c: "string" if c in text else "long" for c in COLUMNS[2:]}
    return rows.select(*COLUMNS[:2], *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def missing_metadata(teams: DataFrame, games: DataFrame, competitions: DataFrame) -> DataFrame:
    """Teams without a trusted country, with the one country of all their games' competitions as suggestion, where there is one."""
    known = competitions.filter(~_unknown(F.col("country")))
    lost = teams.filter(_unknown(F.col("country"))).select("team_id", F.col("team_name").alias("evidence"))
    return _shaped(lost.join(dealt(I.unanimous(games, known).select("team_id", F.col("country").alias("suggestion"))), "team_id", "left"), METADATA, "warning")


def observed_names(aliases: DataFrame) -> DataFrame:
    """A source's ids of one team that are known under several names, case and outer spaces aside."""
    seen = aliases.groupBy("source", "source_team_id", "team_id").agg(F.count_distinct(F.upper(F.trim("alias_name"))).alias("n"), F.array_join(F.array_sort(F.collect_set("alias_name")), ", ").alias("evidence"))
    return _shaped(seen.filter("n > 1"), OBSERVED, "warning")


def split_teams(aliases: DataFrame) -> DataFrame:
    """A source's ids that stand for several teams: the two lowest."""
    s = aliases.groupBy("source", "source_team_id").agg(F.min("team_id").alias("team_id"), F.count_distinct("team_id").alias("n")).filter("n > 1")
    second = aliases.join(dealt(s.select("source", "source_team_id", F.col("team_id").alias("low"))), ["source", "source_team_id"]).filter("team_id > low").groupBy("source", "source_team_id").agg(F.min("team_id").alias("other_id"))
    both = s.join(dealt(second), ["source", "source_team_id"]).withColumns({"other_source": F.col("source"), "other_source_team_id": F.col("source_team_id")})
    return _shaped(both, SPLIT, "blocker")


def similar_aliases(teams: DataFrame, aliases: DataFrame, games: DataFrame, pairs: DataFrame) -> DataFrame:
    """Teams of compatible countries and a common competition (or no games at all) that are known under similar names, by kind and name of the lower id: duplicates within a source, matches across two.

    pairs: similar_names() of the aliases' compact names. The source ids shown are the lowest.
    """
    places = aliases.select("source", "source_team_id", "team_id", compact_name(F.col("alias_name")).alias("name")).groupBy("team_id", "name", "source").agg(F.min("source_team_id").alias("source_team_id"))
    played = _appearances(games).select("team_id", "competition_id").distinct()
    a, b = (played.withColumnRenamed("team_id", s) for s in ("left_id", "right_id"))
    two = pairs.select("left_id", "right_id").distinct()
    common = two.join(dealt(a), "left_id").join(dealt(b), ["right_id", "competition_id"]).select("left_id", "right_id")
    lone = [two.join(dealt(x.select(s).distinct()), s, "left_anti").select("left_id", "right_id") for s, x in (("left_id", a), ("right_id", b))]
    met = common.unionByName(lone[0]).unionByName(lone[1]).distinct()
    countries = teams.select("team_id", F.when(~_unknown(F.col("country")), F.col("country")).alias("c"))
    for s in ("left", "right"):
        met = met.join(dealt(countries.withColumnsRenamed({"team_id": f"{s}_id", "c": f"{s}_country"})), f"{s}_id")
    met = met.filter(F.col("left_country").isNull() | F.col("right_country").isNull() | same_country(F.col("left_country"), F.col("right_country"))).select("left_id", "right_id")
    left = places.withColumnsRenamed({"team_id": "left_id", "name": "left_name"})
    right = places.withColumnsRenamed({"team_id": "right_id", "name": "right_name", "source": "other_source", "source_team_id": "other_source_team_id"})
    seen = pairs.join(dealt(met), ["left_id", "right_id"]).join(dealt(left), ["left_id", "left_name"]).join(dealt(right), ["right_id", "right_name"])
    kind = F.when(F.col("source") == F.col("other_source"), DUPLICATE).otherwise(ACROSS).alias("kind")
    first = F.min(F.struct("source", "source_team_id", "other_source", "other_source_team_id")).alias("m")
    one = seen.groupBy("left_id", "right_id", "left_name", kind).agg(first)
    return _shaped(one.select(F.col("left_id").alias("team_id"), F.col("right_id").alias("other_id"), F.col("left_name").alias("evidence"), "m.*", "kind"), F.col("kind"), "blocker")


def split_seasons(games: DataFrame, seasons: DataFrame, pairs: DataFrame, days: int = 370) -> DataFrame:
    """Teams with similar names that played in one competition in different seasons of which one begins at most `days` days after the other ended; once for each pair and competition.

    seasons(competition_id, season, first, last). A team's seasons of a competition meet another's as lists, so a pair is one row.
    """
    years = _appearances(games).select("team_id", "competition_id", "season").distinct().join(seasons, ["competition_id", "season"])
    lists = years.groupBy("team_id", "competition_id").agg(F.collect_list(F.struct("season", "first", "last")).alias("s"))
    two = pairs.groupBy("left_id", "right_id").agg(F.min(F.struct("left_name", "right_name")).alias("n"))
    met = two.join(dealt(lists.withColumnsRenamed({"team_id": "left_id", "s": "ls"})), "left_id").join(dealt(lists.withColumnsRenamed({"team_id": "right_id", "s": "rs"})), ["right_id", "competition_id"])
    gap = lambda x, y: F.when(x["last"] <= y["first"], F.datediff(y["first"], x["last"])).otherwise(F.datediff(x["first"], y["last"]))
    near = F.exists("ls", lambda x: F.exists("rs", lambda y: (x["season"] != y["season"]) & gap(x, y).between(0, days)))
    return _shaped(met.filter(near).select(F.col("left_id").alias("team_id"), F.col("right_id").alias("other_id"), "competition_id", F.concat_ws(" / ", "n.left_name", "n.right_name").alias("evidence")), SEASONS, "blocker")


def _appearances(games: DataFrame) -> DataFrame:
    side = lambda s: games.select(F.col(f"{s}_id").alias("team_id"), "competition_id", "season")
    return side("home").unionByName(side("away"))


def all_findings(teams: DataFrame, aliases: DataFrame, games: DataFrame, competitions: DataFrame, seasons: DataFrame) -> DataFrame:
    """Findings of the five rules, each with the key under which it is decided. Similar names are sought once for both rules that need them."""
    pairs = kept(I.similar_names(aliases.select("team_id", compact_name(F.col("alias_name")).alias("name")).filter("name <> ''").distinct()))
    out = missing_metadata(teams, games, competitions).unionByName(observed_names(aliases)).unionByName(split_teams(aliases))
    out = out.unionByName(similar_aliases(teams, aliases, games, pairs)).unionByName(split_seasons(games, seasons, pairs))
    scope = F.coalesce(F.col("competition_id").cast("string"), F.concat_ws(":", "source", "source_team_id"))
    return out.withColumn("decision", decision_key(F.col("finding_type"), F.col("team_id").cast("string"), F.coalesce("other_id", "team_id").cast("string"), F.when(scope != "", scope)))


def undecided(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings without those that decisions(decision, action, left_id, right_id) name, and without any about two teams that are to be kept separate."""
    apart = decisions.filter("action = 'keep_separate' and left_id is not null and right_id is not null").select(F.least("left_id", "right_id").alias("lo"), F.greatest("left_id", "right_id").alias("hi")).distinct()
    f = findings.join(dealt(decisions.select("decision").distinct()), "decision", "left_anti")
    return f.join(dealt(apart), (F.least("team_id", "other_id") == F.col("lo")) & (F.greatest("team_id", "other_id") == F.col("hi")) & F.col("other_id").isNotNull(), "left_anti")


def check_state(findings: DataFrame) -> DataFrame:
    """One row: number of findings, of blockers, and the state that follows: blockers, warnings or clean."""
    n = findings.agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity") == "blocker").alias("n_blockers"))
    return n.withColumn("state", F.when(F.col("n_blockers") > 0, "blockers").when(F.col("n_findings") > 0, "warnings").otherwise("clean"))


def review_candidates(findings: DataFrame, teams: DataFrame, aliases: DataFrame, games: DataFrame, *, status: str = "open", country: str | None = None, most: int = 200) -> DataFrame:
    """Pairs of teams to review, the first `most` (1 to 1000) of them: open before deferred before completed, blockers first, then by games, name and ids.

    findings as of all_findings() with a column status. A country keeps pairs of which one team is of it, status "all" every state.
    """
    pairs = findings.filter(F.col("finding_type").isin(*PAIRS)).withColumnsRenamed({"team_id": "left_id", "other_id": "right_id"})
    rolled = I.pair_rollup(pairs)
    if status != "all":
        rolled = rolled.filter(F.col("status") == status)
    named = aliases.groupBy("team_id").agg(F.count("*").alias("n_aliases"))
    known = teams.join(dealt(I.team_stats(games)), "team_id", "left").join(dealt(named), "team_id", "left").select(
        "team_id", "team_name", "country", "is_active", F.coalesce("games", F.lit(0)).alias("n_games"), F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"), "last_date")
    for s in ("left", "right"):
        rolled = rolled.join(dealt(known.select(*[F.col(c).alias(f"{s}_id" if c == "team_id" else f"{s}_{c}") for c in known.columns])), f"{s}_id")
    if country and country.strip():
        rolled = rolled.filter(same_country(F.col("left_country"), F.lit(country)) | same_country(F.col("right_country"), F.lit(country)))
    rank = F.when(F.col("status") == "open", 0).when(F.col("status") == "deferred", 1).otherwise(2)
    return rolled.orderBy(rank, F.col("severity") != "blocker", F.desc(F.col("left_n_games") + F.col("right_n_games")), "left_team_name", "left_id", "right_id").limit(min(max(most, 1), 1000))
