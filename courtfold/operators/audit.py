"""Season audits that go on where they stopped, and teams inferred from what findings say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .games import season_audit
from .identity import unique_aliases
from .store import kept, publish, published

LEDGER = "print string, games long, n_missing long, n_copies long, season string"


def audit(games: DataFrame, path: str) -> DataFrame:
    """(season, games, n_missing, n_copies, resumed): the audit of all seasons, of which only new and changed ones are computed.

    A ledger at path holds the result of each season under a print of its rows, a partition a season. Seasons with another print are audited again and their
    partitions replaced, those without games any more are taken away, all at once; the others are resumed. Rows of a null season are not audited.
    """
    games = games.filter("season is not null")
    cells = F.xxhash64(*sorted(games.columns))
    own = games.groupBy("season").agg(F.concat_ws(":", F.count("*").cast("string"), F.hex(F.bit_xor(cells)), F.sum(F.shiftrightunsigned(cells, 24)).cast("string")).alias("print"))
    spark = games.sparkSession
    before = published(spark, path, LEDGER)
    both = kept(own.join(before.select("season", F.col("print").alias("old")), "season", "full_outer"))
    changed = both.filter("print is not null and not (print <=> old)").select("season", "print")
    new = season_audit(games.join(changed, "season", "left_semi")).join(changed, "season")
    gone = [(r.season,) for r in both.filter("print is null").toLocalIterator()]  # labels of seasons
    if gone or changed.limit(1).count():
        publish(new.select("print", "games", "n_missing", "n_copies", "season").repartition("season"), path, ["season"], gone)
    return published(spark, path, LEDGER).join(changed.select("season", F.lit(False).alias("again")), "season", "left").select(
        "season", "games", "n_missing", "n_copies", F.coalesce("again", F.lit(True)).alias("resumed"))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def names_in_text(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(row_id, team_id): the one team whose name stands in a row's text, by runs of whole words in any case.

    rows(row_id, text), names(team_id, name). A name inside a longer one that is found at the same place doesn't count; texts with names of several teams, or with
    a name that several bear, give none. Runs of as many words as some name has are met with names by equality, so all names are sought at once.
    """
    known = names.withColumn("w", _tokens(F.col("name"))).filter(F.size("w") > 0)
    known = known.groupBy(F.array_join("w", " ").alias("run"), F.size("w").alias("n")).agg(F.collect_set("team_id").alias("teams"))
    sizes = sorted(r.n for r in known.select("n").distinct().collect())  # the different numbers of words of names
    words = rows.select("row_id", _tokens(F.col("text")).alias("w"))

    def runs_of(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.struct(p.alias("at"), F.array_join(F.slice("w", p, n), " ").alias("run")))

    runs = F.flatten(F.array(*map(runs_of, sizes)))
    if not sizes:
        return rows.select("row_id", F.lit(None).cast(names.schema["team_id"].dataType).alias("team_id")).limit(0)
    met = words.select("row_id", F.explode(runs).alias("r")).select("row_id", "r.at", "r.run").join(known, "run")
    own = met.groupBy("row_id").agg(F.collect_list(F.struct("at", (F.col("at") + F.col("n")).alias("end"), "teams")).alias("m"))
    inside = lambda x: F.exists("m", lambda y: (y["at"] <= x["at"]) & (y["end"] >= x["end"]) & (y["end"] - y["at"] > x["end"] - x["at"]))
    teams = F.array_distinct(F.flatten(F.transform(F.filter("m", lambda x: ~inside(x)), lambda x: x["teams"])))
    return own.select("row_id", teams.alias("t")).filter(F.size("t") == 1).select("row_id", F.col("t")[0].alias("team_id"))


def inferred_teams(findings: DataFrame, aliases: DataFrame, teams: DataFrame) -> DataFrame:
    """(finding_id, team_id, how): a finding's team by its source's id, where that stands for one team only, else by the name in its evidence; none where neither says.

    findings(finding_id, source, source_team_id, evidence), aliases(source, source_team_id, team_id), teams(team_id, team_name).
    """
    by_id = findings.join(unique_aliases(aliases), ["source", "source_team_id"], "left").select("finding_id", "evidence", F.col("team_id").alias("by_id"))
    rest = by_id.filter("by_id is null").select(F.col("finding_id").alias("row_id"), F.col("evidence").alias("text"))
    named = names_in_text(rest, teams.select("team_id", F.col("team_name").alias("name"))).withColumnsRenamed({"row_id": "finding_id", "team_id": "by_name"})
    how = F.when(F.col("by_id").isNotNull(), "source id").when(F.col("by_name").isNotNull(), "name")
    return by_id.join(named, "finding_id", "left").select("finding_id", F.coalesce("by_id", "by_name").alias("team_id"), how.alias("how"))
