"""Upserts, replacements and merges as functions from tables to new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _latest(new: DataFrame, keys: list[str], order: list | None) -> DataFrame:
    """One row for each key, nulls being a key: the last by `order`, then by all other columns."""
    rest = [F.desc(c) for c in new.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*(order or []), *rest) if order or rest else Window.partitionBy(*keys).orderBy(F.lit(0))
    return new.select(F.struct(*[F.col(c) for c in new.columns]).alias("n"), F.row_number().over(w).alias("rn")).filter("rn = 1").select("n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: Column | None = None, order: list | None = None, kept_columns: dict[str, Column] | None = None) -> DataFrame:
    """old with the rows of new by keys, null equal to null: new ones added, others replaced unless keep_old holds, a condition over o and n.

    Of new rows with equal keys the first by `order` counts (say, newest first), and of equal ones the greatest by all other columns. kept_columns names columns that
    stay as they were in a replaced row where their condition over o and n holds. Rows of old with equal keys are all replaced.
    """
    o = old.select(F.struct(*[F.col(c) for c in old.columns]).alias("o"))
    joined = o.join(_latest(new, keys, order), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    there, come = F.col("o").isNotNull(), F.col("n").isNotNull()
    take_old = there & (~come | F.coalesce(keep_old if keep_old is not None else F.lit(False), F.lit(False)))
    stays = {c: there & F.coalesce(when, F.lit(False)) for c, when in (kept_columns or {}).items()}
    return joined.select(*[F.when(take_old | stays.get(c, F.lit(False)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns])


def ingest(games: DataFrame, delivery: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """games(.., status, home_score, away_score, manual) after a delivery of the same columns: a result set by hand stays, and a scheduled row never replaces a finished one."""
    by_hand = F.col("o.manual")
    keep = (F.col("o.status") == "finished") & (F.col("n.status") == "scheduled")
    return upsert(games, delivery, keys, keep, order, {c: by_hand for c in ("status", "home_score", "away_score", "manual")})


def replace_season(old: DataFrame, new: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Rows of the scopes in new that new doesn't hold go; the rest stays, and new rows are upserted."""
    stale = old.join(new.select(*scope).distinct(), scope, "left_semi").join(new, keys, "left_anti")
    return upsert(old.join(stale, keys, "left_anti"), new, keys)


def accept(incoming: DataFrame, reasons: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason against them, and the others with the first reason."""
    reason = F.lit(None).cast("string")
    for condition, text in reversed(reasons):
        reason = F.when(condition, text).otherwise(reason)
    marked = incoming.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def merge_teams(rows: DataFrame, columns: list[str], moves: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """Team columns repointed by moves(source_id, target_id); of rows that then collide on `unique` the first by all columns stays."""
    for c in columns:
        m = moves.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"))
        rows = rows.join(m, F.col(c) == F.col("_s"), "left").withColumn(c, F.coalesce("_t", c)).drop("_s", "_t")
    if unique:
        w = Window.partitionBy(*unique).orderBy(*[x for x in rows.columns if x not in unique])
        rows = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return rows


def merge_blockers(games: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves whose two teams ever met: they can't be one team."""
    met = games.select(F.least("home_id", "away_id").alias("a"), F.greatest("home_id", "away_id").alias("b")).distinct()
    return moves.join(met, (F.least("source_id", "target_id") == F.col("a")) & (F.greatest("source_id", "target_id") == F.col("b")), "left_semi")


def add_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it doesn't hold."""
    return old.unionByName(_latest(new, keys, None).select("n.*").join(old, keys, "left_anti").select(*old.columns))


def suppress(findings: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Findings that no decision settles."""
    return findings.join(decisions, key, "left_anti")


def _variants(names: list[str], known: str, missing: tuple[str, ...]) -> Column:
    """All ways to write a row's names as text: a known one as itself or as `known`, a missing one as any of `missing`."""
    out = F.array(F.lit(""))
    for n in names:
        ways = F.when(F.col(n).isNull(), F.array(*map(F.lit, missing))).otherwise(F.array(F.concat(F.lit("="), F.col(n).cast("string")), F.lit(known)))
        out = F.flatten(F.transform(out, lambda head: F.transform(ways, lambda way: F.concat(head, F.lit("\x1f"), way))))
    return out


def invalidated(runs: DataFrame, scopes: DataFrame, names: list[str]) -> DataFrame:
    """Runs that some scope touches; null on either side is any.

    Each side is written with its names as they are and as what the other side may leave out, so the match is an equality.
    """
    s = scopes.select(F.explode(_variants(names, "run any", ("scope any",))).alias("key")).distinct()
    r = runs.select(F.struct(*[F.col(c) for c in runs.columns]).alias("run"), F.explode(_variants(names, "scope any", ("run any", "scope any"))).alias("key"))
    return r.join(s, "key", "left_semi").select("run").distinct().select("run.*")


def extract_alias(teams: DataFrame, aliases: DataFrame, games: DataFrame, alias_id: int, new_id: int, columns: tuple[str, str] = ("home_id", "away_id")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """teams, aliases and games after one alias became a team of its own: the games of its source and old team follow it."""
    own = aliases.filter(F.col("alias_id") == alias_id).select(F.col("team_id").alias("from_id"), F.col("source").alias("from_source"), "alias_name")
    new = own.join(teams, F.col("from_id") == F.col("team_id")).select(*[F.lit(new_id).cast("long").alias(c) if c == "team_id" else F.col("alias_name").alias(c) if c == "team_name" else F.col(c) for c in teams.columns])
    moved = aliases.withColumn("team_id", F.when(F.col("alias_id") == alias_id, F.lit(new_id)).otherwise(F.col("team_id")))
    played = games.join(own.select("from_id", "from_source"), F.col("source") == F.col("from_source"), "left")
    for c in columns:
        played = played.withColumn(c, F.when(F.col(c) == F.col("from_id"), F.lit(new_id)).otherwise(F.col(c)))
    return teams.unionByName(new), moved, played.drop("from_id", "from_source")


def overlay(rows: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage rows with inspection decisions laid over: a decided row needs no inspection and carries its note."""
    d = decisions.select(*keys, F.col("note").alias("_note"))
    out = rows.join(d, keys, "left")
    return out.withColumns({"needs_inspection": F.col("needs_inspection") & F.col("_note").isNull(), "severity": F.when(F.col("_note").isNotNull(), "reviewed").otherwise(F.col("severity")),
                            "note": F.col("_note")}).drop("_note")


def next_version(versions: DataFrame, proposed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Proposed parameters that differ from their latest version in any field, null equal to null, with the next number."""
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    last = versions.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(key, "version", *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    joined = proposed.join(last, key, "left").filter(F.col("version").isNull() | ~same)
    return joined.select(key, (F.coalesce("version", F.lit(0)) + 1).alias("version"), *fields)


def split_stage(games: DataFrame, rounds: list[str], target: Column) -> DataFrame:
    """Games of the named rounds, in any case, moved to another competition."""
    moved = F.lower(F.coalesce("round_name", F.lit(""))).isin([r.lower() for r in rounds])
    return games.withColumn("competition_id", F.when(moved, target).otherwise(F.col("competition_id")))


def first_wins(rows: DataFrame, keys: list[str], priority: list) -> DataFrame:
    """One row for each key, the first by priority."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*priority))).filter("_rn = 1").drop("_rn")


def replace_points(base: DataFrame, refined: DataFrame, keys: list[str]) -> DataFrame:
    """Points of base at keys that refined doesn't hold, and the refined ones."""
    return base.join(refined, keys, "left_anti").unionByName(refined.select(*base.columns))
