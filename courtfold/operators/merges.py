"""Merging of teams over all tables: chains of moves closed, moves that can't be refused, and a rule of its own for each table's collisions.

Moves grow with the teams, so every join is an exchange of both sides: files of ids are small enough to be broadcast long after the driver can't hold several of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import dealt, kept

#: Columns of teams in each table, and what must be unique in it after a merge.
TEAM_COLUMNS = {"aliases": ["team_id"], "games": ["home_id", "away_id"], "history": ["team_id", "opponent_id"], "ratings": ["team_id"], "findings": ["left_id", "right_id"]}


def closed_moves(moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves to the end of each chain, sources that lead into a cycle) of moves(source_id, target_id).

    Each round doubles how far every move reaches, so chains of n moves take log2(n) rounds. A source with several targets, or itself as target, counts as a cycle's.
    """
    one = moves.distinct().groupBy("source_id").agg(F.min("target_id").alias("target_id"), F.count("*").alias("n"))
    # a source without one other target leads to itself, which never ends
    now = kept(one.select("source_id", F.when(F.col("n") == 1, F.col("target_id")).otherwise(F.col("source_id")).alias("target_id")))
    for _ in range(now.count().bit_length() + 1):
        nxt = now.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"))
        if not now.join(dealt(nxt), F.col("target_id") == F.col("_s"), "left_semi").limit(1).count():
            break
        now = kept(now.join(dealt(nxt), F.col("target_id") == F.col("_s"), "left").select("source_id", F.coalesce("_t", "target_id").alias("target_id")))
    ends = dealt(now.select(F.col("source_id").alias("_s")))
    return now.join(ends, F.col("target_id") == F.col("_s"), "left_anti"), now.join(ends, F.col("target_id") == F.col("_s"), "left_semi").select("source_id")


def guarded_moves(moves: DataFrame, teams: DataFrame, games: DataFrame, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(closed moves that may be made, (source_id, reason) of the others).

    Refused are moves into a cycle or with several targets, moves to a team that isn't there, and all moves to a target of which any two teams to be one ever met, itself
    included. Moves of a source without rows in any of tables(team_id) or in games are left out as having nothing to move; they count for nothing else.
    """
    closed, cyclic = closed_moves(moves)
    played = games.select(F.explode(F.array("home_id", "away_id")).alias("team_id"))
    for t in tables:
        played = played.unionByName(t.select("team_id"))
    idle = closed.join(dealt(played.distinct()), F.col("source_id") == F.col("team_id"), "left_anti")
    busy = kept(closed.join(dealt(idle.select("source_id")), "source_id", "left_anti"))
    missing = busy.join(dealt(teams.select("team_id")), F.col("target_id") == F.col("team_id"), "left_anti")
    ends = busy.unionByName(busy.select(F.col("target_id").alias("source_id"), "target_id").distinct())
    h, a = (dealt(ends.select(F.col("source_id").alias(c), F.col("target_id").alias(f"{c}_end"))) for c in ("home_id", "away_id"))
    met = games.join(h, "home_id").join(a, "away_id").filter("home_id_end = away_id_end").select(F.col("home_id_end").alias("target_id")).distinct()
    reasons = cyclic.select("source_id", F.lit("cycle").alias("reason"), F.lit(0).alias("p")).unionByName(missing.select("source_id", F.lit("missing target").alias("reason"), F.lit(1).alias("p")))
    reasons = reasons.unionByName(busy.join(dealt(met), "target_id", "left_semi").select("source_id", F.lit("met").alias("reason"), F.lit(2).alias("p")))
    reasons = reasons.unionByName(idle.select("source_id", F.lit("nothing to move").alias("reason"), F.lit(3).alias("p")))
    refused = kept(reasons.groupBy("source_id").agg(F.min_by("reason", "p").alias("reason")))
    return busy.join(dealt(refused), "source_id", "left_anti"), refused


def repointed(rows: DataFrame, columns: list[str], moves: DataFrame) -> DataFrame:
    """rows with team columns by closed moves, and `_moved` where the first of them changed."""
    out = rows
    for i, c in enumerate(columns):
        m = dealt(moves.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t")))
        out = out.join(m, F.col(c) == F.col("_s"), "left")
        if not i:
            out = out.withColumn("_moved", F.col("_t").isNotNull())
        out = out.withColumn(c, F.coalesce("_t", c)).drop("_s", "_t")
    return out


def _first(rows: DataFrame, unique: list[str], order: list) -> DataFrame:
    """Of rows that collide the target's own before moved ones, then by order."""
    w = Window.partitionBy(*unique).orderBy("_moved", *order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_moved")


def merge_all(tables: dict[str, DataFrame], moves: DataFrame) -> dict[str, DataFrame]:
    """teams, aliases, games, history, ratings and findings after closed moves that guarded_moves() gave.

    teams(team_id, predecessor_id, successor_id, ..): sources go, links are repointed, and a link of a team to itself is cut. aliases(alias_id, team_id, source,
    source_team_id, alias_name): of equal names of a source one stays. games: both sides are repointed, none goes. history(pool, ruleset, game_id, team_id, opponent_id, ..) and
    ratings(pool, ruleset, team_id, games, ..): a target's own row stays, else that of the source with the lowest id, or with most games. findings(finding_id,
    left_id, right_id, finding_type, status): those of a team with itself are done with, and of equal ones the first stays. In each table a target's own row comes before moved ones.
    """
    out = {}
    t = tables["teams"].join(dealt(moves.select("source_id")), F.col("team_id") == F.col("source_id"), "left_anti")
    links = ["predecessor_id", "successor_id"]
    t = repointed(t, links, moves).drop("_moved")
    out["teams"] = t.withColumns({c: F.when(F.col(c) != F.col("team_id"), F.col(c)) for c in links})
    was = tables["aliases"]
    out["aliases"] = _first(repointed(was, ["team_id"], moves), ["source", "source_team_id", "alias_name", "team_id"], ["alias_id"])
    out["games"] = repointed(tables["games"], TEAM_COLUMNS["games"], moves).drop("_moved")
    h = tables["history"].withColumn("_was", F.col("team_id"))
    out["history"] = _first(repointed(h, TEAM_COLUMNS["history"], moves), ["pool", "ruleset", "game_id", "team_id"], ["_was"]).drop("_was")
    r = tables["ratings"].withColumn("_was", F.col("team_id"))
    out["ratings"] = _first(repointed(r, ["team_id"], moves), ["pool", "ruleset", "team_id"], [F.desc("games"), "_was"]).drop("_was")
    f = repointed(tables["findings"], TEAM_COLUMNS["findings"], moves).withColumn("_moved", F.lit(False)).filter("left_id <> right_id")
    f = f.withColumns({"left_id": F.least("left_id", "right_id"), "right_id": F.greatest("left_id", "right_id")})
    out["findings"] = _first(f, ["finding_type", "left_id", "right_id"], ["finding_id"])
    return out
