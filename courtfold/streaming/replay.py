"""The rating replay as a stream: the ladder of each pool is kept as state between batches."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rating import Ruleset
from ..operators.rating import ORDER, Ladder, rated_games, replay

OUT = (
    "pool string, game_id long, game_date date, team_id long, opponent_id long, is_home boolean, pre double, post double, change double, "
    "expected double, multiplier double, games_before long, rank_after long, late boolean"
)


def ratings_stream(games: DataFrame, rules: Ruleset) -> DataFrame:
    """Two rows for each rated game of a stream, as replay() gives them, if batches come in order of days; one with `late` for each game that comes too late.

    A game that should have come before one already played moves no rating: it has a row of its home team without figures, and its pool needs a new replay, see
    caught_up(). The state of a pool is its ladder and the last game's place in the order, so it grows with the teams and not with the games. A batch of one pool is sorted
    in its task; use availableNow or small triggers for a backfill.
    """
    cols = [name for name, _ in (x.rsplit(" ", 1) for x in OUT.split(", "))]

    def run(key, parts, state: GroupState):
        ladder, last = Ladder(rules), None
        if state.exists:
            ladder.elo, ladder.played, ladder.order, last = pickle.loads(state.get[0])
        rows = []
        for g in pd.concat(list(parts)).sort_values(list(ORDER)).itertuples():
            head, place = (key[0], g.game_id, g.game_date), tuple(getattr(g, c) for c in ORDER)
            if last is not None and place < last:
                rows.append((*head, g.home_id, g.away_id, True, *[None] * 7, True))
                continue
            last = place
            h, a, p, times, change, before = ladder.play(g.home_id, g.away_id, g.home_score, g.away_score)
            rows.append((*head, g.home_id, g.away_id, True, h, h + change, change, p, times, before[0], ladder.rank(g.home_id), False))
            rows.append((*head, g.away_id, g.home_id, False, a, a - change, -change, 1 - p, times, before[1], ladder.rank(g.away_id), False))
        state.update((pickle.dumps((ladder.elo, ladder.played, ladder.order, last)),))
        out = pd.DataFrame(rows, columns=cols)
        yield out.astype({"games_before": "Int64", "rank_after": "Int64"})

    return rated_games(games).groupBy("pool").applyInPandasWithState(run, OUT, "ladder binary", "append", GroupStateTimeout.NoTimeout)


def caught_up(streamed: DataFrame, games: DataFrame, rules: Ruleset) -> DataFrame:
    """The stream's rows with those of pools that had late games replaced by a replay of all their games."""
    late = streamed.filter("late").select("pool").distinct()
    again = replay(games.join(late, "pool", "left_semi"), [rules]).withColumn("late", F.lit(False))
    return streamed.join(late, "pool", "left_anti").unionByName(again.select(*streamed.columns))


def results_by_day(feed: DataFrame, late: str = "2 days") -> DataFrame:
    """Results of a feed stream by day, each source id once, until `late` after the day's end."""
    once = feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["source_game_id"])
    return once.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("results")).select(F.col("window.start").alias("day"), "results")
