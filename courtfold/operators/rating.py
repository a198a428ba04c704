"""Chronological rating replay, snapshots, gates and backtests."""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.rating import RULESETS, Ruleset, rate, validate

ORDER = ("game_date", "source", "source_game_id", "game_id")
HISTORY = pa.schema([
    ("pool", pa.string()), ("ruleset", pa.string()), ("seq", pa.int64()), ("game_id", pa.int64()), ("game_date", pa.date32()), ("competition_id", pa.int64()),
    ("season", pa.string()), ("team_id", pa.int64()), ("opponent_id", pa.int64()), ("is_home", pa.bool_()), ("pre", pa.float64()), ("post", pa.float64()),
    ("change", pa.float64()), ("expected", pa.float64()), ("actual", pa.float64()), ("multiplier", pa.float64()), ("games_before", pa.int64()), ("rank_after", pa.int64()),
])
DDL = (
    "pool string, ruleset string, seq long, game_id long, game_date date, competition_id long, season string, team_id long, opponent_id long, is_home boolean, "
    "pre double, post double, change double, expected double, actual double, multiplier double, games_before long, rank_after long"
)


#: A pool's games are played in full by spans of at least so many, and of at least as many as it has teams, so all ladders together hold no more teams than there are games.
SPAN = 1 << 15


def rated_games(games: DataFrame) -> DataFrame:
    """Games that count: eligible, both scores known, not level. The status doesn't matter."""
    return games.filter("eligible and home_score is not null and away_score is not null and home_score <> away_score")


def gate(games: DataFrame) -> DataFrame:
    """The first finished but ineligible game of each pool, and how many there are; a pool in it must not be rebuilt."""
    bad = games.filter("status = 'finished' and not eligible")
    first = F.min(F.struct("game_date", "source", "game_id"))
    return bad.groupBy("pool").agg(F.count("*").alias("n_blocking"), first.alias("first")).select("pool", "n_blocking", F.col("first.game_id").alias("first_game_id"))


class Ladder:
    """Ratings and games of the teams met so far, with their order kept sorted."""

    def __init__(self, rules: Ruleset):
        self.rules, self.elo, self.played, self.order = rules, {}, {}, []

    @classmethod
    def resumed(cls, rules: Ruleset, state: bytes) -> tuple[Ladder, int]:
        """The ladder before a span, and the number of games before it."""
        ladder = cls(rules)
        ladder.elo, ladder.played, seq = pickle.loads(state)
        ladder.order = sorted((-elo, team) for team, elo in ladder.elo.items())
        return ladder, seq

    def _move(self, team, elo: float) -> None:
        if team in self.elo:
            del self.order[bisect_left(self.order, (-self.elo[team], team))]
        self.elo[team], self.played[team] = elo, self.played.get(team, 0) + 1
        insort(self.order, (-elo, team))

    def play(self, home, away, home_score, away_score):
        """(pre home, pre away, expected, multiplier, delta) and both teams' games before; the ladder moves on."""
        h, a = self.elo.get(home, self.rules.base), self.elo.get(away, self.rules.base)
        before = self.played.get(home, 0), self.played.get(away, 0)
        p, times, change = rate(home_score, away_score, h, a, self.rules)
        self._move(home, h + change)
        self._move(away, a - change)
        return h, a, p, times, change, before

    def rank(self, team) -> int:
        return bisect_left(self.order, (-self.elo[team], team)) + 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(pool, ruleset) and the rows of each run of equal ones."""
    kinds = list(zip(batch.column("pool").to_pylist(), batch.column("ruleset").to_pylist()))
    cuts = [0, *(i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]), len(kinds)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield kinds[a], batch.slice(a, b - a)


def _packed(batches):
    """One row for each run of a batch: its first game's place in the order, and the games in Arrow's own form."""
    for batch in batches:
        runs = list(_runs(batch))
        firsts = [pa.concat_arrays([part.column(c).slice(0, 1) for _, part in runs]) if runs else batch.column(c) for c in ("pool", "ruleset", *ORDER)]
        blobs = []
        for _, part in runs:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                out.write_batch(part)
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([*firsts, pa.array(blobs, pa.binary())], ["pool", "ruleset", *ORDER, "games"])


def _walked(rules: dict[str, Ruleset]):
    """Numbers the spans of each pool from packed games in order: only ratings move here, and each span's first row has the ratings, games and number of games before it."""

    def run(batches):
        now = None
        for batch in batches:
            blobs, spans, seqs, states = batch.column("games"), [], [], []
            for key, blob in zip(zip(batch.column("pool").to_pylist(), batch.column("ruleset").to_pylist()), blobs):
                if now != key:
                    now, own, elo, played, seq, span, begun = key, rules[key[1]], {}, Counter(), 0, 0, 0
                state = None
                if seq - begun >= max(SPAN, len(elo)):
                    span, begun, state = span + 1, seq, pickle.dumps((elo, dict(played), seq))
                spans.append(span)
                seqs.append(seq)
                states.append(state)
                names = pa.ipc.open_stream(blob.as_buffer()).schema.names
                wanted = [names.index(c) for c in ("home_id", "away_id", "home_score", "away_score")]
                games = pa.ipc.open_stream(blob.as_buffer(), options=pa.ipc.IpcReadOptions(included_fields=wanted)).read_all()
                homes, aways, home_scores, away_scores = (games.column(names[i]).to_pylist() for i in wanted)
                base = own.base
                for home, away, home_score, away_score in zip(homes, aways, home_scores, away_scores):
                    h, a = elo.get(home, base), elo.get(away, base)
                    change = rate(home_score, away_score, h, a, own)[2]
                    elo[home] = h + change
                    elo[away] = a - change
                played.update(homes)
                played.update(aways)
                seq += len(homes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("pool"), batch.column("ruleset"), pa.array(spans, pa.int64()), pa.array(seqs, pa.int64()), pa.array(states, pa.binary()), blobs],
                ["pool", "ruleset", "span", "seq", "state", "games"],
            )

    return run


def _unpacked(batches):
    """The games again, the first of each span but a pool's first with the state before it."""
    for batch in batches:
        for blob, state in zip(batch.column("games"), batch.column("state").to_pylist()):
            for games in pa.ipc.open_stream(blob.as_buffer()):
                yield pa.RecordBatch.from_arrays([*games.columns, pa.array([state] + [None] * (games.num_rows - 1), pa.binary())], [*games.schema.names, "state"])


def _dealt(games: DataFrame, rules: dict[str, Ruleset], *more: str) -> DataFrame:
    """Games once for each ruleset."""
    cols = ["pool", "game_date", "source", "source_game_id", "game_id", "competition_id", "season", "home_id", "away_id", "home_score", "away_score", *more]
    return games.select(*cols).withColumn("ruleset", F.explode(F.array(*map(F.lit, rules))))


def _sorted(games: DataFrame, rules: dict[str, Ruleset]) -> DataFrame:
    """Games once for each ruleset in order of play, in spans that are dealt to tasks; `state` of a span's first game is what Ladder.resumed() goes on from, and null where a pool begins.

    Games are sorted in ranges. One task for each (pool, ruleset) then moves the ratings alone through its games, which come packed, to have the state before each span;
    what stands in the history is left to the spans.
    """
    keys = ["pool", "ruleset"]
    ordered = _dealt(games, rules).repartitionByRange(*keys, *ORDER).sortWithinPartitions(*keys, *ORDER)
    kinds = {f.name: f for f in ordered.schema.fields}
    firsts = [kinds[c] for c in (*keys, *ORDER)]
    packed = ordered.mapInArrow(_packed, StructType([*firsts, StructField("games", BinaryType())])).repartition(*keys).sortWithinPartitions(*keys, *ORDER)
    walked = packed.mapInArrow(_walked(rules), StructType([*firsts[:2], *StructType.fromDDL("span long, seq long, state binary, games binary").fields]))
    tasks = 4 * games.sparkSession.sparkContext.defaultParallelism
    return walked.repartition(tasks, *keys, "span").sortWithinPartitions(*keys, "span", "seq").mapInArrow(_unpacked, StructType([*ordered.schema.fields, StructField("state", BinaryType())]))


def replay(games: DataFrame, rulesets: list[Ruleset] | None = None) -> DataFrame:
    """Two rows a game, one for each team: ratings before and after, change, expectation, multiplier, games before, rank after.

    Only rated games count. State is a ladder of the teams of one (pool, ruleset); rows stream in sorted order,
    so memory is bounded by the teams, and pools, rulesets and the spans of _sorted() run in parallel. Ratings are not rounded.
    """
    rules = {r.name: r for r in rulesets or RULESETS.values()}

    def run(batches):
        now = ladder = None
        seq = 0
        for batch in batches:
            n = batch.num_rows
            pools, names, homes, aways, home_scores, away_scores = (batch.column(c).to_pylist() for c in ("pool", "ruleset", "home_id", "away_id", "home_score", "away_score"))
            states = batch.column("state").to_pylist()
            numbers, played = [], []  # what the ladder gives of each game
            for key, home, away, home_score, away_score, state in zip(zip(pools, names), homes, aways, home_scores, away_scores, states):
                if state is not None:
                    now, (ladder, seq) = key, Ladder.resumed(rules[key[1]], state)
                elif now != key:
                    now, ladder, seq = key, Ladder(rules[key[1]]), 0
                seq += 1
                h, a, p, times, change, before = ladder.play(home, away, home_score, away_score)
                numbers += (h, a, p, times, change)
                played += (seq, before[0], before[1], ladder.rank(home), ladder.rank(away))
            h, a, p, times, change = np.array(numbers, np.float64).reshape(n, 5).T
            seqs, home_before, away_before, home_rank, away_rank = np.array(played, np.int64).reshape(n, 5).T
            won = np.array([x > y for x, y in zip(home_scores, away_scores)], np.float64)
            twice = pa.array(np.repeat(np.arange(n), 2))
            both = lambda x, y: np.column_stack([x, y]).ravel()
            sides = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("home_id", "away_id")]
            own = {
                "seq": both(seqs, seqs), "team_id": both(*sides), "opponent_id": both(*sides[::-1]), "is_home": both(np.ones(n, bool), np.zeros(n, bool)), "pre": both(h, a),
                "post": both(h + change, a - change), "change": both(change, -change), "expected": both(p, 1 - p), "actual": both(won, 1 - won), "multiplier": both(times, times),
                "games_before": both(home_before, away_before), "rank_after": both(home_rank, away_rank),
            }
            yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else batch.column(f.name).take(twice).cast(f.type) for f in HISTORY], schema=HISTORY)

    return _sorted(rated_games(games), rules).mapInArrow(run, DDL)


def rounded(history: DataFrame) -> DataFrame:
    """History as it is stored: ratings and changes to 2 places, probabilities and multipliers to 4, half away from zero."""
    return history.withColumns({c: F.round(c, 2) for c in ("pre", "post", "change")} | {c: F.round(c, 4) for c in ("expected", "multiplier")})


def snapshot(history: DataFrame) -> DataFrame:
    """Last rating, games and last game of each team in each pool and ruleset."""
    last = F.max_by(F.struct("post", "games_before", "game_id", "game_date"), "seq")
    return history.groupBy("pool", "ruleset", "team_id").agg(last.alias("last")).select(
        "pool", "ruleset", "team_id", F.round("last.post", 2).alias("elo"), (F.col("last.games_before") + 1).alias("games"),
        F.col("last.game_id").alias("last_game_id"), F.col("last.game_date").alias("last_date"),
    )


def open_games(games: DataFrame) -> DataFrame:
    """Games of the pools that the gate leaves open."""
    return games.join(gate(games).select("pool"), "pool", "left_anti")


def rebuilt(games: DataFrame, stored: DataFrame, rulesets: list[Ruleset]) -> DataFrame:
    """History after a rebuild: a pool in the gate keeps its stored rows of these rulesets, every other one is replayed. Other rulesets keep all their rows."""
    names = [r.name for r in rulesets]
    kept = stored.join(gate(games).select("pool"), "pool", "left_semi").unionByName(
        stored.filter(~F.col("ruleset").isin(names)).join(gate(games).select("pool"), "pool", "left_anti"))
    return replay(open_games(games), rulesets).unionByName(kept.select(*[f.name for f in HISTORY]))


def write_history(history: DataFrame, path: str, rebuilt_partitions: list[tuple[str, str]] = ()) -> None:
    """Replace the (pool, ruleset) partitions that history holds and leave the others; rebuilt ones that it doesn't hold, as no game is left, are deleted."""
    history.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pool", "ruleset").parquet(path)
    if rebuilt_partitions:
        spark = history.sparkSession
        there = {tuple(r) for r in history.select("pool", "ruleset").distinct().collect()}
        for pool, ruleset in set(rebuilt_partitions) - there:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pool={pool}/ruleset={ruleset}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


PREDICTION = pa.schema([
    ("pool", pa.string()), ("ruleset", pa.string()), ("game_id", pa.int64()), ("game_date", pa.date32()), ("competition_id", pa.int64()), ("season", pa.string()),
    ("home_id", pa.int64()), ("away_id", pa.int64()), ("scored", pa.bool_()), ("p", pa.float64()), ("margin", pa.float64()), ("predicted", pa.float64()),
    ("home_won", pa.bool_()), ("home_change", pa.float64()), ("home_post", pa.float64()), ("away_post", pa.float64()),
])


def backtest(games: DataFrame, rulesets: list[Ruleset], warm: tuple[date, date], scored: tuple[date, date]) -> DataFrame:
    """One row per game in either window: the prediction before the game, and the change after it.

    Windows include both ends; a game in both is scored, one in neither is left out and moves no rating. `p` is
    not rounded here; the rulesets run over the same games, each in its own partition and in order, as means of stored margins may stand on a rounding's edge.
    """
    for r in rulesets:
        if wrong := validate(r):
            raise ValueError(f"{r.name}: {'; '.join(wrong)}")
    rules = {r.name: r for r in rulesets}
    is_scored = F.col("game_date").between(F.lit(scored[0]), F.lit(scored[1]))
    own = rated_games(games).withColumn("scored", is_scored).filter(is_scored | F.col("game_date").between(F.lit(warm[0]), F.lit(warm[1])))

    def run(batches):
        now = ladder = None
        for batch in batches:
            out = []
            for g in batch.to_pylist():
                if now != (g["pool"], g["ruleset"]):
                    now, ladder = (g["pool"], g["ruleset"]), Ladder(rules[g["ruleset"]])
                r = ladder.rules
                h, a, p, _, change, _ = ladder.play(g["home_id"], g["away_id"], g["home_score"], g["away_score"])
                predicted = (h + r.home_advantage - a) / r.points if r.points and r.points > 0 else 0.0
                out.append((*now, *(g[c] for c in ("game_id", "game_date", "competition_id", "season", "home_id", "away_id", "scored")), p,
                            float(g["home_score"] - g["away_score"]), predicted, g["home_score"] > g["away_score"], change, h + change, a - change))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(PREDICTION), PREDICTION)], schema=PREDICTION)

    ddl = ("pool string, ruleset string, game_id long, game_date date, competition_id long, season string, home_id long, away_id long, scored boolean, p double, "
           "margin double, predicted double, home_won boolean, home_change double, home_post double, away_post double")
    return _dealt(own, rules, "scored").repartition("pool", "ruleset").sortWithinPartitions("pool", "ruleset", *ORDER).mapInArrow(run, ddl)


def predictions(tested: DataFrame) -> DataFrame:
    """Scored rows as stored: p to 4 places, predicted margin and its error to 2; the pick uses the unrounded p."""
    margin = F.round("predicted", 2)
    return tested.filter("scored").select(
        "pool", "ruleset", "game_id", "game_date", "competition_id", "season", "home_id", "away_id", F.round("p", 4).alias("p"), margin.alias("predicted_margin"),
        F.round(F.abs(F.col("margin") - margin), 2).alias("margin_error"), ((F.col("p") >= 0.5) == F.col("home_won")).alias("correct"), "home_won",
    )


def metrics(pred: DataFrame) -> list:
    """Aggregates of stored predictions: games, accuracy, Brier score, log loss, margin error, mean p."""
    won = F.col("home_won").cast("double")
    right = F.when(F.col("home_won"), F.col("p")).otherwise(1 - F.col("p"))
    return [
        F.count("*").alias("games"), F.count_if("correct").alias("n_correct"), F.round(F.avg(F.col("correct").cast("double")) * 100, 1).alias("accuracy"),
        F.round(F.avg((F.col("p") - won) * (F.col("p") - won)), 4).alias("brier"),
        F.round(F.avg(-F.ln(F.least(F.greatest(right, F.lit(0.001)), F.lit(0.999)))), 4).alias("log_loss"),
        F.round(F.avg("margin_error"), 2).alias("avg_margin_error"), F.round(F.avg("p") * 100, 1).alias("avg_p"),
    ]


def breakdown(pred: DataFrame) -> DataFrame:
    """Metrics of the whole run and of each season, competition and month, by grouping sets."""
    rows = pred.withColumn("month", F.date_format("game_date", "yyyy-MM"))
    sets = [["ruleset"], ["ruleset", "season"], ["ruleset", "competition_id"], ["ruleset", "month"]]
    out = rows.groupingSets(sets, "ruleset", "season", "competition_id", "month").agg(F.grouping_id().alias("gid"), *metrics(rows))
    # bits of grouping_id: ruleset, season, competition, month; a bit is set where the column is rolled up
    kind = F.when(F.col("gid") == 7, "run").when(F.col("gid") == 3, "season").when(F.col("gid") == 5, "competition").otherwise("month")
    segment = F.coalesce("season", F.col("competition_id").cast("string"), "month", F.lit("all"))
    return out.select("ruleset", kind.alias("segment_type"), segment.alias("segment"), *[c for c in out.columns if c not in ("ruleset", "season", "competition_id", "month", "gid")])


def against_baseline(table: DataFrame, model: str, baseline: str) -> DataFrame:
    """Breakdown rows of a model beside the baseline's."""
    keys = ["segment_type", "segment"]
    b = table.filter(F.col("ruleset") == baseline).select(*keys, *[F.col(c).alias(f"base_{c}") for c in ("accuracy", "brier", "log_loss")])
    m = table.filter(F.col("ruleset") == model).drop("ruleset")
    return m.join(b, keys, "left").withColumn("brier_gain", F.round(F.col("base_brier") - F.col("brier"), 4))


def recent_movement(tested: DataFrame, n: int = 5) -> DataFrame:
    """Sum of the last n changes of each team of a backtest."""
    sides = tested.select("pool", "ruleset", "game_date", "game_id", F.explode(F.array(
        F.struct(F.col("home_id").alias("team_id"), F.col("home_change").alias("change")), F.struct(F.col("away_id").alias("team_id"), (-F.col("home_change")).alias("change"))
    )).alias("s")).select("pool", "ruleset", "game_date", "game_id", "s.*")
    w = Window.partitionBy("pool", "ruleset", "team_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    return sides.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).groupBy("pool", "ruleset", "team_id").agg(F.round(F.sum("change"), 2).alias("movement"), F.count("*").alias("n"))


def scope(competitions: DataFrame, ids: list[int] | DataFrame | None = None) -> tuple[str, DataFrame]:
    """The one pool of the chosen competitions (all if None), and their labels; names that repeat get their country.

    Raises if none is found or if they belong to more than one pool.
    """
    chosen = competitions if ids is None else competitions.join(ids, "competition_id", "left_semi") if isinstance(ids, DataFrame) else competitions.filter(F.col("competition_id").isin(ids))
    pools = [r.pool for r in chosen.select("pool").distinct().limit(2).collect()]
    if len(pools) != 1:
        raise ValueError("competitions of exactly one pool are needed")
    same = Window.partitionBy(F.lower("competition_name"))
    label = F.when(F.count("*").over(same) > 1, F.concat("competition_name", F.lit(" ("), "country", F.lit(")"))).otherwise(F.col("competition_name"))
    return pools[0], chosen.withColumn("label", label)


def same_parameters(a: Ruleset, b: Ruleset) -> bool:
    """Whether two rulesets rate alike, whatever their names."""
    return astuple(a)[1:] == astuple(b)[1:]
