"""Findings about identities: every rule on literal rows, decisions, states, empty and null input."""

from __future__ import annotations

from datetime import date

import pytest

from courtfold.operators import health as H

TEAMS, ALIASES = "team_id long, team_name string, country string, is_active boolean", "team_id long, source string, source_team_id string, alias_name string"
GAMES, LEAGUES, SEASONS = "game_id long, home_id long, away_id long, competition_id long, season string, game_date date", "competition_id long, country string", "competition_id long, season string, first date, last date"


@pytest.fixture(scope="module")
def tables(spark):
    teams = [(1, "A", None, True), (2, "B", "FR", True), (3, "C", "DE", True), (4, "D", " ", False), (5, "E", "UNK", True)]
    aliases = [(1, "x", "1", "Real Madrid"), (2, "x", "2", "Real Madrit"), (3, "y", "3", "Real Madrid BC"), (4, "x", "1", "Zalgiris"), (4, "x", "9", "Zalgiris "), (4, "x", "9", "ZALGIRIS"), (5, "z", "5", None), (5, "z", "6", "One"), (5, "z", "6", "Two")]
    games = [(1, 1, 9, 7, "2000", date(2000, 5, 1)), (2, 2, 9, 7, "2001", date(2001, 5, 1)), (3, 3, 8, 8, "2001", date(2001, 5, 1)), (4, None, 1, 7, "2000", None)]
    seasons = [(7, "2000", date(2000, 1, 1), date(2000, 12, 1)), (7, "2001", date(2001, 1, 1), date(2001, 12, 1)), (8, "2001", None, None)]
    return [spark.createDataFrame(r, s) for r, s in ((teams, TEAMS), (aliases, ALIASES), (games, GAMES), ([(7, "FR"), (8, None)], LEAGUES), (seasons, SEASONS))]


def kinds(rows):
    return sorted((r.finding_type, r.team_id, r.other_id) for r in rows.collect())


def test_rules(tables):
    f = H.all_findings(*tables)
    assert kinds(f) == [
        ("alias_observation", 5, None), ("missing_metadata", 1, None), ("missing_metadata", 4, None), ("missing_metadata", 5, None), ("possible_cross_season_split", 1, 2), ("possible_duplicate", 1, 2), ("source_team_split", 1, 4)]
    assert {r.team_id: r.suggestion for r in f.collect() if r.finding_type == "missing_metadata"} == {1: "FR", 4: None, 5: None}
    state = H.check_state(f).first()
    assert (state.n_findings, state.n_blockers, state.state) == (7, 3, "blockers")
    assert H.check_state(f.filter("severity = 'warning'")).first().state == "warnings" and H.check_state(f.filter("false")).first().state == "clean"


def test_decisions(spark, tables):
    f = H.all_findings(*tables)
    decisions = "decision string, action string, left_id long, right_id long"
    apart = spark.createDataFrame([("else", "keep_separate", 2, 1), (None, "keep_separate", None, 4)], decisions)
    assert [k for k in kinds(H.undecided(f, apart)) if k[2]] == [("source_team_split", 1, 4)]
    one = f.filter("finding_type = 'possible_cross_season_split'").first().decision
    assert one == "possible_cross_season_split|1:2|7"
    assert len(kinds(H.undecided(f, spark.createDataFrame([(one, "accept", 1, 2)], decisions)))) == 6


def test_candidates(tables):
    teams, aliases, games, *_ = tables
    f = H.all_findings(*tables).selectExpr("*", "'open' as status")
    rows = H.review_candidates(f, teams, aliases, games).collect()
    assert [(r.left_id, r.right_id, r.types, r.n, r.left_n_games, r.right_n_aliases) for r in rows] == [(1, 2, "possible_cross_season_split,possible_duplicate", 2, 2, 1)]
    assert H.review_candidates(f, teams, aliases, games, country="DE").count() == 0 and H.review_candidates(f, teams, aliases, games, country="fr", status="all").count() == 1


def test_empty(spark):
    empty = [spark.createDataFrame([], s) for s in (TEAMS, ALIASES, GAMES, LEAGUES, SEASONS)]
    f = H.all_findings(*empty)
    assert f.count() == 0 and H.check_state(f).first().state == "clean"
