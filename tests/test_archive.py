"""Archives of linked pages: literal pages, gaps, empty and null input."""

from __future__ import annotations

from datetime import datetime

from courtfold.sources import archive as S
from courtfold.sources import files

WANTED, SLUGS, PAGES, PARTS = "league string, edition int, seed string", "league string, slug string, keep string, leave string", "path string, body string", "round_id string, kind string, number int, body string"
HOST = "https://archive.example"


def card(ident, home="Home", away="Away", score="80 : 70", time="9:05", day="2001-03-04"):
    team = lambda c, name: f'<div class="gsa-c-match-{c}"><span class="gsa-c-team_full">{name}</span><span class="gsa-c-team_tla">xyz</span></div>'
    return f'<a class="m" href="{HOST}/match/basketball/{day}/a/{ident}/"><div class="gsa-c-match-c1">{time}</div>{team("c2", home)}<div class="gsa-c-match-c3">{score}</div>{team("c4", away)}</a>'


def read(spark, wanted, slugs, pages, parts=(), teams=None):
    games, gaps = S.read_editions(*(spark.createDataFrame(list(rows), schema) for rows, schema in ((wanted, WANTED), (slugs, SLUGS), (pages, PAGES), (parts, PARTS))), teams)
    return sorted(games.collect(), key=lambda r: (r.league, r.source_game_id)), sorted(map(tuple, gaps.collect()), key=repr)


def test_stages_found_from_the_seed_and_from_the_first_stage(spark):
    base = "/competition/basketball/big-cup-2001-paris"
    pages = [
        ("/seed", f"<a href='{HOST}{base}/final/12/'>F</a><a href='{base}/group-stage/11/'>G</a><a href='/competition/basketball/big-cup-1999/final/9/'>old</a>"),
        (f"{base}/group-stage/11/", f"<a href='//archive.example{base}/3rd-place/13/'>3</a>" + card(1) + card(2, score="") + card(3, home="") + card(4, time="later")),
        (f"{base}/final/12/", f"<a href='{base}/7th-place/99/'>not followed</a>" + card(1, score="90:91")),
    ]
    games, gaps = read(spark, [("big", 2001, "/seed")], [("big", "big-cup", None, None)], pages)
    assert [(g.source_game_id, g.home_score, g.away_score, g.status, g.phase, g.round_name) for g in games] == [
        ("gsa-1", 90, 91, "finished", "Final Phase", "Final"), ("gsa-2", None, None, "score_pending", "Group Stage", "Group Stage"), ("gsa-4", 80, 70, "finished", "Group Stage", "Group Stage")]
    assert games[0].game_ts == datetime(2001, 3, 4, 9, 5) and games[2].game_ts == datetime(2001, 3, 4)
    assert games[0].home_source_id == "GSA-HOME" and games[0].home_country == "XYZ"
    assert [(g[3], g[4], g[5]) for g in gaps] == [("stage", 0, "not on disk"), ("card", 2, "no final score"), ("card", 3, "a team is missing"), ("card", 4, "unknown time")]
    assert gaps[0][2] == f"{base}/3rd-place/13/"


def test_one_archive_is_dealt_to_leagues_by_stage(spark):
    base = "/competition/basketball/cup-2020"
    pages = [("/seed", f"<a href='{base}/pre-qualifiers/1/'></a><a href='{base}/qualifiers/2/'></a>"), (f"{base}/pre-qualifiers/1/", card(1)), (f"{base}/qualifiers/2/", card(2))]
    slugs = [("first", "cup", "pre-qual", None), ("second", "cup", "qualif", "pre-qual")]
    games, gaps = read(spark, [("first", 2020, "/seed"), ("second", 2020, "/seed")], slugs, pages)
    assert [(g.league, g.source_game_id, g.round_name) for g in games] == [("first", "gsa-1", "pre-qualifiers"), ("second", "gsa-2", "qualifiers")] and gaps == []


def test_pages_and_weeks_that_are_not_there_are_named(spark):
    path = "/competition/basketball/cup-2020/final/7/"
    control = '<i onclick="changePage(1, 3)"></i><input id="cur_page" value="2"><input id="maxweek" value="2"><input id="curweek" value="1">'
    parts = [("7", "page", 0, card(1, score="1:2")), ("7", "week", 2, card(1, score="3:4")), ("8", "page", 1, card(5))]
    teams = spark.createDataFrame([("HOME", "h1", "AA"), ("other", "h2", None)], "name string, source_team_id string, country string")
    games, gaps = read(spark, [("cup", 2020, "/seed")], [("cup", "cup", None, None)], [("/seed", f"<a href='{path}'>x</a>"), (path, control + card(1))], parts, teams)
    assert [(g.source_game_id, g.home_score, g.home_source_id, g.home_country, g.away_source_id) for g in games] == [("gsa-1", 3, "h1", "AA", "GSA-AWAY")]
    assert gaps == [("cup", 2020, path, "page", 1, "not on disk")]


def test_editions_without_pages_null_bodies_and_empty_tables(spark):
    wanted = [("cup", 1, None), ("cup", 2, "/gone"), ("cup", 3, "/null"), ("cup", 4, "/bare")]
    games, gaps = read(spark, wanted, [("cup", "cup", None, None)], [("/null", None), ("/bare", ""), (None, None)])
    assert games == [] and [g[1:] for g in gaps] == [(1, None, "edition", 0, "no page is known"), (2, "/gone", "edition", 0, "not on disk"), (3, "/null", "edition", 0, "no stage is linked"), (4, "/bare", "edition", 0, "no stage is linked")]
    assert read(spark, [], [], []) == ([], [])


def test_official_pages(spark):
    data = '{"gameId":5,"gameDateTimeUTC":"2010-05-06T18:30:00Z","teamA":{"teamId":1,"code":null,"officialName":"One"},"teamB":{"teamId":2,"code":"TWO"},"teamAScore":0,"teamBScore":0,"round":{"roundCode":"F","roundName":"Final"}}'
    c = lambda slug, text="": f"<div class='c' data-testid='ui-game-card'><a href='/x/games/{slug}'>{text}</a></div>"
    body = '"eventDateStart":"2010-05-01"' + c("4-aaa-bbb", "<b>A</b> 77 <b>B</b> 66") + "<h2>2 May 2010</h2>" + c("5-one-two", "1 2") + c("6-tbd-bbb") + c("x-aaa-bbb") + c("7-ccc-ddd", "55 44") + "<script>" + data.replace('"', '\\"') + "</script>"
    games, lost = S.official_games(spark.createDataFrame([("p", body), ("q", None), ("r", "")], "path string, body string"))
    got = {g.source_game_id: g for g in games.collect()}
    assert sorted(got) == ["4", "5", "7"]
    assert (got["4"].game_ts, got["4"].home_score, got["4"].away_score, got["4"].home_code) == (datetime(2010, 5, 1), 77, 66, "AAA")
    assert (got["7"].game_ts, got["7"].status) == (datetime(2010, 5, 2), "final")
    assert (got["5"].origin, got["5"].status, got["5"].home_code, got["5"].home_team, got["5"].away_team, got["5"].phase, got["5"].home_score) == ("data", "scheduled", "FIBA:1", "One", "TWO", "Final", None)
    assert sorted(r.reason for r in lost.collect()) == ["a team is undecided", "no game in the link"]


def test_editions_of_a_history(spark):
    body = "<table><tr><td>1993</td><td><a href='/en/history/9-cup/31/games'>a</a><a href='/en/history/8-other/5'>b</a></td></tr><tr><td>1995 and 1997</td><td><a href='https://a.example/en/events/cup-95/'>c</a></td></tr><tr><td>none</td><td><a href='/en/history/9-cup/44'>d</a></td></tr></table>"
    rows = S.official_editions(spark.createDataFrame([("9-cup", body), ("9-cup", None)], "family string, body string")).collect()
    assert sorted(map(tuple, rows)) == [("9-cup", 1993, "/en/history/9-cup/31"), ("9-cup", 1995, "/en/events/cup-95"), ("9-cup", 1997, "/en/events/cup-95")]


def test_api_gaps(spark):
    pages = [("a", 1, '{"errors":[],"paging":{"current":1,"total":3}}'), ("a", 3, "<html>"), ("b", 1, '{"errors":{"token":"bad"}}'), ("c", 1, None), ("d", 1, '{"errors":{},"paging":{"total":1}}')]
    rows = files.api_gaps(spark.createDataFrame(pages, "league string, page int, body string"), ["league"]).collect()
    assert sorted(map(tuple, rows)) == [("a", 2, "missing"), ("a", 3, "not JSON"), ("b", 1, 'errors: {"token":"bad"}'), ("c", 1, "not JSON")]
