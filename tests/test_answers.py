"""Newspaper text and composed answers: names spoiled by scanning, reasons of rejection, filters of the browser, eras."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from courtfold.functions.text import SERBIAN
from courtfold.operators import answers as A
from courtfold.sources.newspaper import newspaper_results

CLUBS = [(1, "Crvena zvezda"), (2, "Partizan"), (3, "Vojvodina"), (4, "Kolubara"), (5, "Radnički"), (6, "Beovuk A"), (7, "Beovuk B"), (8, "Iva")]


def read(spark, text, clubs=CLUBS, published=date(1995, 3, 13)):
    articles = spark.createDataFrame([("p", published, text)], "page string, published date, text string")
    rows = newspaper_results(articles, spark.createDataFrame(clubs, "team_id long, name string"), SERBIAN).orderBy("line_no", "nth").collect()
    return [(r.round_name, r.game_date, r.home_id, r.away_id, r.home_score, r.away_score, r.reason) for r in rows]


def test_rounds_days_and_spoiled_names(spark):
    day, other = date(1995, 3, 13), date(1995, 3, 11)
    text = "Vojvodina Kolubara 87:68\n 14. KOLO:\nCrvena zve zda\u0096Partizan 90 : 85\n11. 3. 1995.\nCrvenazvezda - Partlzan 70-71, Radnicki Kolubra 99:98\n31.2.1995\nЦрвена звезда — Војводина 81:80"
    assert read(spark, text) == [
        (None, day, 3, 4, 87, 68, None), ("14", day, 1, 2, 90, 85, None), ("14", other, 1, 2, 70, 71, None), ("14", other, 5, 4, 99, 98, None),
        ("14", other, None, None, None, None, "no score"), ("14", other, 1, 3, 81, 80, None),
    ]


def test_what_is_rejected_and_why(spark):
    text = "Partizan 14:70\nOlimpija - Partizan 80:70\nBeovuk C - Partizan 80:70\nPartizan - Partizan 80:70\nIvo - Partizan 80:70\nVojvodina - Partizan 80:70\nVojvodina Partizan 80:70\n\nPartizan beat Vojvodina\nPartizan 1280:70"
    assert [r[2:4] + r[6:] for r in read(spark, text)] == [
        (None, None, "score out of range"), (None, None, "fewer than two teams"), (None, None, "ambiguous name"), (None, None, "one team twice"), (None, None, "fewer than two teams"),
        (3, 2, None), (3, 2, "repeated"), (None, None, "no score"), (None, None, "no score"),
    ]


def test_no_text_no_names(spark):
    assert read(spark, None) == [] and read(spark, "") == []
    assert [r[6] for r in read(spark, "Partizan - Iva 80:70", [])] == ["fewer than two teams"]
    assert [r[6] for r in read(spark, "Partizan - Iva 80:70", [(1, None), (2, "-")])] == ["fewer than two teams"]
    none = spark.createDataFrame([], "page string, published date, text string")
    assert newspaper_results(none, spark.createDataFrame(CLUBS, "team_id long, name string")).count() == 0


def test_browser_filters_and_reasons(spark):
    games = spark.createDataFrame([
        (1, 1, 1, 2, "1997-1998", "s", date(1998, 1, 1), 80, 70, "finished", True, None), (2, 1, 2, 1, "1997", "s", date(1997, 12, 31), None, 70, "Final", False, "double"),
        (3, 2, 1, 9, "1998-1999", "t", date(1998, 12, 31), None, None, "scheduled", True, None), (4, 9, 2, 3, "1998-1999", "t", date(1999, 1, 1), None, None, "Postponed", False, " "),
    ], "game_id long, competition_id long, home_id long, away_id long, season string, source string, game_date date, home_score long, away_score long, status string, eligible boolean, exclusion_reason string")
    teams = spark.createDataFrame([(1, "Alfa"), (2, "Beta"), (3, None)], "team_id long, team_name string")
    leagues = spark.createDataFrame([(1, "Liga", "GR"), (2, "Kup", "UK")], "competition_id long, competition_name string, country string")
    named = A.named_games(games, teams, leagues, F.lit(date(1999, 1, 2)))
    ids = lambda **kw: sorted(r.game_id for r in A.browse(named, **kw).collect())
    assert {r.game_id: r.reasons for r in named.collect()} == {1: [], 2: ["Excluded from ELO: double", A.NO_SCORE], 3: [], 4: []}
    assert ids() == ids(search=" ", team="", country=" ") == [1, 2, 3, 4]
    assert ids(country="EL") == [1, 2] and ids(country="GB") == [3] and ids(league=" Kup ") == [3] and ids(season="1997-1998") == [1, 2] and ids(year=1998) == [1, 3]
    assert ids(team="_lf") == [1, 2, 3] and ids(team="alfa", team_id=3) == [4] and ids(search="kup") == [3] and ids(search="POST") == [4] and ids(search="97-1") == [1]
    assert ids(first=date(1998, 1, 1), last=date(1998, 12, 31)) == [1, 3]
    assert A.browse_summary(named, A.browse(named, league="Liga")).first().asDict() == {
        "n_all": 4, "n_kept": 2, "n_finished": 2, "n_open": 0, "n_review": 1, "first_date": date(1997, 12, 31), "last_date": date(1998, 1, 1)}
    assert {(r.kind, r.value, r.n) for r in A.browse_options(named).filter("kind in ('country', 'year')").collect()} == {
        ("country", "GR", 2), ("country", "UK", 1), ("year", "1997", 1), ("year", "1998", 2), ("year", "1999", 1)}


def test_eras(spark):
    labels = {"1945-1946": None, "1946-1947": 340, "1949-1950": 540, "1960-1961": 280, "1998-1999": 760, "2011-2012": 1020, "2012-2013": 1250, "2019-2020": 1080, "2030-2031": 1250}
    rows = spark.createDataFrame([(k, 1000, True) for k in labels], "season string, n long, low boolean")
    assert [r[0] for r in rows.select(A.least_games(F.col("season"))).collect()] == list(labels.values())
    assert [r.low for r in A.low_by_era(rows, F.lit(True)).collect()] == [v is not None and v > 1000 for v in labels.values()]
    assert all(r.low for r in A.low_by_era(rows, F.lit(False)).collect())


def test_pieces_of_an_article_carry_rounds_and_days(spark):
    lines = ["5. kolo", "Partizan Vojvodina 80:70", "11. 3. 1995.", "prose", "Kolubara - Partizan 90:80", "6. KOLO", "Iva Partizan 70:71", "Kolubara - Partizan 90:80", "Partizan Vojvodina 80:70"]
    clubs = spark.createDataFrame(CLUBS, "team_id long, name string")
    got = []
    for size in (1, 2, 9):
        pieces = [("p", date(1995, 3, 13), k, "\n".join(lines[k : k + size])) for k in range(0, 9, size)]
        articles = spark.createDataFrame(pieces + [("q", date(1995, 3, 14), 0, "Iva Partizan 70:71")], "page string, published date, piece long, text string").repartition(3)
        rows = newspaper_results(articles, clubs).orderBy("page", "piece", "line_no", "nth").collect()
        got.append([(r.page, r.round_name, str(r.game_date), r.home_id, r.away_id, r.reason) for r in rows])
    assert got[0] == got[1] == got[2] == [
        ("p", "5", "1995-03-13", 2, 3, None), ("p", "5", "1995-03-11", None, None, "no score"), ("p", "5", "1995-03-11", 4, 2, None), ("p", "6", "1995-03-11", 8, 2, None),
        ("p", "6", "1995-03-11", 4, 2, "repeated"), ("p", "6", "1995-03-11", 2, 3, None), ("q", None, "1995-03-14", 8, 2, None),
    ]
