"""Readers of result files: CSV archives, nested JSON, delimited feeds, HTML schedules and score matrices; and the report sink."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import short_hash

API = (
    "response array<struct<id:bigint,date:string,status:struct<long:string>,teams:struct<home:struct<id:bigint,name:string>,away:struct<id:bigint,name:string>>,"
    "scores:struct<home:struct<total:string>,away:struct<total:string>>>>, paging struct<current:int,total:int>"
)


def read_archive(spark: SparkSession, path: str, required: list[str], sha256: str | None = None) -> DataFrame:
    """A CSV archive with a header as strings; raises if its SHA-256 or a required column is missing."""
    if sha256 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).filter(F.col("h") != sha256).limit(1).count()
        if found:
            raise ValueError(f"{path} has another checksum")
    rows = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return rows


def archive_games(rows: DataFrame) -> DataFrame:
    """Games of an archive with a row for each side: originals of one league, dates written M/d/yyyy."""
    own = rows.filter("lg_id = 'NBA' and _iscopy = '0'")
    return own.select(
        "game_id", F.to_date("date_game", "M/d/yyyy").alias("game_date"), F.col("year_id").cast("int").alias("year"), "fran_id", "opp_fran",
        F.col("pts").try_cast("int").alias("home_score"), F.col("opp_pts").try_cast("int").alias("away_score"),
    )


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once: an archive must have none."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def last_row_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by file order, which `order` gives."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def api_games(pages: DataFrame, column: str = "body") -> DataFrame:
    """Games of an API's JSON pages; unknown keys are passed over, scores may be numbers or text, broken pages give nothing."""
    body = pages.select(F.from_json(column, API).alias("b"))
    g = body.select(F.explode("b.response").alias("g"))
    return g.select(
        F.col("g.id").alias("game_id"), F.col("g.date").alias("game_date"), F.col("g.status.long").alias("status"), F.col("g.teams.home.name").alias("home"), F.col("g.teams.away.name").alias("away"),
        F.col("g.scores.home.total").try_cast("int").alias("home_score"), F.col("g.scores.away.total").try_cast("int").alias("away_score"),
    )


def api_gaps(pages: DataFrame, request: list[str], column: str = "body") -> DataFrame:
    """Pages of an API's answers that give no games: (request.., page, reason), for bodies that aren't JSON, answers with errors, and pages up to the total of which there is none.

    pages(request.., page, body); an empty list or object of errors is no error. The total is the largest that a page of the request names.
    """
    b = F.from_json(column, "errors string, paging struct<total:int>")
    read = pages.select(*request, "page", b.alias("b"), F.coalesce(F.try_parse_json(column).isNull(), F.lit(True)).alias("broken"))
    errors = F.trim("b.errors")
    bad = F.when(F.col("broken"), "not JSON").when(~errors.isin("[]", "{}", "", "null"), F.concat(F.lit("errors: "), errors))
    asked = read.groupBy(*request).agg(F.max("b.paging.total").alias("total")).filter("total > 0").select(*request, F.explode(F.sequence(F.lit(1), "total")).alias("page"))
    absent = asked.join(read.select(*request, "page"), [*request, "page"], "left_anti").withColumn("reason", F.lit("missing"))
    return read.select(*request, F.col("page").cast("int").alias("page"), bad.alias("reason")).filter("reason is not null").unionByName(absent)


def delimited_records(feeds: DataFrame, column: str = "feed") -> DataFrame:
    """(fields map) for each record of a feed: records begin with ~, fields end with ¬ and have ÷ between key and value; of equal keys the first counts."""
    record = F.explode(F.filter(F.split(column, "~"), lambda r: F.contains(r, F.lit("÷")))).alias("record")
    pairs = F.transform(F.filter(F.split("record", "¬"), lambda f: F.contains(f, F.lit("÷"))), lambda f: F.struct(F.split_part(f, F.lit("÷"), F.lit(1)).alias("k"), F.split_part(f, F.lit("÷"), F.lit(2)).alias("v")))
    first = F.aggregate("pairs", F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))
    return feeds.select(*[c for c in feeds.columns if c != column], record).withColumn("pairs", pairs).select(*[c for c in feeds.columns if c != column], first.alias("fields"))


def feed_games(records: DataFrame) -> DataFrame:
    """Games of delimited records: id AA, epoch seconds AD as a day at noon UTC, teams AE and AF, scores AG and AH."""
    f = lambda k: F.element_at("fields", F.lit(k))
    day = F.to_date(F.timestamp_seconds(f("AD").try_cast("long")))
    return records.select(
        f("AA").alias("source_game_id"), day.alias("game_date"), f("AE").alias("home"), f("AF").alias("away"), f("AG").try_cast("int").alias("home_score"), f("AH").try_cast("int").alias("away_score")
    ).filter("source_game_id is not null")


class _Cells(HTMLParser):
    """Cells of table rows by their data-stat attribute, or in order where they have none."""

    def __init__(self):
        super().__init__()
        self.rows, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append({})
        elif tag in ("td", "th") and self.rows:
            self.cell = dict(attrs).get("data-stat") or str(len(self.rows[-1]))
            self.rows[-1][self.cell] = ""

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.rows[-1][self.cell] += data.strip()


#: Pages of nothing but plain tags, text without entities, and attributes in double quotes; the parser would see in them just what the second pattern finds.
_TAGS = "table|thead|tbody|tfoot|caption|tr|td|th|a|b|i|em|strong|p|div|span|ul|ol|li"
PLAIN = re.compile(rf'(?:[^<&]++|<(?:{_TAGS})(?: [a-z-]++="[^"<>&]*+")*+>|</(?:{_TAGS})>)*+')
TAG = re.compile(r'<(/?)([a-z]+)([^>]*)>([^<]*)')
ATTRIBUTE = re.compile(r'([a-z-]+)="([^"]*)"')


def _plain_cells(html: str) -> list[dict]:
    """The rows that _Cells finds in a page that PLAIN matches."""
    rows, cell = [], None
    for end, tag, attributes, text in TAG.findall(html):
        if tag == "td" or tag == "th":
            if end:
                cell = None
            elif rows:
                cell = dict(ATTRIBUTE.findall(attributes)).get("data-stat") or str(len(rows[-1]))
                rows[-1][cell] = ""
        elif tag == "tr":
            if end:
                cell = None
            else:
                rows.append({})
        if text and cell is not None:
            rows[-1][cell] += text.strip()
    return rows


def _cells(html: str) -> list[dict]:
    if PLAIN.fullmatch(html):
        return _plain_cells(html)
    parser = _Cells()
    parser.feed(html)
    return parser.rows


def table_rows(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """(key, row_no, cells map) for each table row of each page."""

    def run(batches):
        for batch in batches:
            keys, numbers, names, values, ends = [], [], [], [], [0]
            for k, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, cells in enumerate(_cells(html or "")):
                    if cells:
                        keys.append(k)
                        numbers.append(i)
                        names += cells.keys()
                        values += cells.values()
                        ends.append(len(names))
            cells = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), cells], ["page", "row_no", "cells"])

    return pages.select(F.col(key).cast("string").alias("page"), F.col(column).alias("html")).mapInArrow(run, "page string, row_no int, cells map<string,string>")


def schedule_games(rows: DataFrame) -> DataFrame:
    """Games of schedule rows by data-stat cells: finished if both scores are there, else by the remarks; the id is a hash of page, day, teams and row."""
    c = lambda k: F.element_at("cells", F.lit(k))
    home, away = c("home_pts").try_cast("int"), c("visitor_pts").try_cast("int")
    remarks = F.lower(F.coalesce(c("game_remarks"), F.lit("")))
    status = (
        F.when(home.isNotNull() & away.isNotNull(), "finished").when(F.contains(remarks, F.lit("postponed")), "postponed").when(F.contains(remarks, F.lit("cancel")), "canceled").otherwise("scheduled")
    )
    day = F.try_to_date(c("date_game"), "yyyy-MM-dd")
    return rows.filter(c("home_team_name").isNotNull() & day.isNotNull()).select(
        "page", short_hash(F.col("page"), c("date_game"), c("home_team_name"), c("visitor_team_name"), F.col("row_no").cast("string")).alias("source_game_id"), day.alias("game_date"),
        c("home_team_name").alias("home"), c("visitor_team_name").alias("away"), home.alias("home_score"), away.alias("away_score"), status.alias("status"),
    )


def matrix_games(rows: DataFrame) -> DataFrame:
    """Directed games of score matrices (page, row_no, team, cells array in the order of the teams): home in rows; only full matrices count."""
    cells = rows.select("page", "row_no", "team", F.posexplode("cells").alias("col", "cell")).filter("col <> row_no")
    score = cells.withColumns({"hs": F.regexp_extract("cell", r"^\s*(\d+)\s*[-:]\s*(\d+)\s*$", 1).try_cast("int"), "aw": F.regexp_extract("cell", r"^\s*(\d+)\s*[-:]\s*(\d+)\s*$", 2).try_cast("int")})
    teams = rows.select("page", F.col("row_no").alias("col"), F.col("team").alias("away"))
    good = score.filter("hs is not null").join(teams, ["page", "col"])
    whole = Window.partitionBy("page")
    n = rows.groupBy("page").agg(F.count("*").alias("n"))
    full = good.withColumn("got", F.count("*").over(whole)).join(n, "page").filter(F.col("got") == F.col("n") * (F.col("n") - 1))
    return full.select("page", F.col("team").alias("home"), "away", F.col("hs").alias("home_score"), F.col("aw").alias("away_score"))


def round_robin(n: int) -> list[tuple[int, int, int]]:
    """(round, home, away) of a single round robin of n teams by the circle method."""
    size = n + n % 2
    out = []
    for r in range(size - 1):
        ring = [0, *(1 + (k + r) % (size - 1) for k in range(size - 1))]
        out += [(r + 1, *(pair if (r + i) % 2 == 0 else pair[::-1])) for i in range(size // 2) if max(pair := (ring[i], ring[size - 1 - i])) < n]
    return out


def scheduled(games: DataFrame, teams: DataFrame, offsets: list[int], month: int = 9, day: int = 30) -> DataFrame:
    """Games of full matrices with the round and day that the circle method gives them; pages with an odd number of teams or a game missing give none.

    games(page, start_year, home, away, ..) directed, each pair twice; teams(page, row_no, team) in the order of the matrix, from 0. The first team stays in its place while
    the others move on by one a round, so the round of two teams follows from their numbers: it is where their places add up to the number of teams less one. The game at the team that
    is first by name comes in the first half of the season, the other as much later. Rounds begin with the Saturday on or before the given day; offsets has each round's days from it, the last
    one counting for all rounds beyond.
    """
    size = teams.groupBy("page").agg(F.count("*").alias("n"), F.count_distinct("row_no").alias("rows"), F.count_distinct("team").alias("names"))
    number = lambda side: teams.select("page", F.col("team").alias(side), F.col("row_no").alias(f"_{side}_no"))
    got = games.filter("home <> away").groupBy("page").agg(F.count_distinct("home", "away").alias("got"), F.count("*").alias("rows_got"))
    whole = size.join(got, "page").filter("n % 2 = 0 and rows = n and names = n and got = n * (n - 1) and rows_got = got").select("page", "n")
    own = games.join(whole, "page").join(number("home"), ["page", "home"]).join(number("away"), ["page", "away"])
    lo, hi, n = F.least("_home_no", "_away_no"), F.greatest("_home_no", "_away_no"), F.col("n")
    first = F.when(lo == 0, F.pmod(-hi, n - 1)).otherwise(F.pmod(-(lo + hi) * (n / 2).cast("long"), n - 1))
    round_no = (1 + first + F.when(F.col("home") > F.col("away"), n - 1).otherwise(0)).cast("int")
    start = F.make_date("start_year", F.lit(month), F.lit(day))
    saturday = F.date_sub(start, F.dayofweek(start) % 7)
    days = F.element_at(F.array(*map(F.lit, offsets)), F.least("round_no", F.lit(len(offsets))))
    return own.withColumn("round_no", round_no).withColumn("game_date", F.date_add(saturday, days)).drop("n", "_home_no", "_away_no")


def repaired_dates(games: DataFrame, keys: list[str]) -> DataFrame:
    """Missing dates of a round taken from its one known date; rounds with several stay as they are."""
    w = Window.partitionBy(*keys)
    known = F.min("game_date").over(w)
    return games.withColumn("game_date", F.when(known == F.max("game_date").over(w), known).otherwise(F.col("game_date")))


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as JSON lines, or as CSV with every value quoted."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    else:
        rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
