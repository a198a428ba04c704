"""Results in scanned newspaper text: rounds and days carried along from headings, spoiled team names, and what can't be read with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import transliterated, without_marks

SCORE = r"(?<!\d)(\d{2,3}) ?[:\-] ?(\d{2,3})(?!\d)"
ROUND = r"(?i)^ ?(\d{1,2}) ?\. ?(?:kolo|round) ?:? ?$"
DAY = r"^ ?(\d{1,2})\. ?(\d{1,2})\. ?(\d{4})\.? ?$"
LEAST, MOST = 40, 160
SHORTEST_SPOILED = 5


def article_lines(articles: DataFrame) -> DataFrame:
    """(page, piece, line_no, line, round_name, game_date) of articles(page, published, text, piece): lines that aren't headings, under the last round and day printed above them.

    An article may come in pieces, in order of `piece`, whole lines each; without that column it is one piece. Where no day is printed, or none that exists, the day of publication stands.
    A piece's lines are one group of a window, and an article's pieces of another, which holds a row for each.
    """
    if "piece" not in articles.columns:
        articles = articles.withColumn("piece", F.lit(0).cast("long"))
    clean = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\u0096‐‑‒–—", "------"), r"[ \t\f\x0B\xA0]+", " ")
    # pieces are few and short to send, so tasks by size would be too few
    dealt = articles.select("page", "piece", "published", "text").repartition(4 * articles.sparkSession.sparkContext.defaultParallelism, "page", "piece")
    lines = dealt.select("page", "piece", "published", F.posexplode(F.split(clean, r"\r?\n")).alias("line_no", "line"))
    part = lambda n: F.regexp_extract("line", DAY, n)
    lines = lines.withColumns({"heading": F.nullif(F.regexp_extract("line", ROUND, 1), F.lit("")), "day": F.try_to_date(F.concat_ws("-", part(3), part(2), part(1)), "yyyy-M-d")})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(f"last_{c}")
    before = Window.partitionBy("page").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = lines.groupBy("page", "piece").agg(last("heading"), last("day"))
    ends = ends.select("page", "piece", *[F.last(f"last_{c}", ignorenulls=True).over(before).alias(f"last_{c}") for c in ("heading", "day")])
    above = Window.partitionBy("page", "piece").orderBy("line_no")
    carried = lines.withColumns({f"own_{c}": F.last(c, ignorenulls=True).over(above) for c in ("heading", "day")}).filter("heading is null and day is null and line rlike '[^ ]'")
    return carried.join(ends, ["page", "piece"]).select(
        "page", "piece", "line_no", "line", F.coalesce("own_heading", "last_heading").alias("round_name"), F.coalesce("own_day", "last_day", "published").alias("game_date"))


def _words(text: Column, letters: dict[str, str]) -> Column:
    return F.filter(F.split(F.upper(without_marks(transliterated(text, letters))), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def _less_one(key: Column) -> Column:
    """The key, and the key without each of its characters if it is long enough to be spoiled: of two keys that differ by one change, some are equal."""
    n = F.length(key)
    fewer = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(key, 1, i - 1), F.substring(key, i + 1, n)))
    return F.array_distinct(F.when(n >= SHORTEST_SPOILED - 1, F.concat(F.array(key), fewer)).otherwise(F.array(key)))


def known_keys(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key, changes, teams): the teams whose names are nearest to each of keys(key), equal to it or one change away; names under five characters must be equal."""
    own = keys.select("key").distinct().select("key", F.explode(_less_one(F.col("key"))).alias("v"))
    known = names.select("team_id", "name").distinct().select("team_id", "name", F.explode(_less_one(F.col("name"))).alias("v"))
    near = own.join(known, "v").select("key", "team_id", F.levenshtein("key", "name").alias("changes"), "name")
    near = near.filter((F.col("changes") == 0) | ((F.col("changes") == 1) & (F.length("name") >= SHORTEST_SPOILED)))
    return near.groupBy("key", "changes").agg(F.collect_set("team_id").alias("teams")).groupBy("key").agg(F.min(F.struct("changes", "teams")).alias("m")).select("key", "m.*")


def newspaper_results(articles: DataFrame, names: DataFrame, letters: dict[str, str] | None = None) -> DataFrame:
    """(page, piece, line_no, nth, round_name, game_date, home_id, away_id, home_score, away_score, reason): every score of every line, accepted where reason is null.

    articles(page, published, text) and a piece, see article_lines(), names(team_id, name); letters says how other scripts are written in Latin. A score belongs to the last two teams named between it and the score
    before it on its line. Names are met as runs of words without the spaces between them, so spaces that scanning lost or added inside a name do no harm, and one changed, lost or
    added letter doesn't either; exact names go first, then earlier and longer ones, none over another. What stands between scores is looked up once, however often it is printed. Reasons: no score, score out of range (columns of a table), fewer than two
    teams, ambiguous name, one team twice, repeated (the same result of a day further down). Null texts have no lines; an empty table gives none.
    """
    letters = letters or {}
    lines = article_lines(articles)
    found = [F.regexp_extract_all("line", F.lit(SCORE), F.lit(n)) for n in (1, 2)]
    scores = lines.withColumns({"hs": found[0], "aw": found[1], "parts": F.split("line", SCORE, -1)})
    score = lambda c, i: F.get(F.col(c), i).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.size("hs") - 1), lambda i: F.struct(i.alias("nth"), F.get("parts", i).alias("part"), score("hs", i).alias("home_score"), score("aw", i).alias("away_score")))
    rows = scores.withColumn("s", F.explode_outer(F.when(F.size("hs") > 0, each))).select("page", "piece", "line_no", "round_name", "game_date", "s.*")

    keyed = names.withColumn("w", _words(F.col("name"), letters)).select("team_id", F.array_join("w", "").alias("name"), F.size("w").alias("n")).filter("name <> ''")
    longest = (keyed.agg(F.max("n")).first()[0] or 0) + 1  # one number; a space may have been added
    printed = rows.filter("nth is not null")
    words = printed.select("part").distinct().select("part", _words(F.col("part"), letters).alias("w"))
    at_most = lambda p: F.least(F.lit(longest), F.size("w") - p + 1)
    runs_at = lambda p: F.transform(F.sequence(F.lit(1), at_most(p)), lambda n: F.struct(p.alias("at"), n.alias("n"), F.array_join(F.slice("w", p, n), "").alias("key")))
    runs = words.filter(F.size("w") > 0).select("part", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), runs_at))).alias("r")).select("part", "r.*")
    met = runs.join(known_keys(runs, keyed), "key")
    hit = F.struct("changes", "at", (-F.col("n")).alias("less"), (F.col("at") + F.col("n")).alias("end"), "teams")
    sorted_ = met.groupBy("part").agg(F.array_sort(F.collect_list(hit)).alias("m"))
    over = lambda acc, x: F.exists(acc, lambda y: (y["at"] < x["end"]) & (x["at"] < y["end"]))
    chosen = F.aggregate("m", F.slice("m", 1, 0), lambda acc, x: F.when(over(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    in_order = F.array_sort(F.transform(chosen, lambda x: F.struct(x["at"].alias("at"), x["teams"].alias("teams"))))
    named = sorted_.select("part", F.slice(F.transform(in_order, lambda x: x["teams"]), -2, 2).alias("t")).filter(F.size("t") == 2)

    both = printed.join(named, "part", "left")
    team = lambda i: F.get(F.get("t", F.lit(i)), F.lit(0))
    reason = (
        F.when(~F.col("home_score").between(LEAST, MOST) | ~F.col("away_score").between(LEAST, MOST), "score out of range")
        .when(F.col("t").isNull(), "fewer than two teams").when(F.exists("t", lambda x: F.size(x) > 1), "ambiguous name").when(team(0) == team(1), "one team twice")
    )
    judged = both.withColumns({"reason": reason, "home_id": F.when(reason.isNull(), team(0)), "away_id": F.when(reason.isNull(), team(1))})
    key = ["game_date", "home_id", "away_id", "home_score", "away_score"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("page", "piece", "line_no", "nth"))
    good = judged.filter("reason is null").withColumn("reason", F.when(first > 1, "repeated"))
    out = ["page", "piece", "line_no", "nth", "round_name", *key, "reason"]
    none = F.lit(None).cast("long")
    bare = rows.filter("nth is null").withColumns({"reason": F.lit("no score"), "home_id": none, "away_id": none})
    return good.select(*out).unionByName(judged.filter("reason is not null").select(*out)).unionByName(bare.select(*out))
