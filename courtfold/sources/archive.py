"""Archives of linked pages: stages and editions found from index pages, the pages they need held against those there are, and the games on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.store import dealt, kept

#: Stages by the order in which their pages are read; others come last. Fixed values.
STAGE_ORDER = {
    "final-round": 0, "group-stage": 0, "main-round": 1, "11th-place": 1, "classification-round": 2, "second-stage": 2, "9th-place": 2, "classification-stage": 3, "15th-place": 3, "7th-place": 3,
    "play-off-round": 4, "13th-place": 4, "5th-place": 4, "quarter-finals": 5, "semi-finals": 5, "3rd-place": 6, "final": 7,
}
#: Phase and round of stages; others are rounds of the final phase. Fixed values.
STAGE_NAMES = {
    "group-stage": ("Group Stage", "Group Stage"), "final-round": ("Final Round", "Final Round"), "semi-finals": ("Final Phase", "Semi-finals"), "final": ("Final Phase", "Final"),
    "3rd-place": ("Classification Round", "3rd Place"), "5th-place": ("Classification Round", "5th Place"), "7th-place": ("Classification Round", "7th Place"),
    "9th-place": ("Classification Round", "9th Place"), "11th-place": ("Classification Round", "11th Place"),
}
NO_FINAL_SCORE = "source_missing_final_score"  # fixed value

#: Pages are met by so many keys at most without being moved. Fixed value.
KEYS = 100_000

LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["'](?:https?:)?(?://[^/"']+)?(/?competition/basketball/[^"'?#]+)"""
STAGE = r"(?i)competition/basketball/([^/]+?)-(\d{4})(?:-[^/]+)?/([^/]+)/(\d+)/"
CARD = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'][^"']*/match/basketball/.*?</a>"""
CELL = r"""(?is)<(?:div|span)\b[^>]*\b(?:{})\b[^>]*>.*?(?=<(?:div|span)\b[^>]*\b(?:gsa-c-match-c\d|team_[ab]_name|match_score|match_time)\b|</a>)"""


def _values(pairs: dict[str, Column], key: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), key)


def _plain(text: Column) -> Column:
    """Text of a piece of HTML: no tags, one space, the five named entities, no-break space and apostrophe by number."""
    out = F.regexp_replace(text, "<[^>]*>", " ")
    for name, letter in (("&nbsp;|&#160;", " "), ("&#0?39;|&apos;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.regexp_replace(out, name, letter)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _group(text: Column, pattern: str, n: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def _once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows with columns that are worked out once a row, however often they are used above; withColumns alone would repeat their patterns in each use."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def stage_links(pages: DataFrame) -> DataFrame:
    """(page, path, slug, edition, stage, round_id): the stages that pages(path, body) link to, each once a page; hosts of links are left away."""
    href = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)))).alias("href")
    part = lambda n: F.regexp_extract("href", STAGE, n)
    links = pages.select(F.col("path").alias("page"), href).filter(F.regexp_like("href", F.lit(STAGE)))
    return links.select(
        "page", F.concat(F.lit("/"), F.ltrim(F.col("href"), F.lit("/"))).alias("path"), F.lower(part(1)).alias("slug"), part(2).cast("int").alias("edition"), F.lower(part(3)).alias("stage"), part(4).alias("round_id"))


def _in_pieces(pages: DataFrame) -> DataFrame:
    """pages with a column piece: pages may come in several pieces with a number each, cut between cards, as a page's text is one value; one without it is a page's only one."""
    return pages if "piece" in pages.columns else pages.withColumn("piece", F.lit(0))


def _few(keys: DataFrame) -> DataFrame:
    """Kept keys as the right side of a join with pages: up to KEYS go to where the pages lie; more are exchanged with them, and pages are streamed past. Neither way holds the pieces of a page at once, as a join that broadcasts pages or keeps those of one key would."""
    return F.broadcast(keys) if keys.count() <= KEYS else dealt(keys)


def edition_stages(wanted: DataFrame, slugs: DataFrame, pages: DataFrame) -> DataFrame:
    """Stages of wanted(league, edition, seed): those that the seed's page links to, and those that the page of the first of them does.

    slugs(league, slug, keep, leave) names what a league is called in paths, and patterns of the stages that are its own and that aren't; null patterns decide nothing, so one archive can be
    dealt to several leagues. pages(path, body) are those that are on disk; only the pages that are followed are searched for links.
    """
    def followed(start):
        links = stage_links(pages.join(_few(kept(start.select(F.col("page").alias("path")).distinct())), "path", "left_semi"))
        own = start.join(slugs, "league").join(links, ["page", "slug", "edition"])
        mine = F.coalesce(F.regexp_like("stage", F.col("keep")), F.lit(True)) & ~F.coalesce(F.regexp_like("stage", F.col("leave")), F.lit(False))
        order = F.coalesce(_values({k: F.lit(v) for k, v in STAGE_ORDER.items()}, F.col("stage")), F.lit(8)).alias("stage_order")
        return own.filter(mine).select("league", "edition", "path", "stage", "round_id", order).distinct()

    found = kept(followed(wanted.filter("seed is not null").select("league", "edition", F.col("seed").alias("page"))))
    first = found.groupBy("league", "edition").agg(F.min_by("path", F.struct("stage_order", F.lower("path"))).alias("page"))
    return kept(found.unionByName(followed(first)).distinct())


def wanted_parts(stages: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stages' own pages that are on disk (league, edition, .., piece, kind, number, body), kind `stage`, and all others without text: kind `stage` for pages that aren't on disk, `page` and `week` for those that the own pages name.

    Pages are numbered from 0 to the most that a control names, weeks from 1; the page's own page and week aren't wanted again. Of a page in pieces one has all controls. stages are kept.
    """
    most = F.array_max(F.transform(F.regexp_extract_all("body", F.lit(r"(?i)changePage\([^,]+,\s*(\d+)\)"), F.lit(1)), lambda x: x.try_cast("int")))
    field = lambda name, otherwise: F.coalesce(_group(F.col("body"), rf"""(?i)id=["']{name}["']\s+value=["'](\d+)["']""").try_cast("int"), F.lit(otherwise))
    columns = ["league", "edition", "path", "stage", "stage_order", "round_id", "piece"]
    stage = [F.lit("stage").alias("kind"), F.lit(0).alias("number")]
    own = _in_pieces(pages).select("path", "piece", "body").join(_few(stages), "path").select(*columns, "body")
    there = own.filter("body is not null")
    read = _once(there, {"n_pages": F.coalesce(most, F.lit(1)), "own_page": field("cur_page", 0), "n_weeks": F.greatest(field("maxweek", 1), F.lit(1)), "own_week": field("curweek", 1)}).drop("body")
    upto = lambda kind, first, last, own: F.transform(
        F.array_remove(F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>")), F.col(own)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("number")))
    others = read.select(*columns, F.inline(F.concat(upto("page", 0, F.col("n_pages") - 1, "own_page"), upto("week", 1, F.col("n_weeks"), "own_week"))))
    gone = stages.join(dealt(pages.select("path").distinct()), "path", "left_anti").withColumn("piece", F.lit(None).cast(own.schema["piece"].dataType))
    gone = gone.select(*columns).unionByName(own.filter("body is null").select(*columns)).select(*columns, *stage)
    return there.select(*columns, *stage, "body"), kept(others.unionByName(gone))


def match_cards(parts: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """Match cards on parts(.., body) with a `problem` where something of them can't be read; problems other than `no final score` and `unknown time` leave no game.

    teams(name, source_team_id, country) says which names are known; others get an id by the number in the card, or else by the name's letters.
    """
    cells = {"clock": "gsa-c-match-c1|match_time", "home": "gsa-c-match-c2|team_a_name", "score": "gsa-c-match-c3|match_score", "away": "gsa-c-match-c4|team_b_name"}
    c = parts.select(*[F.col(x) for x in parts.columns if x != "body"], F.posexplode(F.regexp_extract_all("body", F.lit(CARD), F.lit(0))).alias("at", "card"))
    c = _once(c, {"href": F.regexp_extract("card", r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1), **{k: F.regexp_extract("card", CELL.format(v), 0) for k, v in cells.items()}}).drop("card")
    span = lambda side, name: F.nullif(_plain(F.regexp_extract(side, rf"""(?is)<span\b[^>]*{name}[^>]*>(.*?)</span>""", 1)), F.lit(""))
    c = _once(c, {
        "match_id": _group(F.col("href"), r"(?i)/match/basketball/[^/]+/[^/]+/(\d+)"), "day": F.try_to_timestamp(F.regexp_extract("href", r"/match/basketball/(\d{4}-\d{2}-\d{2})/", 1), F.lit("yyyy-MM-dd")),
        "hour": _plain(F.col("clock")), "result": F.split(F.regexp_extract(_plain(F.col("score")), r"(\d+\s*:\s*\d+)", 1), r"\s*:\s*"),
        **{f"{s}_team": span(s, "team_full") for s in ("home", "away")}, **{f"{s}_code": span(s, "team_tla") for s in ("home", "away")}, **{f"{s}_no": _group(F.col(s), r"(?i)gotoUrl\((\d+),") for s in ("home", "away")},
    }).drop(*cells)
    points = [F.get("result", F.lit(i)).try_cast("smallint").cast("int") for i in (0, 1)]
    c = _once(c, {"time": F.try_to_timestamp(F.concat(F.date_format("day", "yyyy-MM-dd "), "hour"), F.lit("yyyy-MM-dd H:mm")), "both": F.when(points[0].isNotNull() & points[1].isNotNull(), F.array(*points))}).drop("result")
    problem = F.when(F.col("match_id").isNull() | F.col("day").isNull(), "no id or day in the link").when(F.col("home_team").isNull() | F.col("away_team").isNull(), "a team is missing").when(
        F.col("both").isNull(), "no final score").when(F.col("time").isNull() & (F.col("hour") != ""), "unknown time")
    out = c.withColumns({"problem": problem, "game_ts": F.coalesce("time", "day"), "home_score": F.get("both", F.lit(0)), "away_score": F.get("both", F.lit(1))})
    for s in ("home", "away"):
        letters = F.regexp_replace(F.upper(f"{s}_team"), r"[^\p{L}\p{Nd}]", "")
        own_id = F.concat(F.lit("GSA-"), F.coalesce(f"{s}_no", letters))
        code = F.when(F.length(f"{s}_code") == 3, F.upper(f"{s}_code"))
        if teams is None:
            out = out.withColumns({f"{s}_source_id": own_id, f"{s}_country": code})
            continue
        known = teams.select(F.lower("name").alias("_name"), F.col("source_team_id").alias("_id"), F.col("country").alias("_country"))
        out = out.join(known, F.lower(f"{s}_team") == F.col("_name"), "left").withColumns(
            {f"{s}_source_id": F.coalesce("_id", own_id), f"{s}_country": F.when(F.col("_id").isNull(), code).otherwise(F.col("_country"))}).drop("_name", "_id", "_country")
    return out.drop("hour", "both", "day", "time", "home_no", "away_no", "home_code", "away_code")


def read_editions(wanted: DataFrame, slugs: DataFrame, pages: DataFrame, parts: DataFrame, teams: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Games of the wanted editions, and what is missing of them.

    wanted(league, edition, seed), slugs(league, slug, keep, leave), pages(path, body), parts(round_id, kind, number, body) as fetched, kinds being `page` and `week`; see _in_pieces(). Of cards with one id in
    an edition the last counts, by stages in order, then own page, pages, weeks. Games without final score wait as score_pending. Gaps are (league, edition, path, kind, number, reason).
    """
    stages = edition_stages(wanted, slugs, pages)
    texts, needed = wanted_parts(stages, pages)
    keys = ["round_id", "kind", "number"]
    got = _in_pieces(parts).select(*keys, "body", F.col("piece").alias("own_piece"))
    fetched = got.join(_few(needed), keys).withColumn("piece", F.coalesce("own_piece", "piece")).drop("own_piece")
    # pages are short to send and long to read, so tasks by size would be too few
    read = texts.unionByName(fetched.filter("body is not null")).repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "path", "kind", "number", "piece")
    cards = match_cards(read, teams)
    place = F.struct("stage_order", F.lower("path"), F.when(F.col("kind") == "stage", 0).when(F.col("kind") == "page", 1).otherwise(2), "number", "piece", "at")
    last = Window.partitionBy("league", "edition", "match_id").orderBy(place.desc())
    usable = cards.filter(F.col("problem").isNull() | F.col("problem").isin("no final score", "unknown time"))
    one = usable.withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    open_ = F.col("home_score").isNull() | F.col("away_score").isNull()
    named = lambda i, otherwise: F.coalesce(_values({k: F.lit(v[i]) for k, v in STAGE_NAMES.items()}, F.col("stage")), otherwise)
    games = one.select(
        "league", "edition", F.concat(F.lit("gsa-"), "match_id").alias("source_game_id"), "game_ts", F.when(open_, "score_pending").otherwise("finished").alias("status"),
        F.when(open_, NO_FINAL_SCORE).alias("exclusion_reason"), named(0, F.lit("Final Phase")).alias("phase"), named(1, F.col("stage")).alias("round_name"),
        *[f"{s}_{x}" for s in ("home", "away") for x in ("source_id", "team", "country", "score")],
    )
    none = F.lit(None).cast("string")
    known = wanted.join(stages.select("league", "edition").distinct().withColumn("found", F.lit(True)), ["league", "edition"], "left").filter("found is null")
    seeds = pages.select(F.col("path").alias("seed"), F.lit(True).alias("there")).distinct()
    lost = known.join(seeds, "seed", "left").select(
        "league", "edition", F.col("seed").alias("path"), F.lit("edition").alias("kind"), F.lit(0).alias("number"),
        F.when(F.col("seed").isNull(), "no page is known").when(F.col("there").isNull(), "not on disk").otherwise("no stage is linked").alias("reason"))
    absent = needed.join(dealt(got.select(*keys).distinct()), keys, "left_anti").unionByName(fetched.filter("body is null").drop("body")).select("league", "edition", "path", "kind", "number", F.lit("not on disk").alias("reason"))
    unread = cards.filter("problem is not null").select("league", "edition", F.coalesce("href", none).alias("path"), F.lit("card").alias("kind"), F.coalesce(F.col("match_id").try_cast("int"), F.lit(0)).alias("number"), F.col("problem").alias("reason"))
    return games, lost.unionByName(absent).unionByName(unread)


def official_editions(pages: DataFrame) -> DataFrame:
    """(family, edition, path): events and editions that the rows of history pages(family, body) link to, by every year that a row names; an edition's path ends at its number."""
    row = F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row")
    years = F.explode(F.array_distinct(F.regexp_extract_all(_plain(F.col("row")), F.lit(r"\b(\d{4})\b"), F.lit(1)))).alias("year")
    href = F.explode(F.regexp_extract_all("row", F.lit(r"""(?i)href\s*=\s*["']([^"'?#]+)"""), F.lit(1))).alias("href")
    links = pages.select("family", row).select("family", years, "row").select("family", F.col("year").cast("int").alias("edition"), href)
    path = F.rtrim(F.regexp_replace("href", r"(?i)^https?://[^/]+", ""), F.lit("/"))
    prefix = F.concat(F.lit("/en/history/"), "family", F.lit("/"))
    number = F.split_part(F.substr(path, F.length(prefix) + 1), F.lit("/"), F.lit(1))
    mine = F.startswith(F.lower(path), F.lower(prefix)) & F.regexp_like(number, F.lit(r"^\d+$"))
    own = F.when(F.startswith(F.lower(path), F.lit("/en/events/")), path).when(mine, F.concat(prefix, number))
    return links.select("family", "edition", own.alias("path")).filter("path is not null").distinct()


def _payload(pages: DataFrame) -> DataFrame:
    text = F.replace(F.col("body"), F.lit('\\"'), F.lit('"'))
    r = pages.select("path", "piece", F.posexplode(F.split(text, '"gameId":')).alias("at", "record")).filter("at > 0")
    find = lambda pattern, n=1, of="record": _group(F.col(of), pattern, n)
    sides = {"home": r'(?is)"teamA":\{(.*?)"teamB":', "away": r'(?is)"teamB":\{(.*?)"teamAScore":'}
    r = _once(r, {k: F.regexp_extract("record", v, 1) for k, v in sides.items()})
    for s in sides:
        code = F.nullif(F.trim(find(r'(?i)"code":"([^"]*)"', of=s)), F.lit(""))
        ident = F.coalesce(code, F.concat(F.lit("FIBA:"), find(r'(?i)"teamId":(\d+)', of=s)))
        names = [F.nullif(F.trim(find(rf'(?i)"{k}":"([^"]*)"', of=s)), F.lit("")) for k in ("shortName", "officialName")]
        r = r.withColumns({f"{s}_code": ident, f"{s}_team": F.coalesce(*names, ident)})
    scores = r'(?is)"teamAScore":(-?\d+|null).*?"teamBScore":(-?\d+|null)'
    r = _once(r, {"scored": find(scores).isNotNull(), **{k: find(scores, n).try_cast("smallint").cast("int") for n, k in ((1, "hs"), (2, "aw"))}, "game_ts": find(r'(?i)"gameDateTimeUTC":"([^"]+)"').try_cast("timestamp")})
    hs, aw = F.col("hs"), F.col("aw")
    open_ = hs.isNull() | aw.isNull() | ((hs == 0) & (aw == 0))
    rounds = r'(?is)"round":\{.*?"roundCode":"([^"]*)".*?"roundName":"([^"]*)"'
    games = r.select(
        "path", "piece", "at", find(r"^(\d+)").alias("source_game_id"), "game_ts", F.when(open_, "scheduled").otherwise("final").alias("status"), "home_code", "home_team", "away_code", "away_team",
        F.when(~open_, hs).alias("home_score"), F.when(~open_, aw).alias("away_score"), find(rounds, 2).alias("phase"), find(rounds, 1).alias("round_name"), "scored")
    return games.filter("source_game_id is not null and home_code is not null and away_code is not null and scored and year(game_ts) >= 1900").drop("scored")


def _cards(pages: DataFrame) -> DataFrame:
    """Game cards by the day last named above them; a card is what stands between its mark and the end of its link."""
    mark = r"""(?i)<div\b[^>]*data-testid=["']ui-game-card["'][^>]*>"""
    start = F.try_to_timestamp(_group(F.replace(F.col("body"), F.lit('\\"'), F.lit('"')), r'(?i)eventDateStart"\s*:\s*"(\d{4}-\d{2}-\d{2})'), F.lit("yyyy-MM-dd"))
    c = _once(pages.select("path", "piece", "body"), {"start": start}).select("path", "piece", "start", F.posexplode(F.split("body", mark)).alias("at", "text"))
    c, split = _once(c, {"split": F.split("text", "(?i)</a>", 2)}), F.col("split")
    days = F.regexp_extract_all(_plain(F.when(F.col("at") == 0, F.col("text")).otherwise(F.get(split, F.lit(1)))), F.lit(r"\b(\d{1,2} [A-Za-z]+ \d{4})\b"), F.lit(1))
    day = F.try_to_timestamp(F.try_element_at(days, F.lit(-1)), F.lit("d MMMM yyyy"))
    c = _once(c, {"day": day, "card": F.get(split, F.lit(0))})
    above = Window.partitionBy("path", "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    c = c.select("path", "piece", "at", "card", F.coalesce(F.last(F.when(F.year("day") >= 1900, F.col("day")), True).over(above), "start").alias("game_ts")).filter("at > 0")
    slug = F.split(F.element_at(F.split(F.rtrim(F.regexp_extract("card", r"""(?is)href\s*=\s*["']([^"'?#]*/games/[^"'?#]*)""", 1), F.lit("/")), "/"), -1), "-")
    numbers = F.regexp_extract_all(_plain(F.regexp_replace("card", r"(?is)^.*?<a\b[^>]*>", "")), F.lit(r"(?<!\d)(\d{1,3})(?!\d)"), F.lit(1))
    c, slug, numbers = _once(c, {"slug": slug, "numbers": numbers}), F.col("slug"), F.col("numbers")
    score = lambda n: F.try_element_at(numbers, F.lit(n)).try_cast("int")
    return c.select("path", "piece", "at", F.get(slug, F.lit(0)).alias("source_game_id"), "game_ts", F.upper(F.get(slug, F.lit(1))).alias("home_code"), F.upper(F.get(slug, F.lit(2))).alias("away_code"),
                    score(-2).alias("home_score"), score(-1).alias("away_score"))


def official_games(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Games of editions' pages(path, body), and cards that give none (path, at, reason). Pages may come in pieces, see _in_pieces(), each with the days of its cards.

    A page has game cards, data written into it, or both; of one game the data counts, as it has ids, names and rounds. Two zeros are no score. Cards whose link names no game or no teams, or
    teams to be decided, give none. Cards without a day above them take the event's first day.
    """
    pages = _in_pieces(pages)
    data, cards = _payload(pages), _cards(pages)
    undecided = F.col("home_code").isin("TBD", "TBC") | F.col("away_code").isin("TBD", "TBC")
    cards = cards.withColumn("reason", F.when(~F.regexp_like("source_game_id", F.lit(r"^\d+$")), "no game in the link").when(F.col("home_code").isNull() | F.col("away_code").isNull(), "a team is missing").when(undecided, "a team is undecided"))
    open_ = F.col("home_score").isNull() | F.col("away_score").isNull() | ((F.col("home_score") == 0) & (F.col("away_score") == 0))
    shown = cards.filter("reason is null").withColumns({
        "status": F.when(open_, "scheduled").otherwise("final"), "home_score": F.when(~open_, F.col("home_score")), "away_score": F.when(~open_, F.col("away_score")),
        "home_team": F.col("home_code"), "away_team": F.col("away_code"), "phase": F.lit(None).cast("string"), "round_name": F.lit(None).cast("string"), "origin": F.lit("card")}).drop("reason")
    both = data.withColumn("origin", F.lit("data")).unionByName(shown)
    last = Window.partitionBy("path", "source_game_id").orderBy(F.desc("origin"), F.desc("piece"), F.desc("at"))
    games = both.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn", "piece", "at")
    return games, cards.filter("reason is not null").select("path", "at", "reason")
