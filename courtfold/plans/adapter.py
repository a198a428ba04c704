"""The driver's tables seen as the rating domain, once in Spark and once in SQL for the oracle."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The domain as SQL that Spark and DuckDB both read; each name is a view of the ones before and the tables.
VIEWS: dict[str, str] = {
    "teams": """
SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_name, r_name AS country, n_nationkey % 7 <> 0 AS is_active
FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "competitions": """
SELECT CAST(r_regionkey AS BIGINT) AS competition_id, concat(r_name, CASE WHEN r_regionkey % 2 = 0 THEN ' League' ELSE ' Cup' END) AS competition_name, r_name AS country,
  CASE r_regionkey % 3 WHEN 0 THEN 'europe' WHEN 1 THEN 'nba' ELSE 'national' END AS pool, r_regionkey % 2 + 1 AS tier FROM region""",
    "first_lines": """
SELECT l_orderkey AS order_id, min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey) % 1000000000 AS supplier_id FROM lineitem GROUP BY l_orderkey""",
    "all_games": """
SELECT o_orderkey AS game_id, concat('src', o_orderkey % 3) AS source, concat('g', o_orderkey) AS source_game_id, CAST(h.n_regionkey AS BIGINT) AS competition_id,
  CASE h.n_regionkey % 3 WHEN 0 THEN 'europe' WHEN 1 THEN 'nba' ELSE 'national' END AS pool,
  CAST(o_orderdate AS DATE) AS game_date, CAST(h.n_nationkey AS BIGINT) AS home_id, CAST(a.n_nationkey AS BIGINT) AS away_id,
  year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS season_start,
  60 + (o_orderkey * 7 + o_custkey) % 60 AS hs, 60 + (o_orderkey * 11 + supplier_id * 3) % 60 AS s2,
  CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'scheduled' ELSE 'live' END AS status,
  CASE WHEN o_orderkey % 23 = 0 THEN 'Final' ELSE concat('Round ', o_orderkey % 34 + 1) END AS round_name
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation h ON h.n_nationkey = c_nationkey
JOIN first_lines ON order_id = o_orderkey JOIN supplier ON s_suppkey = supplier_id JOIN nation a ON a.n_nationkey = s_nationkey
WHERE h.n_nationkey <> a.n_nationkey""",
    "games": """
SELECT game_id, source, source_game_id, competition_id, pool, game_date, concat(season_start, '-', season_start + 1) AS season, home_id, away_id,
  CASE WHEN status = 'scheduled' AND game_id % 5 = 0 THEN NULL ELSE hs + CASE WHEN hs = s2 THEN 1 ELSE 0 END END AS home_score,
  CASE WHEN status = 'scheduled' AND game_id % 5 = 0 THEN NULL ELSE s2 END AS away_score, status, game_id % 19 <> 0 OR status = 'finished' AS eligible, round_name
FROM all_games""",
    "rated_games": """
SELECT * FROM games WHERE eligible AND home_score IS NOT NULL AND away_score IS NOT NULL AND home_score <> away_score""",
    "aliases": """
SELECT p_partkey AS alias_id, p_partkey % 25 AS team_id, concat('src', p_partkey % 3) AS source, concat('t', p_partkey % 40) AS source_team_id,
  p_name AS alias_name, CASE WHEN p_size > 10 THEN 1993 + p_size % 5 END AS valid_from, CASE WHEN p_size < 40 THEN 1997 + p_size % 4 END AS valid_to FROM part""",
    "feed": """
SELECT event_id AS feed_id, CAST(ts AS DATE) AS feed_date, user_id % 25 AS home_id, (user_id + 1 + event_id % 24) % 25 AS away_id, event_type AS raw_status,
  CAST(60 + event_id % 50 AS INT) AS home_score, CAST(60 + (event_id * 7) % 47 AS INT) AS away_score, concat('f', event_id % 5000) AS source_game_id FROM events""",
}


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")
SOURCE = re.compile(r"\b(FROM|JOIN)\s+(\w+)\b")


def view(spark: SparkSession, sf_dir: str, name: str, more: dict[str, str] | None = None) -> DataFrame:
    """One view of the domain, or of more of them, or a table, as a DataFrame."""
    sql = (VIEWS | (more or {})).get(name)
    if sql is None:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {n for _, n in SOURCE.findall(sql)}
    text = SOURCE.sub(r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{n: view(spark, sf_dir, n, more) for n in used})


#: Games of so many ids in a row are written into one piece of a page, so a page's text stays short however many games there are.
PIECE = 1 << 16


def piece_of(game_id: str) -> Column:
    return F.floor(F.col(game_id) / PIECE).alias("piece")


def dealt(rows: DataFrame, *keys) -> DataFrame:
    """Rows dealt by keys to a few tasks a core: pages are short to send and long to read, so tasks by size would be too few."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


#: Rows of a row group of pages: a reader holds as many rows at once as a row group has, up to 4096, and pages are long.
PAGES = {"parquet.block.row.count.limit": 128}

_written: dict[tuple, str] = {}


def state_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of what lies in a folder and in its tables' folders, so that a changed table is another state."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda path: [(x.getPath(), x.isDirectory(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(path)]
    out = []
    for path, folder, size, time in listed(root):
        files = [(p.getName(), n, t) for p, _, n, t in listed(path)] if folder else []
        out.append((path.getName(), size, time, len(files), sum(n for _, n, _ in files), max((t for *_, t in files), default=0)))
    return tuple(sorted(out))


def _shared(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def written(spark: SparkSession, sf_dir: str, name: str, make, **options) -> DataFrame:
    """A table that make() gives over a folder's tables, written once for each state of them in the folder of spark.checkpoint.dir and read from there; made anew where no such folder is set.

    The table of an earlier state is deleted when one of a new state is written. options are the writer's.
    """
    shared = _shared(spark)
    if not shared:
        return make()
    own = (spark.sparkContext.applicationId, sf_dir, name)
    key = (*own, state_of(spark, sf_dir))
    if key not in _written:
        made, path = make(), f"{shared.rstrip('/')}/courtfold-{uuid.uuid4().hex}"
        made.write.options(**options).parquet(path)
        for old in [k for k in _written if k[:3] == own]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(_written.pop(old))
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        _written[key] = path
    return spark.read.parquet(_written[key])


def with_views(sql: str, recursive: bool = False, **more: str) -> str:
    """DuckDB SQL with the domain views, and more of them, in front of it."""
    kept = ("seq", "fold", "history")  # asked for more than once, or at each step of a recursion
    parts = [f"{n} AS {'MATERIALIZED ' * n.startswith(kept)}({text})" for n, text in (VIEWS | more).items()]
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n" + sql
