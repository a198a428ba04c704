"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import drop, save

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def _same(a: DataFrame, b: DataFrame, names) -> DataFrame:
    """Left join on names, null equal to null; columns of b but its names are added."""
    right = b.select(*[F.col(n).alias(f"_{n}") for n in names], *[c for c in b.columns if c not in names])
    on = [a[n].eqNullSafe(right[f"_{n}"]) for n in names]
    return a.join(right, on, "left").drop(*[f"_{n}" for n in names])


def _fill(nodes: DataFrame, parents: tuple[str, ...], name: str) -> DataFrame:
    """Share each parent's `budget` among its children by weight, none above its capacity.

    What a full child can't take goes to its siblings by their weights, until all are full. With children
    in order of capacity over weight, the level at which the rest are cut off has a closed form, so prefix sums do it.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit("root"))
    order = group.orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (
        nodes.filter("weight > 0").withColumn("lam", (F.col("budget") - before) / after)
        .withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("lam"), F.col("lam"))).over(group))
    )
    return level.select(
        *parents, name, F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("budget")
    )


def _weights(nodes: DataFrame, weights: dict[tuple, float], names: tuple[str, ...]) -> DataFrame:
    """Adds the weight of each path at one level: that of the last rule that fits, else 1."""
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == len(names):
            hit = F.lit(True)
            for n, part in zip(names, path):
                hit = hit & (F.lit(True) if part == "*" else F.col(n).eqNullSafe(F.lit(part)))
            out = F.when(hit, F.lit(float(w))).otherwise(out)
    return nodes.withColumn("weight", out)


def leaf_budgets(leaves: DataFrame, weights: dict[tuple, float], budget: float | None, budget_share: float, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens) with `budget` whole tokens for each, tokens * max_epochs at most.

    A branch's capacity is that of its leaves with a weight above 0 on their whole path, so what nobody there may take goes to others.
    """
    usable, caps = F.lit(True), leaves
    for depth in range(len(LEVELS)):
        caps = _weights(caps, weights, LEVELS[: depth + 1]).withColumn(f"weight{depth}", F.col("weight")).drop("weight")
        usable = usable & (F.col(f"weight{depth}") > 0)
    caps = caps.select(*LEVELS, F.when(usable, F.col("tokens") * max_epochs).otherwise(0).cast("double").alias("cap"))
    total = F.lit(float(budget)) if budget is not None else F.col("all_tokens") * F.lit(float(budget_share))
    root = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("all_tokens")).select(total.alias("budget"))
    above = None
    for depth, name in enumerate(LEVELS):
        names = LEVELS[: depth + 1]
        nodes = caps.groupBy(*names).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(F.broadcast(root)) if above is None else _same(nodes, above, LEVELS[:depth])
        above = save(_fill(_weights(nodes.withColumn("budget", F.coalesce("budget", F.lit(0.0))), weights, names), LEVELS[:depth], name), f"level{depth}")
    return _same(leaves, above, LEVELS).withColumn("budget", F.floor(F.coalesce("budget", F.lit(0.0)) + 1e-6))


def _turn(seed: int, text_hash: str = "text_hash"):
    """Place of a row in the seeded order of its leaf's epoch: an md5 of the id (of the text where the id is null), then the id, then the text."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col(text_hash)))
    return F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), own)).alias("turn"), F.col("doc_id").alias("id"), F.col(text_hash).alias("text"))


def _leaf_plan(own: DataFrame, weights, budget, budget_share, max_epochs, seed) -> DataFrame:
    """A row for each leaf: whole epochs, and the last place of the next epoch that is still used (null: none)."""
    leaves = save(own.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = leaf_budgets(leaves, weights, budget, budget_share, max_epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)
    plan = save(plan.withColumn("whole", full).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).select(*LEVELS, "whole", "rest"), "plan")
    placed = _same(own, plan, LEVELS).withColumn("place", _turn(seed))
    # The order is uniform, so buckets of its first digits hold about 1/4096 of a leaf each: only the one at the cut is sorted.
    bucket = F.substring("place.turn", 1, 3)
    sums = placed.groupBy(*LEVELS, bucket.alias("bucket"), "rest").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket")
    cuts = save(
        sums.withColumn("before", F.coalesce(F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .filter("before < rest and before + n >= rest").select(*LEVELS, F.col("bucket").alias("cut"), "before"), "cuts",
    )
    running = Window.partitionBy(*LEVELS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        _same(placed, cuts, LEVELS).filter(bucket == F.col("cut"))
        .withColumn("used", F.col("before") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0)) < F.col("rest"))
        .filter("used").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    )
    return save(_same(plan.select(*LEVELS, "whole"), last, LEVELS), "ends")


def _own(docs: DataFrame, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col).cast("string")
    return [F.col(id_col).alias("doc_id"), domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.xxhash64(text).alias("text_hash")]


def _epochs(seed: int) -> Column:
    return (F.coalesce("whole", F.lit(0)) + F.coalesce(_turn(seed) <= F.col("last"), F.lit(False)).cast("int")).cast("long")


def _tokens(docs: DataFrame, own: list[Column], text_col: str) -> DataFrame:
    return save(docs.select(*own, F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")), "tokens")


def mix_sources(
    docs: DataFrame, domain: Column, weights: dict[tuple, float], budget: float | None = None, budget_share: float = 1.0,
    max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epochs): how often each document is used.

    Weights are given by path: ("web",), ("web", "en"), ("*", "en", "src1"); "*" is any part, the last rule that fits counts, and
    without one siblings weigh 1; a weight of 0 leaves a branch out. The budget (tokens, or budget_share of all tokens) goes down the tree domain,
    language, source; a leaf takes max_epochs times its tokens at most, and what it can't take goes to its siblings before other branches.
    A leaf uses its documents in whole epochs, then the first documents of the next epoch's seeded order, up to the one
    that reaches its budget. Tokens are words. Null keys are leaves of their own; null and wordless texts have no tokens and
    are used only with whole epochs or before the cut. The order is by id, or by text where ids are null, so it is the same for any partitioning; rows
    that are equal in both are used alike. Rules are literals, so their number is that of the caller's list; leaves are as many as different
    paths. Other columns are ignored. An empty table gives an empty result.
    """
    own = _tokens(docs, _own(docs, domain, id_col, text_col, lang_col, source_col), text_col)
    plan = _leaf_plan(own, weights, budget, budget_share, max_epochs, seed)
    return _same(own, plan, LEVELS).select("doc_id", *LEVELS, "n_tokens", _epochs(seed).alias("epochs"))


def mixed_documents(
    docs: DataFrame, domain: Column, weights: dict[tuple, float], budget: float | None = None, budget_share: float = 1.0,
    max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The rows of docs as often as mix_sources() uses them. Each row is decided where it is, from its leaf's last place; columns keep their names, whatever they are."""
    own = _own(docs, domain, id_col, text_col, lang_col, source_col)
    tokens = _tokens(docs, own, text_col)
    plan = _leaf_plan(tokens, weights, budget, budget_share, max_epochs, seed)
    drop(tokens)
    used = _same(docs.select(*own, F.struct(*[F.col(c) for c in docs.columns]).alias("row")), plan, LEVELS).select("row", _epochs(seed).alias("epochs")).filter("epochs > 0")
    return used.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "epochs"))).select("row.*")


#: The mixture of the registered query: sources dealt to three domains by number.
DOMAINS = ("web", "books", "reference")
WEIGHTS = {
    ("web",): 0.5, ("books",): 0.3, ("reference",): 0.2,
    ("*", "en"): 0.4, ("*", "de"): 0.2, ("*", "fr"): 0.2, ("*", "es"): 0.2,
}
SHARE, EPOCHS, SEED = 0.8, 2, 17


def domain_of(source: str = "source") -> Column:
    """The domain of source "srcN" is number N modulo 3; other names are web."""
    number = F.coalesce(F.regexp_extract(F.col(source), "([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), number % 3 + 1)


def _oracle() -> str:
    def fill(name: str, parents: str, nodes: str) -> str:
        over = f"PARTITION BY {parents}" if parents else ""
        keys = f"{parents}, {name}" if parents else name
        return f"""
  SELECT {keys}, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS budget FROM (
    SELECT *, max(CASE WHEN cap / weight >= lam THEN lam END) OVER ({over}) AS level FROM (
      SELECT *, (budget - coalesce(sum(cap) OVER ({over} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER ({over} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM ({nodes})))"""

    return rf"""
WITH own AS (
  SELECT doc_id, lang, source, CASE coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'reference' END AS domain,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * {EPOCHS} AS cap FROM own GROUP BY ALL),
l0 AS ({fill("domain", "", f"SELECT domain, sum(cap) AS cap, (SELECT sum(tokens) FROM leaves) * CAST({SHARE} AS DOUBLE) AS budget, CASE domain WHEN 'web' THEN CAST(0.5 AS DOUBLE) WHEN 'books' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS weight FROM leaves GROUP BY domain")}),
l1 AS ({fill("lang", "domain", "SELECT domain, lang, sum(cap) AS cap, min(l0.budget) AS budget, CASE lang WHEN 'en' THEN CAST(0.4 AS DOUBLE) WHEN 'de' THEN CAST(0.2 AS DOUBLE) WHEN 'fr' THEN CAST(0.2 AS DOUBLE) WHEN 'es' THEN CAST(0.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight FROM leaves JOIN l0 USING (domain) GROUP BY domain, lang")}),
l2 AS ({fill("source", "domain, lang", "SELECT domain, lang, source, cap, l1.budget, CAST(1 AS DOUBLE) AS weight FROM leaves JOIN l1 USING (domain, lang)")}),
plan AS (
  SELECT domain, lang, source, tokens, floor(l2.budget + 1e-6)::BIGINT AS budget,
    CASE WHEN tokens > 0 THEN floor(floor(l2.budget + 1e-6) / tokens)::BIGINT ELSE 0 END AS whole
  FROM leaves JOIN l2 USING (domain, lang, source)
), dealt AS (
  SELECT doc_id, domain, lang, source, n_tokens, whole, budget - whole * tokens AS rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{SEED}:', whole, ':', doc_id)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM own JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS epochs FROM dealt
"""


ORACLE = _oracle()
