"""Scalar functions of the domain as column expressions: season labels, names, countries, statuses, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters with marks and the plain letters they stand for, the letters of Serbian and Greek in Latin.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĢģĪīĮįİĶķĻļŃńŅņŇňŌōŐőŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŲųŹźŻżŽžȘșȚț"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgGgIiIiIKkLlNnNnNnOoOoRrRrSsSsSsTtTtUuUuUuUuZzZzZzSsTt"
SERBIAN = {"љ": "lj", "њ": "nj", "џ": "dž", "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "ђ": "đ", "е": "e", "ж": "ž", "з": "z", "и": "i", "ј": "j", "к": "k", "л": "l", "м": "m",
           "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "ћ": "ć", "у": "u", "ф": "f", "х": "h", "ц": "c", "ч": "č", "ш": "š"}
GREEK = {"θ": "th", "χ": "ch", "ψ": "ps", "ξ": "x", "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ο": "o",
         "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "ω": "o"}
# Codes that mean another, and names of countries in result feeds.
COUNTRY_ALIASES = {"UK": "GB", "EL": "GR", "GBR": "GB", "GRE": "GR", "GER": "DE", "ESP": "ES", "FRA": "FR", "LTU": "LT", "ITA": "IT", "TUR": "TR", "USA": "US"}
COUNTRY_NAMES = {"spain": "ES", "france": "FR", "lithuania": "LT", "greece": "GR", "italy": "IT", "turkey": "TR", "belgium": "BE", "germany": "DE", "israel": "IL", "poland": "PL",
                 "czech republic": "CZ", "czechia": "CZ", "russia": "RU", "serbia": "RS", "croatia": "HR", "slovenia": "SI", "latvia": "LV", "estonia": "EE", "usa": "US", "united states": "US"}
# Tournament families by region, with the competitions that share a cycle; FIBA may stand before those of the first two.
CYCLES = {
    "eurobasket": ("europe", ["eurobasket", "fiba eurobasket", "eurobasket qualifiers", "fiba eurobasket qualifiers", "eurobasket pre-qualifiers", "fiba eurobasket pre-qualifiers"]),
    "afrobasket": ("africa", ["afrobasket", "fiba afrobasket", "afrobasket qualifiers", "fiba afrobasket qualifiers", "afrobasket pre-qualifiers", "fiba afrobasket pre-qualifiers"]),
    "asiacup": ("asia", ["fiba asia cup", "fiba asia cup qualifiers", "fiba asia cup pre-qualifiers"]),
    "americup": ("americas", ["fiba americup", "fiba americas championship", "fiba americup qualification", "fiba americup qualifiers", "fiba americup pre-qualifiers"]),
    "centrobasket": ("americas", ["centrobasket championship"]),
    "cocaba": ("americas", ["cocaba championship"]),
    "south-american": ("americas", ["south american championship"]),
    "caribbean": ("americas", ["caribbean basketball championship"]),
    "oceania": ("oceania", ["fiba oceania championship", "oceania championship"]),
    "worldcup": ("world", ["fiba basketball world cup", "fiba basketball world cup qualifiers", "fiba basketball world cup pre-qualifiers", "fiba wc qualification"]),
    "olympics": ("world", ["summer olympics", "fiba men's olympic basketball tournament", "olympics qualification", "fiba olympic qualifying tournament", "olympics pre-qualification",
                           "fiba olympic pre-qualifying tournament"]),
}
# Competitions by what their feed names contain or equal, the first that fits.
COMPETITIONS = [
    ("equals", "nba", "NBA"), ("contains", "euroleague", "Euroleague"), ("equals", "euro league", "Euroleague"), ("contains", "eurocup", "Eurocup"), ("contains", "euro cup", "Eurocup"), ("contains", "adriatic", "ABA League"), ("contains", "aba league", "ABA League"),
    ("contains", "champions league", "Champions League"), ("contains", "fiba europe cup", "FIBA Europe Cup"), ("contains", "bnxt", "BNXT League"), ("contains", "enbl", "ENBL"), ("contains", "acb", "ACB"), ("contains", "liga endesa", "ACB"),
    ("contains", "copa del rey", "Spanish Cup"), ("equals", "spanish cup", "Spanish Cup"), ("contains", "elite 1", "LNB"), ("contains", "lnb pro a", "LNB"), ("contains", "betclic elite", "LNB"), ("contains", "coupe de france", "French Cup"),
    ("contains", "french cup", "French Cup"), ("equals", "lkl", "LKL"), ("contains", "greek basket", "A1"), ("equals", "a1", "A1"), ("contains", "greek cup", "Greek Cup"), ("contains", "lega basket", "Lega A"), ("contains", "serie a", "Lega A"),
    ("contains", "italian cup", "Italian Cup"), ("equals", "bsl", "Super Ligi"), ("contains", "super ligi", "Super Ligi"), ("contains", "turkish cup", "Turkish Cup"),
]
SIMILAR = 0.86


def mapped(x: Column, values: dict[str, str]) -> Column:
    """values[x], null for others: a literal map, so no join."""
    return F.element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), x)


def full_season(label: Column) -> Column:
    """'2023' and '2023-24' as '2023-2024'; a short end year is of the start's century or the next; other labels stay, trimmed."""
    x = F.trim(label)
    start = F.regexp_extract(x, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 1).try_cast("int")
    text = F.regexp_extract(x, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", 2)
    end = text.try_cast("int")
    near = F.when(F.length(text) <= 2, F.floor(start / 100) * 100 + end).otherwise(end)
    near = F.when(near < start, near + 100).otherwise(near)
    return F.when(start.isNull(), x).when(text == "", F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string"))).otherwise(
        F.concat(start.cast("string"), F.lit("-"), near.cast("int").cast("string"))
    )


def start_year(label: Column) -> Column:
    """First year of a season label, 2000 if there is none."""
    return F.coalesce(F.split_part(full_season(label), F.lit("-"), F.lit(1)).try_cast("int"), F.lit(2000))


def is_season(label: Column) -> Column:
    """Whether a label is a season from 1900 on that ends in the next year."""
    full = full_season(label)
    a, b = (F.split_part(full, F.lit("-"), F.lit(i)).try_cast("int") for i in (1, 2))
    return F.coalesce((a >= 1900) & (b == a + 1), F.lit(False))


def season_of(day: Column, first_month: int) -> Column:
    """Season label of a date when seasons begin in a month (7 for results, 8 for ratings)."""
    start = F.year(day) - F.when(F.month(day) < first_month, 1).otherwise(0)
    return F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string"))


def country_code(x: Column) -> Column:
    """Two-letter code in upper case; UK, EL and three-letter codes by their meaning, others as they are; blank is null."""
    code = F.upper(F.trim(x))
    return F.when(F.length(code) > 0, F.coalesce(mapped(code, COUNTRY_ALIASES), code))


def country_of_name(x: Column) -> Column:
    return mapped(plain_name(x), COUNTRY_NAMES)


def same_country(a: Column, b: Column) -> Column:
    return country_code(a).eqNullSafe(country_code(b))


def compact_name(x: Column) -> Column:
    """Letters and digits in upper case."""
    return F.upper(F.regexp_replace(x, r"[^\p{L}\p{Nd}]", ""))


def plain_name(x: Column) -> Column:
    """Lower case with runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", " "))


def without_marks(x: Column) -> Column:
    return F.translate(x, MARKED, PLAIN)


def similar(a: Column, b: Column) -> Column:
    """Names under four characters must be equal; others may hold one another or differ by at most 14 % of the longer."""
    a, b = compact_name(a), compact_name(b)
    longest = F.greatest(F.length(a), F.length(b))
    close = 1 - F.levenshtein(a, b) / longest >= SIMILAR
    return F.when(F.least(F.length(a), F.length(b)) < 4, a == b).otherwise(F.contains(a, b) | F.contains(b, a) | close)


def transliterated(x: Column, letters: dict[str, str]) -> Column:
    """Lower case in Latin letters."""
    x = F.lower(x)
    for k, v in letters.items():
        if len(v) > 1:
            x = F.replace(x, F.lit(k), F.lit(v))
    single = {k: v for k, v in letters.items() if len(v) == 1}
    return F.translate(x, "".join(single), "".join(single.values()))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(without_marks(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_hash(*parts: Column) -> Column:
    """24 hex digits of SHA-256 over the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def uuid_of(x: Column) -> Column:
    """MD5 written as a UUID."""
    return F.regexp_replace(F.md5(x), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def pair_key(a: Column, b: Column) -> Column:
    """The same for either order."""
    return F.concat_ws(":", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def cycle_key(region: Column, name: Column, season: Column) -> Column:
    """Key of the tournament cycle a competition's season belongs to; null for others and for blanks."""
    n, r = F.lower(F.trim(name)), F.lower(region)
    family = F.lit(None).cast("string")
    for key, (where, names) in CYCLES.items():
        family = F.when((r == where) & n.isin(names), key).otherwise(family)
    return F.when(F.length(F.trim(season)) > 0, F.concat(family, F.lit("-"), F.trim(season)))


def competition_of(name: Column) -> Column:
    """The supported competition a feed name stands for, without its phase words; null if none."""
    # fixed value: the words of phases
    n = plain_name(F.regexp_replace(plain_name(name), r"\b(play off|playoffs?|regular season|group stage|qualification)\b", " "))
    out = F.lit(None).cast("string")
    for kind, text, value in reversed(COMPETITIONS):
        out = F.when(n == text if kind == "equals" else F.contains(n, F.lit(text)), value).otherwise(out)
    return out


def feed_status(raw: Column, has_score: Column) -> Column:
    """Status of a result feed's word."""
    s = F.lower(raw)
    return (
        F.when(F.contains(s, F.lit("postponed")) | s.isin("ppd", "postp."), "postponed").when(F.contains(s, F.lit("cancelled")) | F.contains(s, F.lit("canceled")), "cancelled")
        .when(s.isin("ft", "ot", "aot") | F.contains(s, F.lit("final")), "finished").when(F.regexp_like(raw, F.lit(r"^\d{1,2}:\d{2}$")), "scheduled")
        .when(has_score, "live").otherwise("scheduled")
    )


def _squeezed(status: Column) -> Column:
    return F.lower(F.replace(status, F.lit(" "), F.lit("")))


def is_finished(status: Column) -> Column:
    s = _squeezed(status)
    return F.contains(s, F.lit("finished")) | F.contains(s, F.lit("afterovertime")) | s.isin("final", "completed")


def is_called_off(status: Column) -> Column:
    return F.regexp_like(_squeezed(status), F.lit("cancelled|canceled|postponed|abandoned"))


def exclusion_reason(is_franchise: Column, reviewed: Column, day: Column, opener: Column) -> Column:
    """Why a game doesn't count, the first that holds; null if none does."""
    return F.when(~is_franchise, "non_franchise").when(~reviewed, "season_not_reviewed").when(day < opener, "before_opener")


def to_utc(local: Column, zone: str) -> Column:
    return F.to_utc_timestamp(local, zone)


def midpoint(a: Column, b: Column) -> Column:
    """The date halfway between two."""
    return F.date_add(a, F.floor(F.datediff(b, a) / 2).cast("int"))


def id_list(text: str | None) -> list[int]:
    """Whole numbers of a comma list: what isn't one is dropped, each comes once, in order."""
    return list(dict.fromkeys(int(p) for p in (x.strip() for x in (text or "").split(",")) if p.isdecimal()))


def json_set(document: Column, key: str, value: Column) -> Column:
    """A flat JSON document as text with one key set; a broken one becomes that key alone. Keys are written in order."""
    fields = F.coalesce(F.from_json(document, "map<string,string>"), F.create_map().cast("map<string,string>"))
    others = F.map_filter(fields, lambda k, _: k != key)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(others, F.create_map(F.lit(key), value.cast("string")))))))


def json_has(document: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(document), key), F.lit(False))


def decision_key(kind: Column, left: Column, right: Column, scope: Column) -> Column:
    """Key of a decision: its kind, the pair in either order, and its scope or "all"."""
    return F.concat_ws("|", F.lower(kind), pair_key(left, right), F.coalesce(F.lower(F.trim(scope)), F.lit("all")))


def display_name(code: Column, overrides: dict[str, str], catalog: dict[str, str]) -> Column:
    """A place's name by its code: an override, else the catalog's, else the code itself."""
    c = country_code(code)
    return F.coalesce(mapped(c, overrides), mapped(c, catalog), c)


def resolve_place(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows(row_id, id, code, name) with the place of catalog(place_id, code, name) they mean: by id, else by code, else by the name without marks and case."""
    by_id = catalog.select(F.col("place_id").alias("p1"), F.col("place_id").alias("k1"))
    by_code = catalog.groupBy(F.upper("code").alias("k2")).agg(F.min("place_id").alias("p2"))
    by_name = catalog.groupBy(F.lower(without_marks(F.col("name"))).alias("k3")).agg(F.min("place_id").alias("p3"))
    out = rows.join(by_id, F.col("id") == F.col("k1"), "left").join(by_code, country_code(F.col("code")) == F.col("k2"), "left")
    out = out.join(by_name, F.lower(without_marks(F.trim("name"))) == F.col("k3"), "left")
    return out.select("row_id", F.coalesce("p1", "p2", "p3").alias("place_id"))
