"""Games in wikitext: two- and three-leg templates, tie-break notes, tables, score matrices and brackets, nested as they come."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_hash

ROWS = "page string, seq int, kind string, phase string, round_name string, leg int, home string, away string, home_score int, away_score int"
#: What a note of a deciding game begins with.
NOTES = ("un partido de desempate", "partido de desempate", "tercer partido", "tie-break", "play-off game")
TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|^\{\||^\|\}|^(={2,6})\s*(.*?)\s*\1\s*$", re.M)
LINK = re.compile(r"\[\[([^|\]]+)(?:\|([^\]]*))?\]\]")
SCORE = re.compile(r"^(\d{1,3})\s*[^\d\s]+\s*(\d{1,3})$")
NOTE = re.compile(rf"(?is)(?:{'|'.join(map(re.escape, NOTES))})[^\[\]]*?(\[\[[^\]]+\]\])\s*[-–]\s*(\[\[[^\]]+\]\])\s+(\d{{1,3}}\s*[^\d\s]+\s*\d{{1,3}})")
SEED = re.compile(r"^\s*RD(\d+)-(team|score)(\d+)(?:-(\d+))?\s*=(.*)$", re.S)


def parts(text: str) -> list[tuple[str, int, str]]:
    """(kind, where it begins, body) of all templates, tables and headings; an opening without an end is passed over, what stands in it isn't."""
    out, stack, held = [], [], {"{{": 0, "[[": 0, "{|": 0}
    closing = {"}}": "{{", "]]": "[[", "|}": "{|"}
    for m in TOKEN.finditer(text):
        t = m.group()
        if m.group(1):
            out.append(("=" * min(3, len(m.group(1))), m.start(), m.group(2)))
        elif t in closing:
            if held[closing[t]]:
                while (top := stack.pop())[0] != closing[t]:
                    held[top[0]] -= 1
                held[top[0]] -= 1
                if t != "]]":
                    out.append((top[0], top[1], text[top[1] + 2 : m.start()]))
        else:
            stack.append((t, m.start()))
            held[t] += 1
    return sorted(out, key=lambda x: x[1])


def fields(body: str, mark: str = "|") -> list[str]:
    """The body cut at marks that stand in no template or link."""
    out, depth, begin, i = [], 0, 0, 0
    while i < len(body):
        two = body[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = max(0, depth - 1), i + 2
        elif not depth and body.startswith(mark, i):
            out.append(body[begin:i])
            begin = i = i + len(mark)
        else:
            i += 1
    return [*out, body[begin:]]


def plain(value: str) -> str:
    """A value as it is read: no notes, templates, or marks of links and type."""
    value = re.sub(r"(?is)<ref[^>/]*>.*?</ref>|<[^>]+>", "", value)
    while (less := re.sub(r"\{\{[^{}]*\}\}", "", value)) != value:
        value = less
    return LINK.sub(lambda m: m.group(2) or m.group(1), value).replace("'''", "").replace("''", "").strip(" *.\n\t")


def team(value: str) -> str | None:
    name = plain(value)
    return None if not name or name.lower() in ("-", "bye") or SCORE.match(name) or "{{" in name else name


def pair(value: str) -> tuple[int, int] | None:
    m = SCORE.match(plain(value))
    return (int(m.group(1)), int(m.group(2))) if m else None


def _legs(a: str, b: str, scores: list[tuple[int, int]]) -> list[tuple]:
    """(leg, home, away, scores) of scores written with a's first; every second leg was at b's."""
    return [(i + 1, a, b, x, y) if i % 2 == 0 else (i + 1, b, a, y, x) for i, (x, y) in enumerate(scores)]


def _result(body: str, most: int) -> list[tuple]:
    values = fields(body)[1:]
    named = [i for i, v in enumerate(values) if "[[" in v and not re.match(r"\s*\w+\s*=", v)][:2]
    if len(named) < 2:
        return []
    a, b = (team(values[i]) for i in named)
    scores = [s for v in values[named[1] + 1 :] if (s := pair(v))][:most]
    return _legs(a, b, scores) if a and b else []


def _bracket(body: str) -> list[tuple]:
    held: dict[tuple[int, int], dict] = {}
    for v in fields(body)[1:]:
        if m := SEED.match(v):
            side = held.setdefault((int(m.group(1)), int(m.group(3))), {"scores": {}})
            if m.group(2) == "team":
                side["team"] = team(m.group(5))
            elif plain(m.group(5)).isdigit():
                side["scores"][int(m.group(4) or 1)] = int(plain(m.group(5)))
    out = []
    for (rd, seed), one in sorted(held.items()):
        other = held.get((rd, seed + 1))
        if seed % 2 and other and one.get("team") and other.get("team"):
            legs = sorted(set(one["scores"]) & set(other["scores"]))
            out += _legs(one["team"], other["team"], [(one["scores"][k], other["scores"][k]) for k in legs])
    return out


def _rows(body: str) -> list[list[str]]:
    """Cells of a table's rows; attributes before a cell's bar are left out."""
    out = []
    for row in re.split(r"(?m)^\|-.*$", body):
        cells = []
        for line in re.findall(r"(?m)^[|!](?![-}+])(.*(?:\n(?![|!]).*)*)", row):
            for cell in [x for y in fields(line, "||") for x in fields(y, "!!")]:
                cells.append(fields(cell)[-1].strip())
        if cells:
            out.append(cells)
    return out


def _table(body: str) -> list[tuple[str, tuple]]:
    rows = _rows(body)
    out: list[tuple[str, tuple]] = []
    for c in rows:
        scores = [pair(x) for x in c[3:5]]
        if len(c) >= 5 and team(c[0]) and team(c[2]) and all(scores):
            out += [("table", g) for g in _legs(team(c[0]), team(c[2]), scores)]
    heads = [team(x) for x in rows[0][1:]] if rows else []
    grid = [c for c in rows[1:] if len(c) == len(heads) + 1 and team(c[0])]
    cells = [(team(c[0]), heads[k], s) for c in grid for k, x in enumerate(c[1:]) if heads[k] and (s := pair(x))]
    if len(heads) > 2 and len(cells) == len(heads) * (len(heads) - 1):
        out += [("matrix", (1, a, b, *s)) for a, b, s in cells]
    return out


def games_of(text: str) -> list[tuple]:
    """(kind, phase, round, leg, home, away, home score, away score) of a page, in the order in which they stand."""
    out, phase, name = [], None, None
    found: list[tuple[int, str, object]] = [(at, kind, body) for kind, at, body in parts(text)] + [(m.start(), "note", m) for m in NOTE.finditer(text)]
    for _, kind, body in sorted(found, key=lambda x: (x[0], x[1])):
        games: list[tuple[str, tuple]] = []
        if kind == "==":
            phase, name = plain(body), None
        elif kind == "===":
            name = plain(body)
        elif kind == "note":
            a, b, s = team(body.group(1)), team(body.group(2)), pair(body.group(3))
            games = [("tie-break", g) for g in _legs(a, b, [s])] if a and b and s else []
        elif kind == "{|":
            games = _table(body)
        else:
            title = fields(body)[0].strip().lower()
            if title in ("twolegresult", "threelegresult"):
                games = [(title[:-6], g) for g in _result(body, 2 if title[0:2] == "tw" else 3)]
            elif "bracket" in title:
                games = [("bracket", g) for g in _bracket(body)]
        out += [(k, phase, name, *g) for k, g in games]
    return out


def wiki_games(pages: DataFrame, key: str, column: str = "wikitext") -> DataFrame:
    """The games of each page of wikitext with the headings they stand under and a hash of page and place as id. Null pages hold none."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches):
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1)):  # a page at a time, as pages are long
                out = [(k.as_py(), i, *g) for i, g in enumerate(games_of(text.as_py() or ""))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(kinds), kinds)], names)

    rows = pages.select(F.col(key).cast("string").alias("page"), F.col(column).cast("string").alias("wikitext")).mapInArrow(run, ROWS)
    return rows.withColumn("source_game_id", short_hash(F.col("page"), F.col("seq").cast("string"), F.col("kind"), F.col("leg").cast("string")))
