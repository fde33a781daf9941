"""A SQL front for constructs that Spark does not parse: the text is rewritten and handed to spark.sql().

Rewritten: functions of functions/dialects.py, ~ ~* !~ !~*, SIMILAR TO and ^@ with literals, TABLE t,
FETCH FIRST n ROWS ONLY or WITH TIES, DISTINCT ON, QUALIFY, generate_series and UNNEST in FROM.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sparkloom.functions import dialects
from sparkloom.functions.scalar import similar_to_pattern

_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|[A-Za-z_]\w*|\d+(?:\.\d+)?|!~\*|~\*|!~|\^@|::|<=>|<=|>=|<>|!=|\|\||->>|->|.", re.S)


def _tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def _close(tokens: list[str], at: int) -> int:
    """Place of the parenthesis that closes the one at `at`."""
    depth = 0
    for k in range(at, len(tokens)):
        depth += (tokens[k] == "(") - (tokens[k] == ")")
        if depth == 0:
            return k
    raise ValueError("a parenthesis is not closed")


def _arguments(tokens: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t in "([") - (t in ")]")
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [] if out == [[]] or not "".join(map("".join, out)).strip() else out


def _literal(token: str) -> str:
    return "'" + token.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _skip(tokens: list[str], at: int) -> int:
    while at < len(tokens) and tokens[at].isspace():
        at += 1
    return at


def _functions(tokens: list[str]) -> list[str]:
    """Calls of other dialects' functions by their templates, inside out."""
    out, k = [], 0
    while k < len(tokens):
        t = tokens[k]
        following = _skip(tokens, k + 1)
        if re.match(r"[A-Za-z_]", t) and following < len(tokens) and tokens[following] == "(":
            end = _close(tokens, following)
            inner = _functions(tokens[following + 1 : end])
            found = dialects.call(t, ["".join(a).strip() for a in _arguments(inner)]) if not _is_source(out, t) else None
            out += [found] if found else [t, "(", *inner, ")"]
            k = end + 1
        else:
            out.append(t)
            k += 1
    return out


def _is_source(before: list[str], name: str) -> bool:
    words = [t.upper() for t in before if not t.isspace()]
    return name.lower() in ("generate_series", "unnest") and bool(words) and words[-1] in ("FROM", ",", "JOIN", "LATERAL")


def _operators(tokens: list[str]) -> list[str]:
    out, k = [], 0
    while k < len(tokens):
        t, following = tokens[k], _skip(tokens, k + 1)
        word = t.upper()
        if t in ("~", "~*", "!~", "!~*") and following < len(tokens) and tokens[following].startswith("'") and [x for x in out if not x.isspace()][-1:] not in (["("], [","], ["SELECT"]):
            pattern = ("(?i)" if t.endswith("*") else "") + tokens[following][1:-1].replace("''", "'")
            out += [" NOT" if t[0] == "!" else "", " RLIKE ", _literal(pattern)]
            k = following + 1
        elif word == "SIMILAR" and tokens[following].upper() == "TO":
            at = _skip(tokens, following + 1)
            out += ["RLIKE ", _literal(similar_to_pattern(tokens[at][1:-1].replace("''", "'")))]
            k = at + 1
        elif t == "^@":
            out.append("LIKE ")
            out.append(_literal(re.sub(r"([%_\\])", r"\\\1", tokens[following][1:-1].replace("''", "'")) + "%"))
            k = following + 1
        else:
            out.append(t)
            k += 1
    return out


def _clauses(tokens: list[str]) -> dict[str, tuple[int, int]]:
    """(start, end) of each top-level clause of one SELECT, by its first word."""
    starts, depth = [], 0
    for k, t in enumerate(tokens):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.upper() in ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "FETCH"):
            starts.append((t.upper(), k))
    ends = [s for _, s in starts[1:]] + [len(tokens)]
    return {name: (s, e) for (name, s), e in zip(starts, ends, strict=True)}


def _select(sql: str) -> str:
    """QUALIFY, DISTINCT ON, FETCH FIRST of one outermost SELECT as nested selects over ranking columns."""
    tokens = _tokens(sql)
    head = [t.upper() for t in tokens if not t.isspace()]
    if head[:1] == ["TABLE"]:
        return "SELECT * FROM " + "".join(tokens[_skip(tokens, _skip(tokens, 0) + 1) :])
    if head[:1] != ["SELECT"]:
        return sql
    parts = _clauses(tokens)
    text = lambda name: "".join(tokens[slice(*parts[name])]).strip() if name in parts else ""
    select, order = text("SELECT"), text("ORDER")
    tail = " ".join(text(n) for n in ("LIMIT", "OFFSET") if n in parts)
    body = " ".join(text(n) for n in ("FROM", "WHERE", "GROUP", "HAVING", "WINDOW") if n in parts)
    fetch = re.fullmatch(r"FETCH\s+(?:FIRST|NEXT)\s+(\d+)?\s*ROWS?\s+(ONLY|WITH\s+TIES)", text("FETCH"), re.I | re.S) if "FETCH" in parts else None
    on = re.match(r"SELECT\s+DISTINCT\s+ON\s*\(", select, re.I)
    hidden, where = [], []
    if on:
        inner = _tokens(select[on.end() - 1 :])
        end = _close(inner, 0)
        keys = "".join(inner[1:end])
        select = "SELECT " + "".join(inner[end + 1 :]).strip()
        hidden.append(f"row_number() OVER (PARTITION BY {keys} {order or 'ORDER BY ' + keys}) AS __first")
        where.append("__first = 1")
    if "QUALIFY" in parts:
        hidden.append(f"({text('QUALIFY')[7:].strip()}) AS __qualify")
        where.append("__qualify")
    if fetch and fetch[2].upper() == "ONLY":
        tail = f"LIMIT {fetch[1] or 1} {tail}"
    elif fetch:
        hidden.append(f"rank() OVER ({order}) AS __rank")
        where.append(f"__rank <= {fetch[1] or 1}")
        order = ""
    if not hidden:
        return " ".join(x for x in (select, body, order, tail) if x)
    drop = ", ".join(re.search(r"AS (\w+)$", h)[1] for h in hidden)
    again = "" if on or not order else order
    inside = f"{select}, {', '.join(hidden)} {body}"
    if again:
        keys = again[again.upper().index("BY") + 2 :]
        return f"SELECT * EXCEPT ({drop}) FROM ({inside} ) WHERE {' AND '.join(where)} ORDER BY {keys} {tail}".strip()
    return f"SELECT * EXCEPT ({drop}) FROM ({inside}) WHERE {' AND '.join(where)} {tail}".strip()


def _sources(sql: str) -> str:
    """FROM generate_series(a, b[, s]) AS t(c) and FROM UNNEST(array) [WITH ORDINALITY] AS t(c[, o])."""
    sql = re.sub(r"(?i)\bgenerate_series\s*\(\s*([^(),]+),\s*([^(),]+?)(?:,\s*([^(),]+?))?\s*\)\s+AS\s+(\w+)\s*\(\s*(\w+)\s*\)", lambda m: f"(SELECT explode(sequence({m[1]}, {m[2]}, {m[3] or 1})) AS {m[5]}) AS {m[4]}", sql)
    sql = re.sub(r"(?i)\bUNNEST\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s+WITH\s+ORDINALITY\s+AS\s+(\w+)\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)", r"LATERAL (SELECT e AS \3, p + 1 AS \4 FROM (SELECT posexplode(\1) AS (p, e))) AS \2", sql)
    sql = re.sub(r"(?i)\bUNNEST\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s+AS\s+(\w+)\s*\(\s*(\w+)\s*\)", r"LATERAL (SELECT explode(\1) AS \3) AS \2", sql)
    return re.sub(r"(?i)\bFROM\s+LATERAL\s+(?=\(SELECT)", "FROM ", sql)


def translate(text: str) -> str:
    """Spark SQL of a query in the wider dialect; text that Spark parses comes back in effect unchanged."""
    tokens = _operators(_functions(_tokens(text.strip().rstrip(";"))))
    return _select(_sources("".join(tokens)))


def sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(translate(text))
