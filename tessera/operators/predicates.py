"""Cell predicates ('column op value') and the JSON filter language, compiled to Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_OPS = ("~=", ">=", "<=", "!=", "=", ">", "<")
_RISKY = re.compile(r"\([^()]*[+*][^()]*\)[+*{]")


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def number(c: Column) -> Column:
    """The cell as a double, null where it isn't a plain number."""
    return F.when(is_number(c), F.trim(c).try_cast("double"))


def safe_pattern(pattern: str) -> str | None:
    """The pattern, or None for one that doesn't compile or nests repeats (it could take exponential time)."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return None if _RISKY.search(pattern) else pattern


def parse_where(spec: str, columns: list[str]) -> tuple[str, str, str]:
    """(column, op, value); the longest column name that an operator follows wins, so odd names work."""
    for name in sorted(columns, key=len, reverse=True):
        if spec.startswith(name):
            rest = spec[len(name) :].lstrip()
            for op in _OPS:
                if rest.startswith(op):
                    return name, op, rest[len(op) :].strip()
    raise ValueError(f"no column of {columns} begins {spec!r}")


def compare(cell: Column, op: str, value: str) -> Column:
    """= and != on text, missing as ''; ranges on numbers where both sides are, else on text, and never for blanks."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    if op == "=":
        return text == value
    if op == "!=":
        return text != value
    if op == "~=":
        pattern = safe_pattern(value)
        return text.rlike(pattern) if pattern is not None else F.lit(False)
    test = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}[op]
    as_text = test(text, F.lit(value))
    if re.match(NUMBER, value):
        as_text = F.when(is_number(text), test(number(text), F.lit(float(value)))).otherwise(as_text)
    return F.when(F.trim(text) == "", F.lit(False)).otherwise(as_text)


def where(df: DataFrame, specs: list[str]) -> DataFrame:
    """Rows that meet all specs."""
    parsed = [parse_where(s, df.columns) for s in specs]
    return df.where(reduce(lambda a, b: a & b, [compare(F.col(f"`{c}`"), op, v) for c, op, v in parsed], F.lit(True)))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


_TERM = re.compile(r"^\s*(!?)\s*(@|[\w.$-]+)\s*(?:(\*=|\^=|\$=|!=|<=|>=|=|<|>)\s*(\"[^\"]*\"|'[^']*'|[^\s].*?)\s*(\bi)?)?\s*$")


def json_filter(column: str, text: str) -> Column:
    """The filter language over a JSON text column: terms `key`, `!key`, `key op value [i]`; && binds before ||.

    = compares the value's text; != is its complement and true for a missing key; *= ^= $= look into scalars; ranges
    compare numbers where the literal is one without quotes and the value too, else text. @ is the element itself.
    """
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [_json_term(column, t) for t in part.split("&&")]) for part in text.split("||")])


def _json_term(column: str, text: str) -> Column:
    m = _TERM.match(text)
    if not m:
        raise ValueError(f"not a filter term: {text!r}")
    absent, key, op, literal, flag = m.groups()
    value = F.col(column) if key == "@" else F.get_json_object(column, f"$.{key}")
    if op is None:
        return value.isNull() if absent else value.isNotNull()
    quoted = literal[0] in "\"'"
    raw = literal[1:-1] if quoted else literal
    have, want = (F.lower(value), raw.lower()) if flag else (value, raw)
    if op == "=":
        return F.coalesce(have == want, F.lit(False))
    if op == "!=":
        return F.coalesce(have != want, F.lit(True))
    if op in ("*=", "^=", "$="):
        test = {"*=": have.contains(want), "^=": have.startswith(want), "$=": have.endswith(want)}[op]
        return F.coalesce(test & ~value.rlike(r"^\s*[\[{]"), F.lit(False))
    test = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__}[op]
    if not quoted and re.match(NUMBER, raw):
        return F.coalesce(F.when(is_number(value), test(number(value), F.lit(float(raw)))), F.lit(False))
    return F.coalesce(test(have, F.lit(want)), F.lit(False))
