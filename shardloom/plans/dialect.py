"""MySQL and PostgreSQL text to Spark SQL.

A small tokenizer keeps strings, quoted names, comments and operators apart; rules then rewrite tokens. Infix
operators that Spark lacks become function calls on their operands: a primary (name, literal, call, parentheses,
with any casts) on either side, from left to right, which is how such operators bind in the source dialects.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any


class DialectError(ValueError):
    """Text that the dialect refuses or that can't be translated."""


_TOKEN = re.compile(
    r"""
    (?P<name>(?![eE]')[A-Za-z_][\w$]*)
  | (?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<string>[eE]?'(?:[^'\\]|\\.|'')*')
  | (?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)
  | (?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
  | (?P<param>\$\d+|:[A-Za-z_]\w*)
  | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
  | (?P<op>\#>>|\#>|->>|->|!~\*|!~|~\*|~|@@|@>|<@|\?\||\?&|&&|\|\||::|<=>|<>|!=|>=|<=|:=|[-+*/%<>=(),.;\[\]?^&|:])
    """,
    re.X | re.S,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str

    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text


def tokenize(sql: str) -> list[Token]:
    return _tokens(sql, False)


def code(sql: str) -> list[Token]:
    """Tokens without white space and comments."""
    return _tokens(sql, True)


def _tokens(sql: str, bare: bool) -> list[Token]:
    out, at, end = [], 0, len(sql)
    step = _TOKEN.scanner(sql).match
    while at < end:
        m = step()
        if m is None:
            raise DialectError(f"unexpected character {sql[at]!r} at {at}")
        kind, at = m.lastgroup, m.end()
        if not bare or kind != "space":
            out.append(Token("dollar" if kind == "tag" else kind, m[0]))
    return out


def text_of(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


# -- checks --------------------------------------------------------------------------------------------------------


def check_postgresql(sql: str) -> None:
    """Refuses what only MySQL has."""
    toks = code(sql)
    for i, t in enumerate(toks):
        if t.kind == "quoted" and t.text.startswith("`"):
            raise DialectError("backticks are not PostgreSQL")
        if t.word() == "AUTO_INCREMENT":
            raise DialectError("AUTO_INCREMENT is not PostgreSQL")
        if t.word() == "LIMIT" and i + 2 < len(toks) and toks[i + 2].text == ",":
            raise DialectError("LIMIT offset, count is not PostgreSQL")


def to_dollar(sql: str) -> str:
    """`?` placeholders to $1, $2, ...; text that has $n already, and strings, stay."""
    toks = tokenize(sql)
    if any(t.kind == "param" and t.text.startswith("$") for t in toks):
        return sql
    n = 0
    for t in toks:
        if t.text == "?" and t.kind == "op":
            n += 1
            t.text = f"${n}"
    return text_of(toks)


def to_postgresql(sql: str) -> str:
    """MySQL names and placeholders as PostgreSQL has them."""
    toks = tokenize(to_dollar(sql))
    for t in toks:
        if t.kind == "quoted" and t.text.startswith("`"):
            t.text = '"' + t.text[1:-1].replace("``", "`").replace('"', '""') + '"'
    return text_of(toks)


def rename_tables(sql: str, names: dict[str, str]) -> str:
    """Whole unquoted or quoted identifiers, by exact name; strings and comments stay."""
    toks = tokenize(sql)
    for t in toks:
        if t.kind == "name" and t.text in names:
            t.text = names[t.text]
        elif t.kind == "quoted" and t.text[1:-1] in names:
            t.text = t.text[0] + names[t.text[1:-1]] + t.text[-1]
    return text_of(toks)


# -- translation ---------------------------------------------------------------------------------------------------

#: Types that Spark has under another name.
TYPES = {
    "JSONB": "string", "JSON": "string", "TEXT": "string", "VARCHAR": "string", "UUID": "string", "INET": "string", "CIDR": "string", "XML": "string",
    "INT4": "int", "INT8": "bigint", "INT2": "smallint", "SERIAL": "int", "BIGSERIAL": "bigint", "FLOAT8": "double", "FLOAT4": "float", "REAL": "float",
    "NUMERIC": "decimal(38,18)", "DECIMAL": "decimal(38,18)", "BOOL": "boolean", "TIMESTAMPTZ": "timestamp", "BYTEA": "binary", "SIGNED": "bigint", "UNSIGNED": "bigint", "CHAR": "string", "DATETIME": "timestamp_ntz",
}
#: Functions that only differ in name.
FUNCTIONS = {"ARRAY_TO_STRING": "array_join", "UNNEST": "explode", "JSONB_ARRAY_LENGTH": "json_array_length", "IFNULL": "ifnull", "GROUP_CONCAT": "string_agg", "RANDOM": "rand", "GEN_RANDOM_UUID": "uuid"}
_FORMATS = [("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("MI", "mm"), ("SS", "ss"), ("DD", "dd"), ("MM", "MM")]
_JSON_TYPES = ("JSONB", "JSON")
_INFIX = {"||json", "->", "->>", "#>", "#>>", "@>", "<@", "?|", "?&", "&&", "@@", "~", "~*", "!~", "!~*"}
_STOP = frozenset("SELECT FROM WHERE AND OR NOT ON WHEN THEN ELSE CASE BY IN LIKE ILIKE BETWEEN SET VALUES HAVING DISTINCT AS IS LIMIT OFFSET".split())


@dataclass
class Statement:
    """Spark SQL with the names of its parameters, in the order of the caller's arguments."""

    sql: str
    params: list[str] = field(default_factory=list)

    def args(self, values: tuple) -> dict[str, Any]:
        if len(values) < len(self.params):
            raise DialectError(f"{len(self.params)} parameters, {len(values)} arguments")
        return dict(zip(self.params, values))


class _Writer:
    def __init__(self, sql: str, dialect: str):
        self.toks, self.dialect = code(sql), dialect
        self.dollars = any(t.kind == "param" and t.text.startswith("$") for t in self.toks)
        self.params: list[str] = []

    # A step works on self.toks in place, innermost things first.

    def run(self) -> Statement:
        self.literals()
        self.parameters()
        self.json_concatenation()
        self.calls()
        self.casts()
        self.arrays()
        self.infix()
        self.clauses()
        return Statement(_spaced(self.toks), self.params)

    def literals(self) -> None:
        for t in self.toks:
            if t.kind == "dollar":
                body = re.fullmatch(r"\$[A-Za-z_]*\$(.*)\$[A-Za-z_]*\$", t.text, re.S)[1]
                t.kind, t.text = "string", _string(body)
            elif t.kind == "string":
                escaped = t.text[0] in "eE"
                body = t.text[2:-1] if escaped else t.text[1:-1]
                body = body.replace("''", "'")
                if escaped or self.dialect == "mysql":
                    body = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1] if m[1] not in "%_" else m[0]), body, flags=re.S)
                t.text = _string(body)
            elif t.kind == "quoted" and t.text.startswith('"'):
                if self.dialect == "mysql":
                    t.kind, t.text = "string", _string(t.text[1:-1].replace('""', '"'))
                else:
                    t.text = "`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`"

    def parameters(self) -> None:
        n = 0
        for i, t in enumerate(self.toks):
            if t.kind == "param" and t.text.startswith("$"):
                t.text = f":p{t.text[1:]}"
                n = max(n, int(t.text[2:]))
            elif t.text == "?" and t.kind == "op" and not (self.dialect == "postgresql" and (self.dollars or self.key_test(i))):
                n += 1
                t.kind, t.text = "param", f":p{n}"
        self.params = [f"p{i}" for i in range(1, n + 1)]

    def json_concatenation(self) -> None:
        """Marks each || that joins JSON: an operand is cast to JSON or is a literal of an object or array."""
        for i, t in enumerate(self.toks):
            if t.text != "||" or not 0 < i < len(self.toks) - 1:
                continue
            before, after = self.toks[i - 1], self.toks[i + 1]
            cast = before.word() in _JSON_TYPES and self.toks[i - 2].text == "::" or [x.word() for x in self.toks[i + 2 : i + 4]] in (["::", y] for y in _JSON_TYPES)
            if cast or _json_literal(before) or _json_literal(after):
                t.text = "||json"

    def key_test(self, at: int) -> bool:
        """Whether the `?` there stands between an operand and a string: JSON's operator, as no placeholder can."""
        before, after = self.toks[at - 1 : at], self.toks[at + 1 : at + 2]
        ends = any(t.kind in ("quoted", "string") or t.text in (")", "]") or (t.kind == "name" and t.word() not in _STOP) for t in before)
        return ends and any(t.kind == "string" for t in after)

    def close(self, at: int) -> int:
        """Place of the bracket that ends the one at `at`."""
        depth = 0
        for i in range(at, len(self.toks)):
            depth += self.toks[i].text in ("(", "[")
            depth -= self.toks[i].text in (")", "]")
            if depth == 0:
                return i
        raise DialectError("unbalanced brackets")

    def open(self, at: int) -> int:
        depth = 0
        for i in range(at, -1, -1):
            depth += self.toks[i].text in (")", "]")
            depth -= self.toks[i].text in ("(", "[")
            if depth == 0:
                return i
        raise DialectError("unbalanced brackets")

    def arguments(self, at: int) -> list[list[Token]]:
        """Those between the parenthesis at `at` and its end."""
        end, out, depth = self.close(at), [[]], 0
        for t in self.toks[at + 1 : end]:
            depth += t.text in ("(", "[")
            depth -= t.text in (")", "]")
            if t.text == "," and depth == 0:
                out.append([])
            else:
                out[-1].append(t)
        return out if out != [[]] else []

    def inner(self, toks: list[Token]) -> str:
        w = _Writer("", self.dialect)
        w.toks, w.dollars = toks, self.dollars
        w.calls()
        w.casts()
        w.arrays()
        w.infix()
        return _spaced(w.toks)

    def put(self, begin: int, end: int, text: str) -> None:
        self.toks[begin:end] = [Token("done", text)]

    def calls(self) -> None:
        i = 0
        while i < len(self.toks):
            t = self.toks[i]
            call = i + 1 < len(self.toks) and self.toks[i + 1].text == "("
            w = t.word() if t.kind == "name" else ""
            if w == "ANY" and call and i and self.toks[i - 1].text == "=":
                begin, array = self.left(i - 1), self.inner(self.toks[i + 2 : self.close(i + 1)])
                value = self.inner(self.toks[begin : i - 1])
                self.put(begin, self.close(i + 1) + 1, f"array_contains({array}, {value})")
                i = begin
            elif w == "EXTRACT" and call and self.toks[i + 2].word() == "EPOCH":
                end = self.close(i + 1)
                self.put(i, end + 1, f"unix_timestamp({self.inner(self.toks[i + 4 : end])})")
            elif w in ("DATE_SUB", "DATE_ADD") and call and len(args := self.arguments(i + 1)) == 2 and args[1] and args[1][0].word() == "INTERVAL":
                sign = "-" if w == "DATE_SUB" else "+"
                self.put(i, self.close(i + 1) + 1, f"({self.inner(args[0])} {sign} {self.inner(args[1])})")
            elif call and w in _CALLS:
                args = [self.inner(a) for a in self.arguments(i + 1)]
                self.put(i, self.close(i + 1) + 1, _CALLS[w](args))
            elif call and w in FUNCTIONS:
                t.text = FUNCTIONS[w]
            i += 1

    def casts(self) -> None:
        for i, t in enumerate(self.toks):
            before = self.toks[i - 1].text if i else ""
            if t.kind == "name" and t.word() in TYPES and (before == "::" or (before.upper() == "AS" and i > 1 and i + 1 < len(self.toks) and self.toks[i + 1].text in (")", "("))):
                sized = i + 1 < len(self.toks) and self.toks[i + 1].text == "("
                if sized and t.word() in ("NUMERIC", "DECIMAL"):
                    t.text = "decimal"
                    continue
                if sized:
                    del self.toks[i + 1 : self.close(i + 1) + 1]
                t.text = TYPES[t.word()]
                if i + 2 < len(self.toks) and self.toks[i + 1].text == "[" and self.toks[i + 2].text == "]":
                    t.text = f"array<{t.text}>"
                    del self.toks[i + 1 : i + 3]

    def arrays(self) -> None:
        for i in range(len(self.toks) - 2, -1, -1):
            if self.toks[i].word() == "ARRAY" and self.toks[i + 1].text == "[":
                end = self.close(i + 1)
                self.put(i, end + 1, f"array({self.inner(self.toks[i + 2 : end])})")

    def left(self, at: int) -> int:
        """Begin of the primary that ends before `at`."""
        i = at - 1
        while i > 0:
            t = self.toks[i]
            if t.text in (")", "]"):
                i = self.open(i)
                if i and self.toks[i - 1].kind in ("name", "quoted", "done") and self.toks[i - 1].word() not in _STOP:
                    i -= 1
                    continue
            if self.toks[i - 1].text in (".", "::"):
                i -= 2
                continue
            break
        return i

    def right(self, at: int) -> int:
        """End of the primary that begins at `at`."""
        i = at
        if self.toks[i].text in ("-", "+"):
            i += 1
        i = self.close(i) + 1 if self.toks[i].text == "(" else i + 1
        while i < len(self.toks):
            t = self.toks[i].text
            if t in ("(", "["):
                i = self.close(i) + 1
            elif t in (".", "::"):
                i += 2
            else:
                break
        return i

    def infix(self) -> None:
        i = 0
        while i < len(self.toks):
            t = self.toks[i]
            op = t.text
            json_key = op == "?" and t.kind == "op"
            similar = t.word() == "SIMILAR" and i + 1 < len(self.toks) and self.toks[i + 1].word() == "TO"
            if not (t.kind == "op" and (op in _INFIX or json_key)) and not similar:
                i += 1
                continue
            negated = similar and i and self.toks[i - 1].word() == "NOT"
            begin, end = self.left(i - negated), self.right(i + 1 + similar)
            a, b_toks = self.inner(self.toks[begin : i - negated]), self.toks[i + 1 + similar : end]
            b = self.inner(b_toks)
            if similar:
                out = f"{'NOT ' if negated else ''}{_similar(a, b)}"
            else:
                out = _OPERATORS[op](a, b)
            self.put(begin, end, out)
            i = begin + 1

    def clauses(self) -> None:
        i = 0
        while i < len(self.toks):
            if self.toks[i].word() == "LIMIT" and i + 3 < len(self.toks) and self.toks[i + 2].text == ",":
                offset, count = self.toks[i + 1], self.toks[i + 3]
                self.toks[i + 1 : i + 4] = [count, Token("name", "OFFSET"), offset]
            i += 1


def _spaced(toks: list[Token]) -> str:
    out = ""
    for i, t in enumerate(toks):
        tight = not i or t.text in (".", ",", ")", "]", "::", ";", "[") or toks[i - 1].text in (".", "(", "[", "::") or (t.text == "(" and toks[i - 1].kind == "name" and toks[i - 1].word() not in _BEFORE_PAREN)
        out += t.text if tight else f" {t.text}"
    return out


_BEFORE_PAREN = _STOP | frozenset("JOIN OVER USING EXISTS FILTER UNION ALL INTERSECT EXCEPT INTO TABLE WITH RECURSIVE GROUP ORDER".split())


def _string(body: str) -> str:
    return "'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _json_literal(t: Token) -> bool:
    if t.kind != "string" or t.text[1:2] not in ("{", "["):
        return False
    try:
        json.loads(t.text[1:-1].replace("\\'", "'").replace("\\\\", "\\"))
    except ValueError:
        return False
    return True


def _json_joined(a: str, b: str) -> str:
    """Objects: the right one's keys count. Anything else joins as arrays do, a lone value being an array of one."""
    left, right = (f"from_json({x}, 'map<string,variant>')" for x in (a, b))
    both = f"map_concat(map_filter({left}, (k, v) -> NOT array_contains(map_keys({right}), k)), {right})"
    items = ", ".join(f"CASE WHEN {x} LIKE '[%' THEN from_json({x}, 'array<variant>') ELSE array(parse_json({x})) END" for x in (a, b))
    return f"CASE WHEN {a} LIKE '{{%' AND {b} LIKE '{{%' THEN to_json({both}) ELSE to_json(concat({items})) END"


def _is_json(b: str) -> bool:
    return b.startswith("'") and b[1:2] in "{[" or b.startswith("('")


def _key(b: str) -> str:
    """A JSON path step from a literal key or index."""
    return f"concat('$[', {b}, ']')" if re.fullmatch(r"-?\d+", b) else f"concat('$.', {b})"


def _path(b: str) -> str:
    m = re.fullmatch(r"'\{(.*)\}'", b, re.S)
    if m is None:
        raise DialectError("a JSON path must be a literal like '{a,b}'")
    return _string("$" + "".join(f"[{k}]" if re.fullmatch(r"\d+", k) else f".{k}" for k in (x.strip() for x in m[1].split(",")) if k))


def _contains(a: str, b: str) -> str:
    """a @> b: arrays by difference, a JSON literal by its leaves. Nested JSON arrays contain by their elements' text."""
    m = re.match(r"\(?('(?:[^'\\]|\\.)*')", b)
    if m is None or "array(" in b:
        return f"(size(array_except({b}, {a})) = 0)"
    body = m[1][1:-1].replace("\\'", "'").replace("\\\\", "\\")
    try:
        value = json.loads(body)
    except ValueError:
        items = re.fullmatch(r"\{(.*)\}", body, re.S)
        if items is None:
            raise DialectError(f"not JSON: {body}") from None
        array = ", ".join(_string(x.strip().strip('"')) for x in items[1].split(",") if x.strip())
        return f"(size(array_except(array({array}), {a})) = 0)"
    tests: list[str] = []

    def leaves(x: Any, path: str) -> None:
        if isinstance(x, dict):
            tests.append(f"get_json_object({a}, {_string(path)}) IS NOT NULL")
            for k, v in x.items():
                leaves(v, f"{path}.{k}")
        elif isinstance(x, list):
            held = f"from_json(get_json_object({a}, {_string(path)}), 'array<string>')"
            tests.extend(f"array_contains({held}, {_string(v if isinstance(v, str) else json.dumps(v))})" for v in x)
            tests.append(f"{held} IS NOT NULL")
        elif x is None:
            tests.append(f"(get_json_object({a}, {_string(path)}) IS NULL)")
        else:
            tests.append(f"coalesce(get_json_object({a}, {_string(path)}) = {_string(x if isinstance(x, str) else json.dumps(x))}, false)")

    leaves(value, "$")
    return f"({' AND '.join(tests)})"


def _keys(a: str, b: str, every: bool) -> str:
    found = f"coalesce(json_object_keys({a}), array())"
    if every:
        return f"(size(array_except({b}, {found})) = 0)"
    return f"arrays_overlap({found}, {b})"


def _similar(a: str, b: str) -> str:
    m = re.fullmatch(r"'(.*)'", b, re.S)
    if m is None:
        raise DialectError("SIMILAR TO needs a literal pattern")
    out = "".join({"%": ".*", "_": "."}.get(c, f"\\\\{c}" if c in ".^$" else c) for c in m[1])
    return f"({a} RLIKE '^(?s:{out})$')"


_WORDS = r"'[^\\p{L}\\p{N}_]+'"


def _vector(x: str) -> str:
    """Distinct lower-case words; no stemming and no stop words."""
    return f"array_distinct(filter(split(lower({x}), {_WORDS}), w -> w <> ''))"


def _format(x: str) -> str:
    for a, b in _FORMATS:
        x = x.replace(a, b)
    return x


_CALLS: dict[str, Any] = {
    "TO_TSVECTOR": lambda a: _vector(a[-1]),
    "TO_TSQUERY": lambda a: _vector(a[-1]),
    "PLAINTO_TSQUERY": lambda a: _vector(a[-1]),
    "TS_RANK": lambda a: f"size(array_intersect({a[0]}, {a[1]}))",
    "GENERATE_SERIES": lambda a: f"explode(sequence({', '.join(a)}))",
    "TO_CHAR": lambda a: f"date_format({a[0]}, {_format(a[1])})",
    "JSONB_AGG": lambda a: f"to_json(collect_list({a[0]}))",
    "JSON_AGG": lambda a: f"to_json(collect_list({a[0]}))",
    "JSONB_BUILD_OBJECT": lambda a: f"to_json(named_struct({', '.join(a)}))",
    "JSON_OBJECT": lambda a: f"to_json(named_struct({', '.join(a)}))",
    "JSON_EXTRACT": lambda a: f"get_json_object({a[0]}, {a[1]})",
    "JSONB_EXTRACT_PATH_TEXT": lambda a: f"get_json_object({a[0]}, concat_ws('.', '$', {', '.join(a[1:])}))",
}
_OPERATORS: dict[str, Any] = {
    "||json": _json_joined,
    "->": lambda a, b: f"get_json_object({a}, {_key(b)})",
    "->>": lambda a, b: f"get_json_object({a}, {_key(b)})",
    "#>": lambda a, b: f"get_json_object({a}, {_path(b)})",
    "#>>": lambda a, b: f"get_json_object({a}, {_path(b)})",
    "@>": _contains,
    "<@": lambda a, b: _contains(b, a),
    "?": lambda a, b: f"array_contains(json_object_keys({a}), {b})",
    "?|": lambda a, b: _keys(a, b, False),
    "?&": lambda a, b: _keys(a, b, True),
    "&&": lambda a, b: f"arrays_overlap({a}, {b})",
    "@@": lambda a, b: f"(size(array_except({b}, {a})) = 0)",
    "~": lambda a, b: f"({a} RLIKE {b})",
    "~*": lambda a, b: f"({a} RLIKE concat('(?i)', {b}))",
    "!~": lambda a, b: f"(NOT {a} RLIKE {b})",
    "!~*": lambda a, b: f"(NOT {a} RLIKE concat('(?i)', {b}))",
}


def translate(sql: str, dialect: str = "mysql") -> Statement:
    """Spark SQL for a query. dialect: mysql, postgresql, or spark (only placeholders change)."""
    if dialect == "postgresql":
        check_postgresql(sql)
    if dialect not in ("mysql", "postgresql", "spark"):
        raise DialectError(f"unknown dialect: {dialect}")
    if dialect == "spark":
        w = _Writer("", dialect)
        w.toks = tokenize(sql)
        w.dollars = any(t.kind == "param" and t.text.startswith("$") for t in w.toks)
        w.parameters()
        return Statement(text_of(w.toks), w.params)
    return _Writer(sql.rstrip().rstrip(";"), dialect).run()
