"""Row conditions written as text, turned into one Spark ``Column``.

Python's own expression grammar covers what data-frame queries use: comparisons,
``and``/``or``/``not`` (also ``&``, ``|``, ``~``), ``in [...]``, chained comparisons,
arithmetic and a few column methods.  SQL's words for the same things (``AND``, ``=``,
``<>``, ``IN (..)``, ``LIKE``, ``BETWEEN``, ``IS NULL``) are respelled in that grammar and
follow the same rules.  Only text that uses more of SQL, such as its functions, goes to
Spark SQL as it is, with SQL's null rules.

Missing values follow data frames, not SQL: a comparison with a missing value is
false, hence ``!=``, ``not in`` and a negated comparison keep such rows.  Negations
are pushed inward and nulls admitted by ``OR x IS NULL``, so that plain conjuncts
stay plain and reach the file scan.
"""

from __future__ import annotations

import ast
import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import col, is_missing, kind_of

COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt,
           ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
OPPOSITE = {ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.Lt: ast.GtE,
            ast.LtE: ast.Gt, ast.Gt: ast.LtE, ast.GtE: ast.Lt,
            ast.In: ast.NotIn, ast.NotIn: ast.In}
ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}

BACKTICKED = re.compile(r"`((?:[^`\\]|\\`|``)+)`")
QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\"""")
OPERATOR = re.compile("[=!<>]=|[<>]")
CONNECTIVE = re.compile(r"\b(and|or|not|like|rlike|in|between|is)\b", re.IGNORECASE)
SYMBOLS = {"==": ast.Eq, "!=": ast.NotEq, ">=": ast.GtE, "<=": ast.LtE, ">": ast.Gt, "<": ast.Lt}


class _Value:
    """A side of a comparison: its expression, its kind and where it can be missing."""

    def __init__(self, column: Column, kind: str, sources: list[tuple[Column, T.DataType]], literal=None):
        self.column, self.kind, self.sources, self.literal = column, kind, sources, literal

    @property
    def missing(self) -> Column | None:
        tests = [is_missing(c, t) for c, t in self.sources]
        return reduce(operator.or_, tests) if tests else None

    @property
    def nan(self) -> Column | None:
        tests = [F.isnan(c) for c, t in self.sources if isinstance(t, (T.FloatType, T.DoubleType))]
        return reduce(operator.or_, tests) if tests else None


class _Condition:
    def __init__(self, schema: T.StructType, aliases: dict[str, str]):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.aliases = aliases

    # -- truth -----------------------------------------------------------------
    def truth(self, node: ast.expr, negated: bool = False) -> Column:
        if isinstance(node, ast.BoolOp) or (
            isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr))
        ):
            parts = node.values if isinstance(node, ast.BoolOp) else [node.left, node.right]
            both = isinstance(node.op, (ast.And, ast.BitAnd)) != negated
            return reduce(operator.and_ if both else operator.or_, [self.truth(p, negated) for p in parts])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return self.truth(node.operand, not negated)
        if isinstance(node, ast.Compare):
            return self.chained(node, negated)
        if isinstance(node, ast.Call):
            return self.method(node, negated)
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value != negated)
        value = self.value(node)
        if value.kind != "bool":
            raise ValueError(f"not a condition: {ast.unparse(node)}")
        return ~value.column if negated else value.column

    def chained(self, node: ast.Compare, negated: bool) -> Column:
        sides = [node.left, *node.comparators]
        links = [
            self.comparison(a, OPPOSITE[type(op)] if negated else type(op), b, negated)
            for a, op, b in zip(sides, node.ops, sides[1:])
        ]
        return reduce(operator.or_ if negated else operator.and_, links)

    def comparison(self, a: ast.expr, op: type, b: ast.expr, negated: bool) -> Column:
        """One link of a chain; ``negated`` says that missing values make it true."""
        if isinstance(b, (ast.List, ast.Tuple, ast.Set)):
            inside = op in (ast.In, ast.Eq)
            return self.membership(self.value(a), [self.value(e) for e in b.elts], inside)
        if op in (ast.In, ast.NotIn):
            raise ValueError(f"'in' needs a list: {ast.unparse(b)}")
        left, right = self.align(self.value(a), self.value(b), op)
        keeps_missing = op is ast.NotEq or (negated and op is not ast.Eq)
        if left is None:
            return F.lit(op is ast.NotEq)
        result = COMPARE[op](left.column, right.column)
        if keeps_missing:
            for side in (left, right):
                if side.missing is not None:
                    result = result | side.missing
            return result
        for side in (left, right):  # NaN sorts above all numbers and equals itself in Spark
            if side.nan is not None and (side.literal is None or op is not ast.Eq):
                result = result & ~side.nan
        return result

    def align(self, left: _Value, right: _Value, op: type):
        """Make both sides comparable, or ``(None, None)`` when they can never be equal."""
        kinds = {left.kind, right.kind}
        if kinds == {"none"} or "none" in kinds:
            return None, None
        if len(kinds) == 1 or kinds <= {"int", "float", "bool"}:
            return left, right
        if "time" in kinds and "text" in kinds:
            return tuple(
                _Value(s.column.try_cast("timestamp_ntz"), "time", s.sources, s.literal) if s.kind == "text" else s
                for s in (left, right)
            )
        if op in (ast.Eq, ast.NotEq):
            return None, None
        sides = []
        for side in (left, right):
            if side.kind == "text" and side.literal is not None:  # `n` > '5'
                side = _Value(F.lit(float(side.literal)), "float", [], float(side.literal))
            sides.append(side)
        if {s.kind for s in sides} <= {"int", "float", "bool"}:
            return tuple(sides)
        raise ValueError("text and numbers have no order between them")

    def membership(self, value: _Value, items: list[_Value], inside: bool) -> Column:
        usable = [i for i in items if i.kind == value.kind or {i.kind, value.kind} <= {"int", "float", "bool"}]
        if value.kind == "time":
            usable = [_Value(i.column.try_cast("timestamp_ntz"), "time", []) for i in items if i.kind == "text"]
        takes_missing = any(i.kind == "none" for i in items)
        hit = value.column.isin(*[i.column for i in usable]) if usable else F.lit(False)
        absent = value.missing if value.missing is not None else F.lit(False)
        if inside:
            return hit | absent if takes_missing else hit
        return ~hit & ~absent if takes_missing else ~hit | absent

    # -- values ----------------------------------------------------------------
    def value(self, node: ast.expr) -> _Value:
        if isinstance(node, ast.Name):
            name = self.aliases.get(node.id, node.id)
            if name not in self.types:
                raise KeyError(name)
            dtype = self.types[name]
            return _Value(col(name), kind_of(dtype), [(col(name), dtype)])
        if isinstance(node, ast.Constant):
            if node.value is None:
                return _Value(F.lit(None), "none", [])
            kinds = {bool: "bool", int: "int", float: "float", str: "text"}
            return _Value(F.lit(node.value), kinds[type(node.value)], [], node.value)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = self.value(node.operand)
            if isinstance(node.op, ast.UAdd):
                return inner
            literal = -inner.literal if inner.literal is not None else None
            column = F.lit(literal) if literal is not None else -inner.column
            return _Value(column, inner.kind, inner.sources, literal)
        if isinstance(node, ast.BinOp):
            return self.arithmetic(node)
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Attribute) and node.value.attr == "dt":
            source = self.value(node.value.value)
            parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour,
                     "minute": F.minute, "second": F.second, "quarter": F.quarter}
            return _Value(parts[node.attr](source.column), "int", source.sources)
        raise ValueError(f"cannot use {ast.unparse(node)} in a condition")

    def arithmetic(self, node: ast.BinOp) -> _Value:
        a, b = self.value(node.left), self.value(node.right)
        sources = a.sources + b.sources
        if {a.kind, b.kind} == {"text"} and isinstance(node.op, ast.Add):
            return _Value(F.concat(a.column, b.column), "text", sources)
        if not {a.kind, b.kind} <= {"int", "float"}:
            raise ValueError(f"not a calculation with numbers: {ast.unparse(node)}")
        kind = "int" if a.kind == b.kind == "int" else "float"
        if type(node.op) in ARITHMETIC:
            return _Value(ARITHMETIC[type(node.op)](a.column, b.column), kind, sources)
        if isinstance(node.op, ast.Pow):
            return _Value(F.pow(a.column, b.column), "float", sources)
        x, y = a.column.cast("double"), F.nullif(b.column.cast("double"), F.lit(0.0))
        if isinstance(node.op, ast.Div):
            return _Value(x / y, "float", sources)
        if isinstance(node.op, ast.FloorDiv):
            return _Value(F.floor(x / y), kind, sources)
        if isinstance(node.op, ast.Mod):
            return _Value(F.pmod(a.column, F.nullif(b.column, F.lit(0))), kind, sources)
        raise ValueError(f"unknown calculation {ast.unparse(node)}")

    # -- methods ---------------------------------------------------------------
    def method(self, node: ast.Call, negated: bool) -> Column:
        if not isinstance(node.func, ast.Attribute):
            raise ValueError(f"cannot call {ast.unparse(node.func)} in a condition")
        name, owner = node.func.attr, node.func.value
        on_text = isinstance(owner, ast.Attribute) and owner.attr == "str"
        target = self.value(owner.value if on_text else owner)
        options = {k.arg: ast.literal_eval(k.value) for k in node.keywords}
        absent = target.missing if target.missing is not None else F.lit(False)
        if name in ("isnull", "isna", "notnull", "notna"):
            return ~absent if name.startswith("not") != negated else absent
        if name == "isin":
            return self.membership(target, [self.value(e) for e in node.args[0].elts], not negated)
        if name == "between":
            low, high = (ast.Compare(owner, [op], [arg]) for op, arg in zip((ast.GtE(), ast.LtE()), node.args))
            return self.truth(ast.BoolOp(ast.And(), [low, high]), negated)
        if name in ("like", "rlike"):
            hit = getattr(target.column.cast("string"), name)(ast.literal_eval(node.args[0]))
            return ~hit | absent if negated else hit
        if on_text and name in ("contains", "startswith", "endswith"):
            word = ast.literal_eval(node.args[0])
            if name == "contains":
                plain = options.get("regex", True) is False
                pattern = re.escape(word) if plain else word
                if options.get("case", True) is False:
                    pattern = "(?i)" + pattern
                hit = target.column.contains(word) if pattern == word and word.isalnum() else target.column.rlike(pattern)
            else:
                hit = getattr(target.column, name)(word)
            return ~hit | absent if negated else hit
        raise ValueError(f"unknown method {name}")


def _named(text: str) -> tuple[str, dict[str, str]]:
    """Give every back-quoted name outside quoted text a plain stand-in."""
    aliases: dict[str, str] = {}
    pieces, at = [], 0
    pattern = re.compile(f"{QUOTED.pattern}|{BACKTICKED.pattern}")
    for match in pattern.finditer(text):
        pieces.append(text[at:match.start()])
        if match.group(0).startswith("`"):
            stand_in = f"quoted_name_{len(aliases)}"
            aliases[stand_in] = match.group(1).replace("\\`", "`").replace("``", "`")
            pieces.append(stand_in)
        else:
            pieces.append(match.group(0))
        at = match.end()
    return "".join([*pieces, text[at:]]), aliases


def _literal(text: str) -> ast.Constant | None:
    """A number, a quoted text or bare words; None if more than one literal is there."""
    if QUOTED.fullmatch(text):
        return ast.Constant(text[1:-1])
    if not text or OPERATOR.search(text) or CONNECTIVE.search(text) or QUOTED.search(text):
        return None
    try:
        return ast.Constant(float(text))
    except ValueError:
        return ast.Constant(text)


def _single_comparison(text: str, schema: T.StructType) -> Column | None:
    """One column name, one operator, one literal, such as ``unit price > 3``; None for anything else.

    The name is looked for in the schema, longest first, so it may hold blanks or signs."""
    for name in sorted(schema.fieldNames(), key=len, reverse=True):
        for spelled in (name, "`" + name.replace("`", "\\`") + "`"):
            rest = text.strip().removeprefix(spelled).lstrip()
            sign = OPERATOR.match(rest) if text.strip().startswith(spelled) else None
            literal = sign and _literal(rest[sign.end():].strip())
            if literal:
                return _Condition(schema, {}).comparison(ast.Name(name), SYMBOLS[sign[0]], literal, False)
    return None


SQL_TEXT = re.compile(r"'(?:[^'\\]|'')*'")
SQL_SPELLINGS = [(re.compile(pattern, re.IGNORECASE), to) for pattern, to in (
    (r"(\w+)\s+is\s+not\s+null\b", r"\1.notnull()"),
    (r"(\w+)\s+is\s+null\b", r"\1.isnull()"),
    (r"(\w+)\s+not\s+between\s+([-\w.]+)\s+and\s+([-\w.]+)", r"(not \1.between(\2, \3))"),
    (r"(\w+)\s+between\s+([-\w.]+)\s+and\s+([-\w.]+)", r"\1.between(\2, \3)"),
    (r"(\w+)\s+not\s+(r?like)\s+(\w+)", r"(not \1.\2(\3))"),
    (r"(\w+)\s+(r?like)\s+(\w+)", r"\1.\2(\3)"),
    (r"\bin\s*\(([^()]*)\)", r"in [\1]"),
    (r"<>", "!="),
    (r"(?<![<>=!])=(?!=)", "=="),
)]


def _respelled(text: str) -> str | None:
    """SQL's words as Python's; None where a text holds marks that the two read differently."""
    texts: list[str] = []

    def put_aside(match: re.Match) -> str:
        texts.append(match[0][1:-1].replace("''", "'"))
        return f" quoted_text_{len(texts) - 1} "

    plain = SQL_TEXT.sub(put_aside, text)
    if any(mark in plain for mark in "'\"\\"):
        return None
    for pattern, spelling in SQL_SPELLINGS:
        plain = pattern.sub(spelling, plain)
    plain = re.sub(r"\b(and|or|not|in|like|rlike|between|isnull|notnull)\b", lambda m: m[0].lower(), plain, flags=re.IGNORECASE)
    return re.sub(r"\bquoted_text_(\d+)\b", lambda m: repr(texts[int(m[1])]), plain)


def _sql_words(text: str, aliases: dict[str, str], schema: T.StructType) -> Column | None:
    """A condition in SQL's words read by the rules of this module; None if it says more than those."""
    spelled = _respelled(text)
    try:
        return spelled and _Condition(schema, aliases).truth(ast.parse(spelled.strip(), mode="eval").body)
    except (SyntaxError, KeyError, ValueError):
        return None


def to_condition(text: str, schema: T.StructType) -> Column:
    """The ``Column`` that is true for the rows to keep."""
    renamed, aliases = _named(text.strip())
    try:
        tree = ast.parse(renamed, mode="eval").body
    except SyntaxError:
        tree = None
    if tree is not None:
        try:
            return _Condition(schema, aliases).truth(tree)
        except KeyError as unknown:
            single = _single_comparison(text, schema)
            if single is None:
                raise ValueError(f"unknown column {unknown} in condition: {text}") from None
            return single
    single = _single_comparison(text, schema)
    if single is not None:
        return single
    worded = _sql_words(renamed, aliases, schema)
    return F.expr(text) if worded is None else worded
