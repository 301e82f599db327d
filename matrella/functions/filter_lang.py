"""The value-filter language: short predicate texts compiled to Columns.

Two spellings share one tree: Python's (`a > 1 and b in ["x"]`) and R's (`a > 1 && b %in% c("x")`).  A predicate is built of
comparisons between a column and a constant, membership tests, null tests and boolean operators; everything else is refused.

Nulls never match, neither under `!=` nor under `not`; `not` is pushed down to the comparisons.  NaN follows IEEE: it is unequal to
everything and neither above nor below anything.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matrella.errors import FilterError

_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}
_NOT = {"<": ">=", ">=": "<", ">": "<=", "<=": ">", "==": "!=", "!=": "==", "in": "not in", "not in": "in"}
_OPS = {ast.Lt: "<", ast.Gt: ">", ast.LtE: "<=", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!=", ast.In: "in", ast.NotIn: "not in"}


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class Logic:
    op: str  # and | or
    parts: tuple


@dataclass(frozen=True)
class _Name:
    name: str


@dataclass(frozen=True)
class _Const:
    value: object


def negate(tree: Compare | Logic) -> Compare | Logic:
    if isinstance(tree, Compare):
        return Compare(tree.column, _NOT[tree.op], tree.value)
    return Logic("or" if tree.op == "and" else "and", tuple(negate(p) for p in tree.parts))


def columns_of(tree: Compare | Logic) -> list[str]:
    """Columns in order of appearance, each once."""
    if isinstance(tree, Compare):
        return [tree.column]
    return list(dict.fromkeys(c for p in tree.parts for c in columns_of(p)))


# --- Python spelling -------------------------------------------------------------------------------------------------------------------


def parse(text: str | Compare | Logic) -> Compare | Logic:
    """The tree of a predicate in Python's spelling; a tree is passed on."""
    if isinstance(text, Compare | Logic):
        return text
    if not isinstance(text, str):
        raise TypeError("a value filter must be a string")
    try:
        body = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise FilterError(f"could not parse the value filter {text!r}: {e}") from None
    tree = _walk(body)
    if not isinstance(tree, Compare | Logic):
        raise FilterError(f"the value filter {text!r} is not a condition")
    return tree


def _condition(node: ast.AST) -> Compare | Logic:
    tree = _walk(node)
    if not isinstance(tree, Compare | Logic):
        raise FilterError(f"{ast.unparse(node)!r} is not a condition")
    return tree


def _walk(node: ast.AST) -> Compare | Logic | _Name | _Const:
    match node:
        case ast.BoolOp(op=ast.And(), values=v):
            return Logic("and", tuple(map(_condition, v)))
        case ast.BoolOp(op=ast.Or(), values=v):
            return Logic("or", tuple(map(_condition, v)))
        case ast.BinOp(left=a, op=ast.BitAnd(), right=b):
            return Logic("and", (_condition(a), _condition(b)))
        case ast.BinOp(left=a, op=ast.BitOr(), right=b):
            return Logic("or", (_condition(a), _condition(b)))
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return negate(_condition(x))
        case ast.UnaryOp(op=ast.USub() | ast.UAdd() as sign, operand=x):
            c = _walk(x)
            if not isinstance(c, _Const) or isinstance(c.value, bool) or not isinstance(c.value, int | float):
                raise FilterError("a sign may only stand before a number")
            return _Const(-c.value if isinstance(sign, ast.USub) else c.value)
        case ast.Compare(left=left, ops=ops, comparators=rest):
            return _compare(left, ops, rest)
        case ast.Call(func=ast.Name(id="attr" | "val" as kind), args=[arg], keywords=[]):
            c = _walk(arg)
            if kind == "attr" and isinstance(c, _Name):
                return c
            if not isinstance(c, _Const) or (kind == "attr" and not isinstance(c.value, str)):
                raise FilterError(f"{kind}() takes one constant")
            return _Name(c.value) if kind == "attr" else c
        case ast.Name(id=name):
            return _Name(name)
        case ast.Constant(value=v):
            return _Const(v)
        case ast.List(elts=items) | ast.Tuple(elts=items) | ast.Set(elts=items):
            values = [_walk(x) for x in items]
            if not all(isinstance(v, _Const) for v in values):
                raise FilterError("a list may hold constants only")
            return _Const([v.value for v in values])
    raise FilterError(f"unsupported expression {ast.unparse(node)!r}")


def _compare(left: ast.AST, ops: list, rest: list[ast.AST]) -> Compare | Logic:
    parts = []
    for op, right in zip(ops, rest):
        if type(op) not in _OPS:
            raise FilterError(f"unsupported operator {type(op).__name__}")
        parts.append(_pair(_walk(left), _OPS[type(op)], _walk(right)))
        if isinstance(op, ast.In | ast.NotIn):
            break
        left = right
    return parts[0] if len(parts) == 1 else Logic("and", tuple(parts))


def _pair(a: object, op: str, b: object) -> Compare:
    if op in ("in", "not in"):
        if not isinstance(a, _Name) or not isinstance(b, _Const) or not isinstance(b.value, list):
            raise FilterError("membership needs a column on the left and a list of constants on the right")
        if not b.value:
            raise FilterError("a membership list may not be empty")
        return Compare(a.name, op, tuple(b.value))
    if isinstance(a, _Name) and isinstance(b, _Name):
        # a bare word on the right of a comparison is a column too; two columns can't be compared
        raise FilterError(f"columns can't be compared with each other: {a.name}, {b.name}")
    if isinstance(a, _Const) and isinstance(b, _Name):
        a, b, op = b, a, _FLIP[op]
    if not isinstance(a, _Name) or not isinstance(b, _Const) or isinstance(b.value, list):
        raise FilterError("a comparison needs a column and a constant")
    return Compare(a.name, op, b.value)


# --- R spelling ------------------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?L?)|(?P<op>%in%|%nin%|&&|\|\||<=|>=|==|!=|[<>&|!(),])|(?P<tick>`[^`]+`)|(?P<word>[A-Za-z.][\w.]*(?:::[A-Za-z.][\w.]*)?))""")
_R_CONST = {"TRUE": True, "FALSE": False, "NULL": None, "NA": None}


def _moment(value: object) -> datetime:
    """A time as text, or as seconds since the epoch."""
    return datetime.fromisoformat(value) if isinstance(value, str) else datetime(1970, 1, 1) + timedelta(seconds=value)


def _day(value: object) -> datetime:
    """The beginning of a day as text, or as days since the epoch."""
    return datetime.fromisoformat(value) if isinstance(value, str) else datetime(1970, 1, 1) + timedelta(days=value)


_R_VALUES = {"as.POSIXct": _moment, "as.POSIXlt": _moment, "as.Date": _day, "as.integer64": int, "as.integer": int, "as.numeric": float}


class _RParser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise FilterError(f"could not parse the value filter at {text[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or wanted and self.peek() != wanted:
            raise FilterError(f"expected {wanted or 'more'} in the value filter")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Compare | Logic:
        parts = [self.both()]
        while self.peek() in ("||", "|"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Logic("or", tuple(parts))

    def both(self) -> Compare | Logic:
        parts = [self.one()]
        while self.peek() in ("&&", "&"):
            self.take()
            parts.append(self.one())
        return parts[0] if len(parts) == 1 else Logic("and", tuple(parts))

    def one(self) -> Compare | Logic:
        if self.peek() == "!":
            self.take()
            return negate(self.one())
        if self.peek() == "(":
            self.take()
            tree = self.either()
            self.take(")")
            return tree
        left = self.value()
        kind, op = self.take()
        op = {"%in%": "in", "%nin%": "not in"}.get(op, op)
        if kind != "op" or op not in _NOT:
            raise FilterError(f"unsupported operator {op!r}")
        right = self.value()
        if op in ("in", "not in") and isinstance(right, _Const) and not isinstance(right.value, list):
            right = _Const([right.value])
        return _pair(left, op, right)

    def value(self) -> _Name | _Const:
        kind, text = self.take()
        if kind == "str":
            return _Const(ast.literal_eval(text))
        if kind == "num":
            text = text.rstrip("L")
            return _Const(float(text) if any(c in text for c in ".eE") else int(text))
        if kind == "tick":
            return _Name(text[1:-1])
        if kind == "word" and text in _R_CONST:
            return _Const(_R_CONST[text])
        if kind == "word" and text == "c" and self.peek() == "(":
            self.take("(")
            values = []
            while self.peek() != ")":
                v = self.value()
                if not isinstance(v, _Const):
                    raise FilterError("c() may hold constants only")
                values.append(v.value)
                if self.peek() == ",":
                    self.take()
            self.take(")")
            return _Const(values)
        if kind == "word" and text.rsplit(":", 1)[-1] in _R_VALUES and self.peek() == "(":
            self.take("(")
            inner = self.value()
            while self.peek() == ",":  # a time zone, UTC in any case
                self.take()
                self.take()
            self.take(")")
            if not isinstance(inner, _Const):
                raise FilterError(f"{text}() takes a constant")
            make = _R_VALUES[text.rsplit(":", 1)[-1]]
            try:
                return _Const([make(v) for v in inner.value] if isinstance(inner.value, list) else make(inner.value))
            except (TypeError, ValueError) as e:
                raise FilterError(f"{text}() can't take {inner.value!r}") from e
        if kind == "word":
            return _Name(text)
        raise FilterError(f"unexpected {text!r} in the value filter")


def parse_r(text: str | Compare | Logic) -> Compare | Logic:
    """The tree of a predicate in R's spelling; a tree is passed on."""
    if isinstance(text, Compare | Logic):
        return text
    p = _RParser(text)
    tree = p.either()
    if p.at != len(p.tokens):
        raise FilterError(f"unexpected {p.tokens[p.at][1]!r} in the value filter")
    return tree


# --- trees without text ------------------------------------------------------------------------------------------------------------------


def triple(column: str, value: object, op: str) -> Compare | Logic:
    """One comparison, in either spelling of the operator."""
    op = {"%in%": "in", "%nin%": "not in"}.get(op, op)
    if op not in _NOT:
        raise FilterError(f"unsupported operator {op!r}")
    return _pair(_Name(column), op, _Const(list(value) if op in ("in", "not in") else value))


def in_or_not(column: str, values: Sequence, op: str = "%in%") -> Compare | Logic:
    """Membership in a list, or its opposite."""
    if op not in ("%in%", "%nin%", "in", "not in"):
        raise FilterError(f"unsupported operator {op!r}")
    return triple(column, values, op)


def combine(a: Compare | Logic, b: Compare | Logic | None, op: str) -> Compare | Logic:
    """Two trees joined by and or or; the opposite of one."""
    op = {"&&": "and", "&": "and", "||": "or", "|": "or", "!": "not"}.get(op, op).lower()
    if op == "not":
        return negate(a)
    if op not in ("and", "or") or b is None:
        raise FilterError(f"can't combine by {op!r}")
    return Logic(op, (a, b))


# --- compilation -----------------------------------------------------------------------------------------------------------------------

_EPOCH = datetime(1970, 1, 1)
_UNIT = {"s": 1_000_000, "ms": 1_000, "us": 1}


def _literal(value: object, kind: T.DataType, column: str, unit: str) -> Column:
    if isinstance(kind, T.StringType):
        if not isinstance(value, str):
            raise FilterError(f"column {column!r} holds strings, not {value!r}")
        return F.lit(value)
    if isinstance(kind, T.BinaryType):
        if not isinstance(value, str | bytes):
            raise FilterError(f"column {column!r} holds bytes, not {value!r}")
        return F.lit(value.encode() if isinstance(value, str) else value)
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool | int) or value not in (0, 1):
            raise FilterError(f"column {column!r} is boolean, not {value!r}")
        return F.lit(bool(value))
    if isinstance(kind, T.TimestampNTZType | T.TimestampType):
        if isinstance(value, datetime):
            moment = value
        elif isinstance(value, int) and not isinstance(value, bool):
            moment = _EPOCH + timedelta(microseconds=value * _UNIT[unit])
        else:
            raise FilterError(f"column {column!r} holds times: give an integer since the epoch in its unit, not {value!r}")
        return F.lit(moment.isoformat(sep=" ")).cast(kind)
    if isinstance(value, str | bytes) or not isinstance(value, int | float):
        raise FilterError(f"column {column!r} is numeric, not {value!r}")
    if isinstance(kind, T.IntegralType):
        # a fraction is compared as such, and a whole number beyond the type's range without overflow
        return F.lit(value) if isinstance(value, float) else F.lit(value).cast("bigint") if -(2**63) <= value < 2**63 else F.lit(float(value))
    return F.lit(value).cast(kind)


def compile_tree(tree: Compare | Logic, schema: T.StructType, units: Mapping[str, str] | None = None) -> Column:
    if isinstance(tree, Logic):
        cols = [compile_tree(p, schema, units) for p in tree.parts]
        out = cols[0]
        for c in cols[1:]:
            out = out & c if tree.op == "and" else out | c
        return out
    if tree.column not in schema.fieldNames():
        raise FilterError(f"no column {tree.column!r}")
    kind, col = schema[tree.column].dataType, F.col(f"`{tree.column}`")
    unit = (units or {}).get(tree.column, "us")
    if tree.op in ("in", "not in"):
        if any(v is None for v in tree.value):
            raise FilterError("a membership list may not hold None")
        hit = col.isin([_literal(v, kind, tree.column, unit) for v in tree.value])
        return hit if tree.op == "in" else ~hit
    if tree.value is None:
        if tree.op not in ("==", "!="):
            raise FilterError("None can only be tested with == and !=")
        return col.isNull() if tree.op == "==" else col.isNotNull()
    lit = _literal(tree.value, kind, tree.column, unit)
    real = isinstance(kind, T.FloatType | T.DoubleType)
    if real and isinstance(tree.value, float) and tree.value != tree.value:
        return col.isNotNull() if tree.op == "!=" else F.lit(False)
    match tree.op:
        case "==":
            return col == lit
        case "!=":
            return col != lit
        case "<":
            return col < lit
        case "<=":
            return col <= lit
        case ">":
            return (col > lit) & ~F.isnan(col) if real else col > lit
        case _:
            return (col >= lit) & ~F.isnan(col) if real else col >= lit


def compile_filter(text: str, schema: T.StructType, syntax: str = "python", units: Mapping[str, str] | None = None) -> tuple[Column, list[str]]:
    """The predicate as a Column, and the columns it names."""
    tree = parse(text) if syntax == "python" else parse_r(text)
    return compile_tree(tree, schema, units), columns_of(tree)
