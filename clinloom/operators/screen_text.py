"""Screening rules as text: any(Hb > 10) & mean(Na, na.rm = TRUE) < 140 | all(icd == "I10")."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame

from clinloom.operators.screening import Agg, Both, Either, Rule, Term, all_, any_, row_, sql_

_COMPARE = {ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.Eq: "=", ast.NotEq: "<>"}
_ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}
_AGGREGATES = ("mean", "sum", "min", "max")
_STRING = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"


def _words(text: str) -> str:
    """The text with words for the logical signs, which then bind weaker than comparisons."""
    signs = {"&&": " and ", "&": " and ", "||": " or ", "|": " or ", "!": " not ", "TRUE": "True", "FALSE": "False", "na.rm": "na_rm", "is.na": "is_na", "%in%": " in "}

    def put(m: re.Match) -> str:
        return signs.get(m.group(), m.group())

    return re.sub(rf"{_STRING}|!=|&&?|\|\|?|!|\bTRUE\b|\bFALSE\b|\bna\.rm\b|\bis\.na\b|%in%", put, text)


def _names(node: ast.AST) -> set[str]:
    called = {id(n.func) for n in ast.walk(node) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and id(n) not in called}


def to_sql(node: ast.AST) -> str:
    """A predicate, or an expression of aggregates, as Spark SQL."""
    match node:
        case ast.BoolOp(op=op, values=values):
            return "(" + (" AND " if isinstance(op, ast.And) else " OR ").join(map(to_sql, values)) + ")"
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return f"(NOT {to_sql(x)})"
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return f"(-{to_sql(x)})"
        case ast.Compare(left=a, ops=[ast.In()], comparators=[ast.Call(func=ast.Name(id="c"), args=args)]):
            return f"({to_sql(a)} IN ({', '.join(map(to_sql, args))}))"
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
            return f"({to_sql(a)} {_COMPARE[type(op)]} {to_sql(b)})"
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
            return f"({to_sql(a)} {_ARITHMETIC[type(op)]} {to_sql(b)})"
        case ast.Call(func=ast.Name(id="is_na"), args=[x]):
            return f"({to_sql(x)} IS NULL)"
        case ast.Call(func=ast.Name(id="any" | "all" as f), args=[x]):
            return f"{'bool_or' if f == 'any' else 'bool_and'}(coalesce({to_sql(x)}, false))"
        case ast.Call(func=ast.Name(id=f), args=[x]) if f in _AGGREGATES:
            return f"{f}({to_sql(x)})"
        case ast.Name(id=name):
            return f"`{name}`"
        case ast.Constant(value=bool() as v):
            return str(v).lower()
        case ast.Constant(value=str() as v):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        case ast.Constant(value=int() | float() as v):
            return repr(v)
    raise ValueError(f"not understood: {ast.unparse(node)}")


def _number(node: ast.AST) -> float | None:
    try:
        v = ast.literal_eval(node)
    except ValueError:
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


_FLIP = {ast.Gt: ast.Lt, ast.GtE: ast.LtE, ast.Lt: ast.Gt, ast.LtE: ast.GtE, ast.Eq: ast.Eq, ast.NotEq: ast.NotEq}


def _aggregate(table: str, node: ast.AST) -> Term | None:
    """agg(column) compared with a number, on either side."""
    match node:
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
            kind = type(op)
            if _number(b) is None:
                a, b, kind = b, a, _FLIP[kind]
            k = _number(b)
            match a:
                case ast.Call(func=ast.Name(id=f), args=[ast.Name(id=column)], keywords=kw) if f in _AGGREGATES and k is not None:
                    na_rm = any(w.arg == "na_rm" and ast.literal_eval(w.value) for w in kw)
                    agg = Agg(table, f, column, na_rm)
                    return {ast.Gt: agg.__gt__, ast.GtE: agg.__ge__, ast.Lt: agg.__lt__, ast.LtE: agg.__le__, ast.Eq: agg.__eq__, ast.NotEq: agg.__ne__}[kind](k)
    return None


def parse_rule(text: str, tables: dict[str, DataFrame]) -> Rule:
    """A rule from text; each term's columns must all stand in exactly one table."""

    def table_of(node: ast.AST) -> str:
        names = _names(node)
        if not names:
            raise ValueError(f"no column in {ast.unparse(node)}")
        have = [t for t, df in tables.items() if names <= set(df.columns)]
        if len(have) != 1:
            raise ValueError(f"{sorted(names)} stand in {have or 'no table'}")
        return have[0]

    def rule(node: ast.AST) -> Rule:
        if isinstance(node, ast.BoolOp):
            out = rule(node.values[0])
            for v in node.values[1:]:
                out = Both(out, rule(v)) if isinstance(node.op, ast.And) else Either(out, rule(v))
            return out
        t = table_of(node)
        match node:
            case ast.Call(func=ast.Name(id="any"), args=[x]):
                return any_(t, to_sql(x))
            case ast.Call(func=ast.Name(id="all"), args=[x]):
                return all_(t, to_sql(x))
        if (found := _aggregate(t, node)) is not None:
            return found
        calls = any(isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("any", "all", *_AGGREGATES) for n in ast.walk(node))
        return sql_(t, to_sql(node)) if calls else row_(t, to_sql(node))

    try:
        tree = ast.parse(_words(text).strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not a rule: {text}") from e
    return rule(tree)
