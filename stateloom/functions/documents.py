"""Canonical JSON, and a small expression grammar compiled to columns."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, no spaces and unescaped Unicode; null for malformed text."""

    @F.pandas_udf("string")
    def sort_keys(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            try:
                return json.dumps(json.loads(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
            except (TypeError, ValueError):
                return None

        return values.map(one)

    return sort_keys(text)


class _Value:
    """A compiled part: a double column, and the test of its truth."""

    def __init__(self, number: Column, truth: Column | None = None):
        self.number = number
        self.truth = number != 0.0 if truth is None else truth

    @classmethod
    def of_test(cls, test: Column) -> _Value:
        return cls(test.cast("double"), test)


def _finite(number: Column) -> Column:
    """Null for what arithmetic cannot say: infinities and not-a-numbers."""
    return F.when(F.abs(number) < float("inf"), number)


def _floored(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b)).cast("double")


#: What the grammar admits, by the name of its node.
ARITHMETIC = {
    "Add": lambda a, b: a + b,
    "Sub": lambda a, b: a - b,
    "Mult": lambda a, b: a * b,
    "Div": F.try_divide,
    "FloorDiv": _floored,
    "Mod": lambda a, b: a - b * _floored(a, b),
    "Pow": F.pow,
}
ORDER = {"Eq": "__eq__", "NotEq": "__ne__", "Lt": "__lt__", "LtE": "__le__", "Gt": "__gt__", "GtE": "__ge__"}
FUNCTIONS = {
    "sqrt": (1, lambda x: F.when(x >= 0, F.sqrt(x))),
    "int": (1, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")),
    "ceil": (1, lambda x: F.ceil(x).cast("double")),
    "floor": (1, lambda x: F.floor(x).cast("double")),
    "round": (1, lambda x: F.rint(x)),
    "abs": (1, F.abs),
    "min": (2, lambda *x: F.least(*x)),
    "max": (2, lambda *x: F.greatest(*x)),
}


class _Compiler(ast.NodeVisitor):
    """Parts of an expression as columns; a part outside the grammar is an error when it is compiled."""

    def __init__(self, names: dict[str, Column]):
        self.names = names

    def generic_visit(self, node: ast.AST):
        raise ValueError(f"not allowed in an expression: {type(node).__name__}")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node):
        if type(node.value) is bool:
            return _Value.of_test(F.lit(node.value))
        if type(node.value) in (int, float):
            return _Value(F.lit(float(node.value)))
        return self.generic_visit(node)

    def visit_Name(self, node):
        if node.id not in self.names:
            raise ValueError(f"unknown name {node.id}")
        return _Value(self.names[node.id].cast("double"))

    def visit_BinOp(self, node):
        make = ARITHMETIC.get(type(node.op).__name__) or self.generic_visit(node.op)
        return _Value(_finite(make(self.visit(node.left).number, self.visit(node.right).number)))

    def visit_UnaryOp(self, node):
        inner, name = self.visit(node.operand), type(node.op).__name__
        if name == "Not":
            return _Value.of_test(~inner.truth)
        return {"USub": lambda: _Value(-inner.number), "UAdd": lambda: inner}.get(name, lambda: self.generic_visit(node.op))()

    def visit_BoolOp(self, node):
        """The last value looked at, as the language has it."""
        out, *rest = map(self.visit, node.values)
        for value in rest:
            go_on = out.truth if type(node.op).__name__ == "And" else ~out.truth
            out = _Value(F.when(go_on, value.number).when(~go_on, out.number), F.when(go_on, value.truth).when(~go_on, out.truth))
        return out

    def visit_Compare(self, node):
        sides = [self.visit(x).number for x in (node.left, *node.comparators)]
        test = F.lit(True)
        for op, a, b in zip(node.ops, sides, sides[1:]):
            test = test & getattr(a, ORDER.get(type(op).__name__) or self.generic_visit(op))(b)
        return _Value.of_test(test)

    def visit_IfExp(self, node):
        test, yes, no = map(self.visit, (node.test, node.body, node.orelse))
        pick = lambda a, b: F.when(test.truth, a).when(~test.truth, b)
        return _Value(pick(yes.number, no.number), pick(yes.truth, no.truth))

    def visit_Call(self, node):
        least, make = FUNCTIONS.get(getattr(node.func, "id", None)) or self.generic_visit(node)
        if node.keywords or len(node.args) < least or (least == 1 and len(node.args) > 1):
            raise ValueError("wrong number of arguments in an expression")
        values = [self.visit(x).number for x in node.args]
        known = values[0].isNotNull()
        for v in values[1:]:
            known = known & v.isNotNull()
        return _Value(F.when(known, _finite(make(*values))))


def evaluated(expression: str, names: dict[str, Column]) -> Column:
    """The expression over numeric columns as a double, compiled to column functions.

    Arithmetic, comparison, boolean logic, conditions and a few functions; anything else is
    a ValueError here.  Null where it has no finite value: a null name, division by zero, a
    root of a negative number, an overflow.
    """
    try:
        tree = ast.parse(expression, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not an expression: {e.msg}") from None
    return _Compiler(names).visit(tree).number
