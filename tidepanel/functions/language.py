"""The factor language: formulas such as Mean($close, 5) / $close - 1 as trees, parsed without eval."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass


#: What the names of point-in-time fields begin with.
PIT = "_pit_"


@dataclass(frozen=True)
class Node:
    """A term: an operator's name and its arguments (nodes, numbers, strings). Equal terms are equal values, planned once."""

    name: str
    args: tuple = ()

    def __str__(self) -> str:
        if self.name == "field":
            return f"${self.args[0]}"
        return f"{self.name}({', '.join(map(str, self.args))})"

    @property
    def children(self) -> tuple[Node, ...]:
        return tuple(a for a in self.args if isinstance(a, Node))


def _binary(name: str, swap: bool = False):
    return lambda self, other: Node(name, (other, self) if swap else (self, other))


for _method, _name in {"add": "Add", "sub": "Sub", "mul": "Mul", "truediv": "Div", "pow": "Power", "mod": "Mod", "and": "And", "or": "Or"}.items():
    setattr(Node, f"__{_method}__", _binary(_name))
    setattr(Node, f"__r{_method}__", _binary(_name, True))
for _method, _name in {"gt": "Gt", "ge": "Ge", "lt": "Lt", "le": "Le"}.items():
    setattr(Node, f"__{_method}__", _binary(_name))
Node.__neg__ = lambda self: Node("Neg", (self,))
Node.__invert__ = lambda self: Node("Not", (self,))


def field(name: str) -> Node:
    return Node("field", (name,))


_OPERATORS = {
    ast.Add: "Add", ast.Sub: "Sub", ast.Mult: "Mul", ast.Div: "Div", ast.Pow: "Power", ast.Mod: "Mod", ast.BitAnd: "And", ast.BitOr: "Or",
    ast.Gt: "Gt", ast.GtE: "Ge", ast.Lt: "Lt", ast.LtE: "Le", ast.Eq: "Eq", ast.NotEq: "Ne", ast.USub: "Neg", ast.Invert: "Not",
}


def parse(formula: str, names: set[str] | None = None) -> Node:
    """The tree of a formula. $x is a field, $$x a point-in-time field. Only calls of known names, numbers, strings and operators are read."""
    text = re.sub(r"\$\$(\w+)", rf"__field__('{PIT}\1')", formula)
    text = re.sub(r"\$(\w+)", r"__field__('\1')", text)

    def walk(e: ast.AST):
        match e:
            case ast.Expression(body=b):
                return walk(b)
            case ast.Constant(value=v) if isinstance(v, (int, float, str)):
                return v
            case ast.Call(func=ast.Name(id="__field__"), args=[ast.Constant(value=v)]):
                return field(v)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                if names is not None and name not in names:
                    raise ValueError(f"unknown operator {name} in {formula}")
                return Node(name, tuple(map(walk, args)))
            case ast.UnaryOp(op=op, operand=x) if type(op) in _OPERATORS:
                x = walk(x)
                return -x if isinstance(op, ast.USub) and not isinstance(x, Node) else Node(_OPERATORS[type(op)], (x,))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _OPERATORS:
                return Node(_OPERATORS[type(op)], (walk(a), walk(b)))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _OPERATORS:
                return Node(_OPERATORS[type(op)], (walk(a), walk(b)))
        raise ValueError(f"not a formula: {formula}")

    return walk(ast.parse(text, mode="eval"))
