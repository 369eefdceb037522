"""A restricted expression language, compiled to columns.

Null means unresolved: unknown names, division by zero and arguments outside a function's domain give null, never an
error.  and/or go from left to right, so an unresolved left operand leaves the whole unresolved.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnsupportedExpression(ValueError):
    """The text is outside the language."""


# Spellings of C and C++ that mean a function of the language.
ALIASES = {"fabs": "abs", "fabsf": "abs", "fmax": "max", "fmaxf": "max", "fmin": "min", "fminf": "min", "sqrtf": "sqrt", "sinf": "sin", "cosf": "cos", "atan2f": "atan2", "isfinite": "isfinite", "PX4_ISFINITE": "isfinite"}
CONSTANTS = {"FLT_EPSILON": 1.1920928955078125e-07, "M_PI": math.pi, "M_PI_F": math.pi, "M_TWOPI": 2 * math.pi, "M_PI_2": math.pi / 2, "NAN": float("nan")}


def function_name(name: str) -> str:
    """Without namespace, in one spelling."""
    bare = re.sub(r"^(std|math|matrix)(::|\.)", "", name.strip())
    return ALIASES.get(bare, bare)


def _number(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _domain(ok: Callable, f: Callable) -> Callable:
    return lambda x: F.when(ok(x), f(x))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "min": lambda *x: x[0] if len(x) == 1 else F.when(_known(*x), F.least(*x)),
    "max": lambda *x: x[0] if len(x) == 1 else F.when(_known(*x), F.greatest(*x)),
    "sqrt": _domain(lambda x: x >= 0, F.sqrt),
    "log": _domain(lambda x: x > 0, F.ln),
    "exp": F.exp,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": _domain(lambda x: F.abs(x) <= 1, F.asin),
    "acos": _domain(lambda x: F.abs(x) <= 1, F.acos),
    "atan": F.atan,
    "atan2": F.atan2,
    "floor": F.floor,
    "ceil": F.ceil,
    "pow": lambda x, y: _number(F.pow(x, y)),
    "radians": F.radians,
    "degrees": F.degrees,
    "constrain": lambda x, lo, hi: F.when(_known(x, lo, hi), F.least(F.greatest(x, lo), hi)),
}


def _known(*columns: Column) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


def lower_source(text: str) -> str:
    """C++ operators, literals and ternaries as the language has them."""
    s = re.sub(r"&&", " and ", text)
    s = re.sub(r"\|\|", " or ", s)
    s = re.sub(r"!(?!=)", " not ", s)
    s = re.sub(r"\btrue\b", "True", s)
    s = re.sub(r"\bfalse\b", "False", s)
    s = re.sub(r"(\d+\.\d*|\.\d+|\d+)[fF]\b", lambda m: m[1] + ("0" if m[1].endswith(".") else ""), s)
    s = re.sub(r"(\d)[uU]?[lL]{0,2}\b(?<=[uUlL])", r"\1", s)
    s = re.sub(r"\b(std|math|matrix)::", "", s)
    return _ternary(s.strip())


def split_top(text: str, mark: str) -> list[str]:
    """Cut at a mark outside all brackets."""
    out, depth, at = [], 0, 0
    i = 0
    while i < len(text):
        depth += (text[i] in "([{") - (text[i] in ")]}")
        if depth == 0 and text.startswith(mark, i):
            out.append(text[at:i].strip())
            i += len(mark)
            at = i
            continue
        i += 1
    return [*out, text[at:].strip()]


def _ternary(s: str) -> str:
    test, *rest = split_top(s, "?")
    if not rest:
        return s
    tail = "?".join(rest)
    yes, *no = split_top(tail, ":")
    if not no:
        raise UnsupportedExpression(f"open ternary: {s}")
    return f"(({_ternary(yes)}) if ({test}) else ({_ternary(':'.join(no))}))"


def with_aliases(text: str, names: list[str]) -> tuple[str, dict[str, str]]:
    """Dotted names as plain ones, the longest first and whole names only; and what each stands for."""
    table = {}
    for i, name in enumerate(sorted(set(names), key=lambda n: (-len(n), n))):
        alias = f"v{i}_"
        new = re.sub(rf"(?<![\w.\]]){re.escape(name)}(?![\w.\[(])", alias, text)
        if new != text:
            table[alias], text = name, new
    return text, table


def parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise UnsupportedExpression(f"no expression: {text}") from e


def names_of(text: str) -> list[str]:
    """Free names in the order in which they occur."""
    found = [n for n in ast.walk(parse(text)) if isinstance(n, ast.Name)]
    calls = {n.func.id for n in ast.walk(parse(text)) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return list(dict.fromkeys(n.id for n in sorted(found, key=lambda n: (n.lineno, n.col_offset)) if n.id not in calls))


class Compiler:
    """Expressions over an environment of columns and plain numbers; numbers become literals, so that Catalyst folds them."""

    def __init__(self, env: Mapping[str, Column | float | int | bool], bool_as_number: bool = False, tolerance: float | None = None):
        self.env, self.bool_as_number, self.tolerance = env, bool_as_number, tolerance

    def __call__(self, text: str) -> Column:
        return self._go(parse(text))[0]

    def _num(self, node: ast.expr) -> Column:
        c, is_bool = self._go(node)
        if is_bool and not self.bool_as_number:
            return F.lit(None).cast("double")
        return _number(c.cast("int") if is_bool else c)

    def _bool(self, node: ast.expr) -> Column:
        c, is_bool = self._go(node)
        return c if is_bool else _number(c) != 0

    def _int(self, node: ast.expr) -> Column:
        x = self._num(node)
        return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")

    def _go(self, node: ast.expr) -> tuple[Column, bool]:
        """The column, and whether it is a truth value."""
        match node:
            case ast.Constant(value=bool() as v):
                return F.lit(v), True
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v)), False
            case ast.Name(id=name):
                if name not in self.env:
                    if name in CONSTANTS:
                        return F.lit(CONSTANTS[name]), False
                    return F.lit(None).cast("double"), False
                v = self.env[name]
                return (v, False) if isinstance(v, Column) else (F.lit(v if isinstance(v, bool) else float(v)), isinstance(v, bool))
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return self._num(x), False
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self._num(x), False
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~self._bool(x), True
            case ast.UnaryOp(op=ast.Invert(), operand=x):
                return F.bitwise_not(self._int(x)).cast("double"), False
            case ast.BoolOp(op=op, values=values):
                out = self._bool(values[-1])
                for v in reversed(values[:-1]):
                    left = self._bool(v)
                    decided = ~left if isinstance(op, ast.And) else left
                    out = F.when(left.isNull(), F.lit(None).cast("boolean")).when(decided, F.lit(isinstance(op, ast.Or))).otherwise(out)
                return out, True
            case ast.IfExp(test=t, body=a, orelse=b):
                (x, xb), (y, yb), test = self._go(a), self._go(b), self._bool(t)
                if xb != yb:
                    x, y, xb = (x.cast("int") if xb else x).cast("double"), (y.cast("int") if yb else y).cast("double"), False
                return F.when(test.isNull(), F.lit(None)).when(test, x).otherwise(y), xb
            case ast.BinOp(left=a, op=op, right=b):
                return self._binary(op, a, b), False
            case ast.Compare(left=a, ops=ops, comparators=cs):
                return self._chain(a, ops, cs), True
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if args:
                f = function_name(name)
                if f == "isfinite":
                    return self._num(args[0]).isNotNull(), True
                if f not in FUNCTIONS:
                    raise UnsupportedExpression(f"unknown function {name}")
                try:
                    return FUNCTIONS[f](*map(self._num, args)).cast("double"), False
                except TypeError as e:
                    raise UnsupportedExpression(f"arguments of {name}") from e
        raise UnsupportedExpression(f"unsupported syntax: {ast.dump(node)[:80]}")

    def _binary(self, op: ast.operator, a: ast.expr, b: ast.expr) -> Column:
        if isinstance(op, (ast.BitAnd, ast.BitOr, ast.BitXor, ast.LShift, ast.RShift)):
            x, y = self._int(a), self._int(b)
            if isinstance(op, (ast.LShift, ast.RShift)):
                n = y.cast("int")
                out = F.when(n.between(0, 62), F.call_function("shiftleft" if isinstance(op, ast.LShift) else "shiftright", x, n))
            else:
                out = {ast.BitAnd: x.bitwiseAND, ast.BitOr: x.bitwiseOR, ast.BitXor: x.bitwiseXOR}[type(op)](y)
            return out.cast("double")
        x, y = self._num(a), self._num(b)
        match op:
            case ast.Add():
                return x + y
            case ast.Sub():
                return x - y
            case ast.Mult():
                return x * y
            case ast.Div():
                return F.try_divide(x, y)
            case ast.Mod():  # of the divisor's sign
                return x - y * F.floor(F.try_divide(x, y))
        raise UnsupportedExpression(f"unsupported operator {type(op).__name__}")

    def _chain(self, a: ast.expr, ops: list[ast.cmpop], cs: list[ast.expr]) -> Column:
        names = {ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}
        out, left = None, a
        for op, right in zip(ops, cs, strict=True):
            if type(op) not in names:
                raise UnsupportedExpression(f"unsupported comparison {type(op).__name__}")
            (x, xb), (y, yb) = self._go(left), self._go(right)
            if xb and yb and type(op) in (ast.Eq, ast.NotEq):
                one = x == y if isinstance(op, ast.Eq) else x != y
            else:
                x, y = self._num(left) if not xb or self.bool_as_number else x.cast("int").cast("double"), self._num(right) if not yb or self.bool_as_number else y.cast("int").cast("double")
                name = names[type(op)]
                near = F.abs(x - y) <= self.tolerance if self.tolerance is not None and name in ("==", "!=") else x == y
                one = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y, "==": near, "!=": ~near}[name]
            out = one if out is None else F.when(out.isNull(), F.lit(None).cast("boolean")).when(~out, F.lit(False)).otherwise(one)
            left = right
        return out


def compile_expression(text: str, env: Mapping[str, Column | float | int | bool], **options) -> Column:
    """An expression of the language or of C++ as a column; dotted names of the environment may occur in it."""
    text, table = with_aliases(lower_source(text), [n for n in env if not n.isidentifier()])
    return Compiler({table.get(k, k): v for k, v in env.items()} | {a: env[n] for a, n in table.items()}, **options)(text)


def fold(text: str) -> float | None:
    """The value of a constant expression; None for any other."""
    try:
        return _fold(parse(lower_source(text)))
    except (UnsupportedExpression, ZeroDivisionError, ValueError, OverflowError):
        return None


def _fold(n: ast.expr) -> float | None:
    match n:
        case ast.Constant(value=bool() | int() | float() as v):
            return v
        case ast.Name(id=name) if name in CONSTANTS:
            return CONSTANTS[name]
        case ast.UnaryOp(op=op, operand=x):
            v = _fold(x)
            return None if v is None else -v if isinstance(op, ast.USub) else v if isinstance(op, ast.UAdd) else not v if isinstance(op, ast.Not) else ~int(v)
        case ast.BinOp(left=a, op=op, right=b):
            x, y = _fold(a), _fold(b)
            if x is None or y is None:
                return None
            table = {ast.Add: lambda: x + y, ast.Sub: lambda: x - y, ast.Mult: lambda: x * y, ast.Div: lambda: x / y, ast.Mod: lambda: x % y, ast.LShift: lambda: int(x) << int(y), ast.RShift: lambda: int(x) >> int(y), ast.BitAnd: lambda: int(x) & int(y), ast.BitOr: lambda: int(x) | int(y), ast.BitXor: lambda: int(x) ^ int(y)}
            return table[type(op)]() if type(op) in table else None
    return None


def conjuncts(predicate: str) -> list[str] | None:
    """The parts of a conjunction; None if a disjunction makes it opaque, which keeps plans from growing with every alternative."""
    return None if len(split_top(predicate, "||")) > 1 else split_top(predicate, "&&")


def substitute(text: str, helpers: Mapping[str, tuple[list[str], str]], passes: int = 5) -> str:
    """Calls of helpers as their expressions, arguments put in; a bounded number of times, so that recursion ends."""
    for _ in range(passes):
        new = text
        for name, (params, body) in helpers.items():
            at = re.search(rf"\b{re.escape(name)}\s*\(", new)
            if not at:
                continue
            depth, end = 1, at.end()
            while end < len(new) and depth:
                depth += (new[end] == "(") - (new[end] == ")")
                end += 1
            args = [a for a in split_top(new[at.end() : end - 1], ",") if a]
            if depth or len(args) != len(params):
                continue
            inner = re.sub(r"[A-Za-z_]\w*", lambda m: f"({args[params.index(m[0])]})" if m[0] in params else m[0], body)  # noqa: B023
            new = f"{new[: at.start()]}({inner}){new[end:]}"
        if new == text:
            break
        text = new
    return text


def branches_to_ternary(branches: list[tuple[str, str]], fallback: str) -> str:
    """(condition, value) pairs as one nested choice, the first that holds."""
    out = fallback
    for condition, value in reversed(branches):
        out = f"(({value}) if ({condition}) else ({out}))"
    return out


COMPARED = {ast.GtE: ">=", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!=", ast.Gt: ">", ast.Lt: "<"}


# Types that a cast may name.
CASTS = ["bool", "char", "int", "unsigned", "long", "float", "double", "size_t", "int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t"]


def without_casts(text: str) -> str:
    """Casts in either style taken away, members of pointers as those of objects."""
    kind = rf"(?:const\s+)?(?:{'|'.join(CASTS)})\b\s*"
    return re.sub(rf"\(\s*{kind}\)|static_cast\s*<\s*{kind}>", "", text).replace("->", ".")


def comparison_of(predicate: str, parameter: str) -> tuple[str | None, str | None]:
    """(operator, literal) of the predicate's first comparison whose left side names the parameter or reads one (`get()`).

    The right side is a number, true or false, or a name; (None, None) if there is no such comparison.
    """
    predicate = without_casts(predicate)
    try:
        tree = parse(lower_source(predicate.replace("::", ".")))
    except UnsupportedExpression:
        parts = [p.strip(" ()") for mark in ("&&", "||") for p in split_top(predicate, mark)]
        found = (comparison_of(p, parameter) for p in parts if len(p) < len(predicate))
        return next((f for f in found if f[0]), (None, None))
    compared = [n for n in ast.walk(tree) if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in COMPARED]
    for node in sorted(compared, key=lambda n: (n.lineno, n.col_offset)):
        left, right = ast.unparse(node.left), _literal(node.comparators[0])
        if right is not None and (".get()" in left or parameter in re.findall(r"\w+", left)):
            return COMPARED[type(node.ops[0])], right
    return None, None


def _literal(node: ast.expr) -> str | None:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        inner = _literal(node.operand)
        return None if inner is None else f"-{inner}"
    if isinstance(node, ast.Constant) and isinstance(node.value, bool | int | float):
        return str(node.value).lower()
    return ast.unparse(node).replace(".", "::") if isinstance(node, ast.Name | ast.Attribute) else None
