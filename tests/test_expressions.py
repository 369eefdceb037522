"""The expression language against Python's own evaluation, and its three values."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaneflow.functions import expressions as X


def value(spark, text, **options):
    env = {"a": F.lit(7.0), "b": F.lit(-2.0), "z": F.lit(0.0), "n": F.lit(None).cast("double"), "k": 5.0, "top.f[0]": F.lit(3.0)}
    return spark.range(1).select(X.compile_expression(text, env, **options).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a + b * 2", 3.0), ("a % 3", 1.0), ("b % 3", 1.0), ("a % b", 7.0 % -2.0), ("a / z", None), ("a % z", None), ("sqrt(b)", None), ("log(z)", None), ("asin(a)", None), ("missing + 1", None), ("n > 1", None),
        ("a > 1 && b < 0", True), ("z > 1 && n > 1", False), ("n > 1 && z > 1", None), ("a > 1 || n > 1", True), ("n > 1 || a > 1", None), ("!(a > 1)", False), ("1 < a < 9", True), ("1 < a < 5", False), ("a != b", True),
        ("a > 1 ? b : k", -2.0), ("a < 1 ? b : a < 8 ? 1 : 2", 1.0), ("fmaxf(a, b)", 7.0), ("math::constrain(a, 0, 5)", 5.0), ("std::abs(b)", 2.0), ("6 & 3", 2.0), ("(1 << 4) | 1", 17.0), ("~0", -1.0), ("9 >> 1", 4.0), ("6 ^ 3", 5.0),
        ("top.f[0] + 1.f", 4.0), ("isfinite(a)", True), ("PX4_ISFINITE(n)", False), ("true", True), ("M_PI_F > 3", True), ("max(a, n)", None), ("-a", -7.0),
    ],
)
def test_values(spark, text, want):
    got = value(spark, text)
    assert got == want if not isinstance(want, float) else got == pytest.approx(want)


def test_truth_values_are_numbers_for_one_caller_only(spark):
    assert value(spark, "(a > 1) + 1") is None
    assert value(spark, "(a > 1) + 1", bool_as_number=True) == 2.0


def test_tolerance(spark):
    assert value(spark, "a == 7.05", tolerance=0.1) is True and value(spark, "a != 7.05", tolerance=0.1) is False


@pytest.mark.parametrize("text", ["import os", "a.b()", "[1]", "'x'", "f(1)", "lambda: 1", "a if", "a is b", "pow(1)", "max(1, key=2)"])
def test_anything_else_is_refused(spark, text):
    with pytest.raises(X.UnsupportedExpression):
        value(spark, text)


def test_source_helpers():
    assert X.names_of("max(b, a) + c * b") == ["b", "a", "c"]
    assert X.conjuncts("a && (b && c) && !d") == ["a", "(b && c)", "!d"] and X.conjuncts("a || b") is None
    assert X.fold("(1 << 1) + 3") == 5 and X.fold("a + 1") is None and X.fold("1 / 0") is None
    helpers = {"sq": (["x"], "x * x"), "loop": (["x"], "loop(x)")}
    assert X.fold(X.substitute("sq(2 + 1) + sq(sq(2))", helpers)) == 25
    assert "loop" in X.substitute("loop(1)", helpers)
    text, table = X.with_aliases("s.a + s.ab + t.s.a", ["s.a", "s.ab"])
    assert sorted(table.values()) == ["s.a", "s.ab"] and "t.s.a" in text
    assert X.branches_to_ternary([("p", "1"), ("q", "2")], "3") == "((1) if (p) else (((2) if (q) else (3))))"


NUMBERS = st.integers(-20, 20).map(float)
TREE = st.recursive(NUMBERS.map(repr) | st.sampled_from(["a", "b"]), lambda t: st.tuples(t, st.sampled_from(["+", "-", "*", "/"]), t).map(lambda x: f"({x[0]} {x[1]} {x[2]})"), max_leaves=8)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TREE, min_size=8, max_size=8))
def test_arithmetic_is_pythons(spark, texts):
    def want(t):
        try:
            x = eval(t, {"a": 7.0, "b": -2.0})  # noqa: S307
            return x if math.isfinite(x) else None
        except ZeroDivisionError:
            return None

    row = spark.range(1).select(*(X.compile_expression(t, {"a": F.lit(7.0), "b": F.lit(-2.0)}).alias(f"c{i}") for i, t in enumerate(texts))).first()
    for got, t in zip(row, texts, strict=True):
        w = want(t)
        assert (got is None) == (w is None)
        assert w is None or got == pytest.approx(w, rel=1e-9, abs=1e-9)


def test_comparison_about_a_parameter():
    from vaneflow.functions.expressions import comparison_of

    cases = {
        ("a > 1 && PARAM.get() == 2", "PARAM"): ("==", "2"),
        ("a > 1 && A_B == 2", "A_B"): ("==", "2"),
        ("_param_x.get() >= 1000", "other"): (">=", "1000"),
        ("foo < 3", "A_B"): (None, None),
        ("ns::A_B != MODE::C", "A_B"): ("!=", "MODE::C"),
        ("(x.get() == true) || !y", "Q"): ("==", "true"),
        ("A_B <= -2.5f && C > 3", "A_B"): ("<=", "-2.5"),
        ("", "A_B"): (None, None),
        ("a->b.get() > 3", "A_B"): (">", "3"),
        ("(int)P.get() == 1", "P"): ("==", "1"),
        ("static_cast<int32_t>(A_B) == 1", "A_B"): ("==", "1"),
        ("A_B_C > 1 && A_B < 2", "A_B"): ("<", "2"),
    }
    for (text, name), want in cases.items():
        assert comparison_of(text, name) == want, text
