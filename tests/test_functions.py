"""Expressions and the formula language against facts that can be computed by hand."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orrery.functions import dsl, exprs
from orrery.functions.constants import PHI, PHI_INV
from orrery.plans import registries


def one(spark, column, schema="x double", values=((0.0,),)):
    return [r[0] for r in spark.createDataFrame([tuple(v) for v in values], schema).select(column).collect()]


def test_nearest_fibonacci(spark):
    n = [1, 4, 11, 17, 44, 60, 72, 500]
    frame = spark.createDataFrame([(x,) for x in n], "n long")
    rows = frame.select("n", exprs.nearest_fibonacci("n"), exprs.fibonacci_distance("n")).collect()
    want = {1: (1, 0), 4: (3, 0.6180), 11: (13, 1.2361), 17: (13, 2.4721), 44: (34, 6.1803), 60: (55, 3.0902), 72: (55, 10.5066), 500: (377, 76.0182)}
    assert {r[0]: (r[1], round(r[2], 4)) for r in rows} == want


def test_antifragility_and_ladders(spark):
    assert one(spark, exprs.antifragility("x"), values=[(0.0,), (PHI_INV,), (PHI**2,)]) == pytest.approx([PHI_INV, 1, 0], abs=1e-12)
    assert one(spark, exprs.risk_level("x"), values=[(24.9,), (25.0,), (50.0,), (75.0,), (75.1,)]) == ["FAIBLE", "MOYEN", "MOYEN", "ELEVE", "CRITIQUE"]
    assert [s.split()[0] for s in one(spark, exprs.status("x"), values=[(85.0,), (84.99,), (59.9,)])] == ["HERMÉTIQUE", "EN", "DORMANT"]


def test_small_expressions(spark):
    assert one(spark, exprs.zeta_score(F.lit(1))) == [1.0]
    assert one(spark, exprs.zeta_score(F.lit(5))) == pytest.approx([min(1, PHI * sum((i + 1) ** -PHI for i in range(5)) / 5)])
    assert one(spark, exprs.module_name(F.lit("a/b/__init__.py"))) == ["a.b"]
    assert one(spark, exprs.squeezed(F.lit("  a \n b "))) == ["a b"]
    assert one(spark, exprs.bytes_text("x"), "x long", [(10,), (2_500_000,), (3_000_000_000,)]) == ["10 o", "2.5 Mo", "3.00 Go"]
    assert one(spark, exprs.dedup_rate(F.lit(0), F.lit(0))) == [None]
    assert one(spark, exprs.sigmoid("x"), values=[(-1e6,), (0.0,)]) == [0.0, 0.5]


CASES = [("2+3*4", 14), ("2^3^2", 512), ("--3", 3), ("-2^2", 4), ("(1+2)*3", 9), ("log2(8)", 3), ("sqrt(16) - abs(-4)", 0), ("exp(0) + e/e", 2), ("PHI^2 - phi", 1), ("(3 > 2) + (1 == 1)", 2), ("100 - x/phi - y^2", 100 - 1137 / PHI - 0.837**2), ("1e3 + .5", 1000.5)]


@pytest.mark.parametrize(("text", "value"), CASES)
def test_formulas(spark, text, value):
    assert one(spark, dsl.formula(text, ["x", "y"]), "x double, y double", [(1137.0, 0.837)]) == pytest.approx([value])


@pytest.mark.parametrize(("text", "value"), [("not 1 > 2 and 1 < 2", True), ("1 > 2 and 1/0 == 0", False), ("1 < 2 or 1/0 == 0", True), ("x", True), ("x - x", False), ("x >= 2 AND NOT x > 3", True)])
def test_gates_short_circuit_even_in_strict_mode(spark, text, value):
    assert one(spark, dsl.gate(text, ["x"], strict=True), values=[(2.0,)]) == [value]


@pytest.mark.parametrize("text", ["", "1 +", "1 2", "(1", "1 < 2 < 3", "$", "and", "sqrt(1", "1 and"])
def test_syntax_errors(text):
    with pytest.raises(SyntaxError):
        dsl.parse(text)


def test_unknown_names():
    for text in ("nothing + 1", "sin(1)"):
        with pytest.raises(NameError):
            dsl.formula(text, ["x"])


@pytest.mark.parametrize("text", ["1/x", "log(x)", "log2(-1)", "sqrt(-1)", "10^400", "x^-1", "exp(1000)"])
def test_domain_errors(spark, text):
    assert one(spark, dsl.formula(text, ["x"])) == [None]
    with pytest.raises(Exception, match="division|positive|negative|range|overflow"):
        one(spark, dsl.formula(text, ["x"], strict=True))


def test_t_p_value():
    from orrery.operators.perf import t_p_value

    assert t_p_value(0.0, 5) == pytest.approx(1.0)
    assert t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert t_p_value(1.0, 1) == pytest.approx(0.5, abs=1e-9)
    assert t_p_value(-3.0, 4.5) == pytest.approx(t_p_value(3.0, 4.5))
    assert t_p_value(12.0, 30) < 1e-11
    assert math.isclose(t_p_value(0.2, 200), 0.8416849, rel_tol=1e-5)


def test_bytes_beyond_a_long_and_near_ties(spark):
    values = [p**3 * 997 for p in (1, 10, 500, 1500, 209_000, 300_031, 320_500, 1_199_999)]
    want = [f"{b} o" if b < 1e6 else f"{b / 1e6:.1f} Mo" if b < 1e9 else f"{b / 1e9:.2f} Go" for b in values]
    assert one(spark, exprs.bytes_text("x"), "x decimal(38,0)", [(Decimal(b),) for b in values]) == want
    assert one(spark, exprs.bytes_text("x"), "x long", [(None,), (-5,), (1_015_000_000,)]) == [None, "-5 o", f"{1.015:.2f} Go"]


def test_texts_of_numbers_on_keys_of_a_large_table(spark, tmp_path):
    keys = [7, 500, 209_001, 209_911, 320_500, 1_199_999]
    spark.createDataFrame([(p, 3) for p in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.text for r in registries.texts_of_numbers(spark, str(tmp_path)).collect()}
    assert got == {p: f"{b} o" if b < 1e6 else f"{b / 1e6:.1f} Mo" if b < 1e9 else f"{b / 1e9:.2f} Go" for p in keys for b in [p**3 * 997]}
