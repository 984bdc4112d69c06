"""Compound units against factors worked out by hand."""

import pytest
from pyspark.sql import functions as F

from evloom.functions import unit_grammar, units

CASES = [("mg/mL", [-3, 1, 0, 0, 0, 0], 1.0, "milligram / milliliter"), ("m s^-1", [1, 0, -1, 0, 0, 0], 1.0, "meter / second"),
         ("kg·m/s²", [1, 1, -2, 0, 0, 0], 1.0, "kilogram * meter / second ** 2"), ("kg * m * s⁻²", [1, 1, -2, 0, 0, 0], 1.0, "kilogram * meter / second ** 2"),
         ("m*m", [2, 0, 0, 0, 0, 0], 1.0, "meter ** 2"), ("m/m", [0, 0, 0, 0, 0, 0], 1.0, "dimensionless"), ("1/s", [0, 0, -1, 0, 0, 0], 1.0, "1 / second"),
         ("J / mol / K", [2, 1, -2, 0, -1, -1], 1.0, "joule / kelvin / mole"), ("mN/m", [0, 1, -2, 0, 0, 0], 1e-3, "millinewton / meter"),
         ("e/nm**2", [-2, 0, 1, 1, 0, 0], 0.1602176634, "elementary_charge / nanometer ** 2"), ("min^-1", [0, 0, -1, 0, 0, 0], 1 / 60, "1 / minute"),
         ("V/m", [1, 1, -3, -1, 0, 0], 1.0, "volt / meter")]
UNKNOWN = ["furlong", "mg/(mL s)", "m^", "", " ", "m^1.5", "7 m", "/", "m//s", "degC/m", None, "mg/mL extra!"]


def test_expressions(spark):
    frame = spark.createDataFrame([(u,) for u, *_ in CASES] + [(u,) for u in UNKNOWN], "unit string")
    got = {r["unit"]: r["x"] for r in frame.select("unit", unit_grammar.expression(F.col("unit")).alias("x")).collect()}
    for unit, dims, factor, name in CASES:
        assert got[unit]["dims"] == dims and got[unit]["factor"] == pytest.approx(factor, rel=1e-12) and got[unit]["name"] == name, unit
    assert all(got[u] is None for u in UNKNOWN), [u for u in UNKNOWN if got[u] is not None]


def test_targets_have_expressions():
    """Every goal unit but the temperature scale with an offset can be reached by a compound unit."""
    missing = {o for o, t in units.OUTCOME_TARGETS.items() if unit_grammar.plain_expression(t) is None}
    assert missing == {"Temperature"}


def test_listed_units_keep_the_table(spark):
    frame = spark.createDataFrame([("x", "mM"), ("Electrolyte_Concentration_mM", "mol/m^3"), ("Electrolyte_Concentration_mM", "g/L"), ("Temperature", "K"), ("x", "wt%"), ("x", None)],
                                  "outcome string, unit string")
    got = units.attach_conversion(frame, F.col("outcome"), F.col("unit"), units.OUTCOME_TARGETS).collect()
    assert [(r["__unit"], r["__mul"], r["__div"]) for r in got] == [
        ("millimole / liter", 1.0, 1.0), ("millimole / liter", 1.0, 1.0), (None, None, None), ("degree_Celsius", 1.0, 1.0), ("percent", 1.0, 1.0), (None, None, None)]


def test_a_text_is_read_once_per_batch(monkeypatch):
    """Rows are many and units few: the work of reading must not grow with the rows."""
    import pandas as pd
    seen = []
    monkeypatch.setattr(unit_grammar, "_read", lambda t, read=unit_grammar._read: seen.append(t) or read(t))
    got = unit_grammar._parsed.func(pd.Series(["mg/mL", None, "furlong", "m s^-1"] * 1000))
    assert sorted(seen) == ["furlong", "m s^-1", "mg/mL"] and len(got) == 4000
    assert got["name"][:4].tolist() == ["milligram / milliliter", None, None, "meter / second"]
