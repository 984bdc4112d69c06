"""Unit conversion from a small fixed table, as a broadcast lookup or short CASE branches, never a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.functions import unit_grammar

# Fixed values. canonical name, dimension, factor to the dimension's base, offset, spellings, extra aliases.
# Spellings are read anywhere; aliases only by evidence normalization, not by reference comparison.
UNITS = [
    ("meter", "length", 1e9, 0.0, ["m", "meter", "metre"], []),
    ("centimeter", "length", 1e7, 0.0, ["cm", "centimeter"], []),
    ("millimeter", "length", 1e6, 0.0, ["mm", "millimeter"], []),
    ("micrometer", "length", 1e3, 0.0, ["um", "µm", "μm", "micrometer", "micron"], []),
    ("nanometer", "length", 1.0, 0.0, ["nm", "nanometer"], []),
    ("picometer", "length", 1e-3, 0.0, ["pm", "picometer"], []),
    ("angstrom", "length", 0.1, 0.0, ["angstrom", "Å"], []),
    ("second", "time", 1.0, 0.0, ["s", "sec", "second", "seconds"], []),
    ("minute", "time", 60.0, 0.0, ["min", "minute", "minutes"], []),
    ("hour", "time", 3600.0, 0.0, ["h", "hr", "hour", "hours"], []),
    ("day", "time", 86400.0, 0.0, ["d", "day", "days"], []),
    ("week", "time", 604800.0, 0.0, ["week", "weeks"], []),
    ("month", "time", 2629800.0, 0.0, ["month", "months"], []),
    ("year", "time", 31557600.0, 0.0, ["year", "years"], []),
    ("volt", "potential", 1e3, 0.0, ["V", "volt"], []),
    ("millivolt", "potential", 1.0, 0.0, ["mV", "millivolt"], []),
    ("kelvin", "temperature", 1.0, 0.0, ["K", "kelvin"], []),
    ("degree_Celsius", "temperature", 1.0, 273.15, ["degC", "°C", "celsius"], ["Celsius"]),
    ("degree_Fahrenheit", "temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0, ["degF", "°F", "fahrenheit"], []),
    ("degree", "angle", 1.0, 0.0, ["deg", "degree", "degrees"], ["°"]),
    ("radian", "angle", 57.29577951308232, 0.0, ["rad", "radian"], []),
    ("millimole / liter", "concentration", 1.0, 0.0, ["mM", "mmol/L", "mmol/l", "mmol/liter", "millimole/liter"], []),
    ("mole / liter", "concentration", 1e3, 0.0, ["M", "mol/L", "mol/l", "mole/liter"], []),
    ("micromole / liter", "concentration", 1e-3, 0.0, ["uM", "µM", "μM", "umol/L"], []),
    ("percent", "ratio", 0.01, 0.0, ["%", "percent"],
     ["wt%", "vol%", "wt.%", "vol.%", "wt %", "vol %"]),
    ("dimensionless", "ratio", 1.0, 0.0, ["dimensionless"], []),
    ("millimole / gram", "charge density", 1.0, 0.0, ["mmol/g", "millimole/gram"], []),
    ("mole / kilogram", "charge density", 1.0, 0.0, ["mol/kg"], []),
    ("millijoule / meter ** 2", "surface energy", 1.0, 0.0,
     ["mJ/m**2", "mJ/meter**2", "millijoule/meter**2", "mN/m"], ["mJ/m2"]),
    ("joule / meter ** 2", "surface energy", 1e3, 0.0, ["J/m**2", "J/meter**2"], []),
    ("elementary_charge / nanometer ** 2", "areal charge", 1.0, 0.0, ["e/nm**2"], ["e/nm2"]),
    ("gram", "mass", 1.0, 0.0, ["g", "gram"], []),
    ("milligram", "mass", 1e-3, 0.0, ["mg", "milligram"], []),
    ("kilogram", "mass", 1e3, 0.0, ["kg", "kilogram"], []),
    ("liter", "volume", 1.0, 0.0, ["L", "l", "liter"], []),
    ("milliliter", "volume", 1e-3, 0.0, ["mL", "ml", "milliliter"], []),
    ("pascal", "pressure", 1.0, 0.0, ["Pa", "pascal"], []),
    ("kilopascal", "pressure", 1e3, 0.0, ["kPa", "kilopascal"], []),
]
# Decimal prefixes, and the units of the table that take them.
PREFIXES = [("kilo", ["k"], 1e3), ("deci", ["d"], 1e-1), ("centi", ["c"], 1e-2), ("milli", ["m"], 1e-3), ("micro", ["u", "µ", "μ"], 1e-6), ("nano", ["n"], 1e-9), ("pico", ["p"], 1e-12)]
PREFIXED = {"meter": ["m"], "second": ["s"], "volt": ["V"], "gram": ["g"], "liter": ["L", "l"], "mole / liter": ["M", "mol/L", "mol/l"], "pascal": ["Pa"], "radian": ["rad"]}


def _with_prefixes(rows: list[tuple]) -> list[tuple]:
    """The table and every prefixed unit that it does not list, such as kilometre or nanomole per litre."""
    names, taken = {r[0] for r in rows}, {s for r in rows for s in r[4] + r[5]}
    more = []
    for name, dimension, factor, offset, *_ in rows:
        for word, signs, scale in PREFIXES if name in PREFIXED else []:
            spellings = [x + s for x in signs for s in PREFIXED[name]] + [word + name] * (" " not in name)
            fresh = [x for x in spellings if x not in taken]
            if word + name not in names and fresh:
                more.append((word + name, dimension, factor * scale, offset, fresh, []))
                taken.update(fresh)
    return rows + more


UNITS = _with_prefixes(UNITS)
# The unit each named outcome is reported in after normalization.
OUTCOME_TARGETS = {
    "Droplet_Size_um": "um", "Particle_L_nm": "nm", "Particle_w_nm": "nm",
    "Stability_Days": "day", "Storage_Time": "day", "Zeta_Potential_mV": "mV",
    "Electrolyte_Concentration_mM": "mM", "Contact_Angle_deg": "deg",
    "Surface_Charge_Density_mmol_g": "mmol/g", "Surface_Energy_mJ_m2": "mJ/m**2",
    "Temperature": "degC",
}
# Words that name a mass or a volume basis.
MASS_BASIS = ["mass", "mass/mass", "w/w", "wt", "weight"]
VOLUME_BASIS = ["volume", "volume/volume", "v/v", "vol"]


BY_NAME = {row[0]: row for row in UNITS}


def _spellings(row: tuple, aliases: bool) -> list[str]:
    return row[4] + (row[5] if aliases else [])


def _clean(unit: Column) -> Column:
    trimmed = F.translate(F.trim(unit), "−", "-")
    return F.replace(F.replace(trimmed, F.lit("²"), F.lit("**2")), F.lit("³"), F.lit("**3"))


def lookup(unit: str, aliases: bool = True) -> tuple | None:
    """The table row of a unit named by the caller (a plan-time constant)."""
    return next((row for row in UNITS if unit in _spellings(row, aliases) or unit == row[0]), None)


def unit_name(unit: Column, aliases: bool = True) -> Column:
    """Canonical name of a unit column, or null for a unit the table does not know."""
    clean = _clean(unit)
    out = F.when(clean.isin(*_spellings(UNITS[0], aliases)), UNITS[0][0])
    for row in UNITS[1:]:
        out = out.when(clean.isin(*_spellings(row, aliases)), row[0])
    return out


def known(unit: Column, aliases: bool = True) -> Column:
    return _clean(unit).isin(*[s for row in UNITS for s in _spellings(row, aliases)])


def convert(value: Column, unit: Column, target: str, aliases: bool = True) -> Column:
    """Value in the target unit, or null if the unit is unknown or of another dimension.

    The target is known when the plan is built, so only the few units of its dimension appear.
    """
    goal = lookup(target, aliases)
    if goal is None:
        return F.lit(None).cast("double")
    clean, out = _clean(unit), None
    for name, dimension, factor, offset, *_ in UNITS:
        if dimension != goal[1]:
            continue
        if name == goal[0]:
            moved = value
        elif offset == 0.0 and goal[3] == 0.0:
            moved = value / F.lit(goal[2] / factor) if goal[2] >= factor else value * F.lit(factor / goal[2])
        else:
            moved = (value * F.lit(factor) + F.lit(offset - goal[3])) / F.lit(goal[2])
        hit = clean.isin(*_spellings(BY_NAME[name], aliases))
        out = F.when(hit, moved) if out is None else out.when(hit, moved)
    return out


def convert_spread(value: Column, spread: Column, unit: Column, target: str) -> Column:
    """A standard deviation in the target unit; offsets of temperature scales cancel."""
    return F.abs(convert(value + spread, unit, target) - convert(value, unit, target))


def same_length_unit(first: Column, second: Column) -> Column:
    a, b = unit_name(first), unit_name(second)
    return F.coalesce((a == b) & a.isin(*[row[0] for row in UNITS if row[1] == "length"]), F.lit(False))


def _contains_any(c: Column, words: list[str]) -> Column:
    hit = F.contains(c, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(c, F.lit(word))
    return hit


def conversion_rows(targets: dict[str, str], aliases: bool = True) -> list[tuple]:
    """(goal, spelling, multiply, divide, shift, unit) for every spelling that reaches a goal's unit.

    Goal ``''`` stands for "keep the unit": the value passes through under its canonical name.
    """
    rows = []
    for name, dimension, factor, offset, *_ in UNITS:
        for spelling in _spellings(BY_NAME[name], aliases):
            rows.append(("", spelling, 1.0, 1.0, 0.0, name))
            for goal, target in targets.items():
                to = lookup(target)
                if to[1] != dimension:
                    continue
                if to[0] == name:
                    rows.append((goal, spelling, 1.0, 1.0, 0.0, name))
                elif to[2] >= factor:
                    rows.append((goal, spelling, 1.0, to[2] / factor, (offset - to[3]) / factor, to[0]))
                else:
                    rows.append((goal, spelling, factor / to[2], 1.0, (offset - to[3]) / factor, to[0]))
    return rows


def _compound(goal: Column, found: Column, targets: dict[str, str]) -> Column:
    """Struct (mul, unit) for the parsed expression of a unit the table does not list: its own name without a goal, else the goal's unit if the dimensions agree."""
    ends = {}
    for outcome, target in targets.items():
        end = unit_grammar.plain_expression(target)
        if end:
            ends.setdefault((tuple(end[0]), end[1], lookup(target)[0]), []).append(outcome)

    own = F.when(found["name"].isNotNull(), F.struct(F.lit(1.0).alias("mul"), found["name"].alias("unit")))
    out = F.when(~F.coalesce(goal.isin(*targets), F.lit(False)), own)
    for (dims, factor, name), outcomes in ends.items():
        same = goal.isin(*outcomes) & (found["dims"] == F.array(*[F.lit(d) for d in dims]))
        out = out.when(same, F.struct((found["factor"] / factor).alias("mul"), F.lit(name).alias("unit")))
    return out


def attach_conversion(df: DataFrame, goal: Column, unit: Column, targets: dict[str, str], aliases: bool = True) -> DataFrame:
    """Add __mul, __div, __shift, __unit from the fixed conversion table (a few hundred rows, broadcast).

    Only a unit that the table does not list is read as an expression, in the same row: no shuffle.
    """
    schema = "__goal string, __spelling string, __mul double, __div double, __shift double, __unit string"
    table = df.sparkSession.createDataFrame(conversion_rows(targets, aliases), schema)
    keyed = F.when(goal.isin(*targets), goal).otherwise(F.lit(""))
    listed = df.join(F.broadcast(table), (keyed == F.col("__goal")) & (_clean(unit) == F.col("__spelling")), "left").drop("__goal", "__spelling")
    open_unit = F.col("__unit").isNull() & (F.coalesce(unit, F.lit("")) != "") & ~known(F.coalesce(unit, F.lit("")))
    parsed = listed.withColumn("__parsed", unit_grammar.expression(F.when(open_unit, unit)))
    # one row each; as a generated column it is not copied into every later condition that asks for the unit
    read = parsed.select("*", F.explode_outer(F.when(open_unit, F.array(_compound(goal, F.col("__parsed"), targets)))).alias("__read"))
    return read.select(*df.columns, F.coalesce("__mul", "__read.mul").alias("__mul"), F.when(F.col("__read").isNotNull(), 1.0).otherwise(F.col("__div")).alias("__div"),
                       F.when(F.col("__read").isNotNull(), 0.0).otherwise(F.col("__shift")).alias("__shift"), F.coalesce("__unit", "__read.unit").alias("__unit"))


def converted(value: Column) -> Column:
    """Value through the columns of ``attach_conversion``; null where the unit did not match."""
    return (value + F.col("__shift")) * F.col("__mul") / F.col("__div")


def basis_problem(outcome: Column, value: Column, unit: Column, basis: Column) -> Column:
    """Why a percentage may not be normalized: ``none stated`` or ``contradicted``; null when it may."""
    amount = _contains_any(F.lower(outcome), ["concentration", "content", "fraction"])
    percentage = _contains_any(unit, ["%", "percent"])
    stated, low = F.lower(F.when(basis != "", basis)), F.lower(unit)
    clash = ((F.contains(low, F.lit("wt")) & ~stated.isin(*MASS_BASIS))
             | (F.contains(low, F.lit("vol")) & ~stated.isin(*VOLUME_BASIS)))
    relevant = value.isNotNull() & (unit != "") & amount & percentage
    return F.when(relevant, F.when(stated.isNull(), "none stated").when(clash, "contradicted"))
