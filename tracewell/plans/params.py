"""Parameters of any number of instances of each template, as tables that Spark and SQL databases derive alike from the instance's number.

Lists become rows: one for each category, state, month, manufacturer or arm. No list repeats a value, and the arms of an
instance share none, so a row meets one arm of each kind at most. The domains are those of the derived star schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.templates import BANDS, DEPENDANTS, PROFITS

#: Instances of each template; of each, TEST are for testing.
INSTANCES = {12: 1250, 13: 1250, 18: 1250, 20: 1250, 37: 1250, 48: 1250, 82: 1250, 84: 1250, 85: 857, 98: 1250}
TEST = 250

CATEGORIES = "ECONOMY,LARGE,MEDIUM,PROMO,SMALL,STANDARD"
STATES = "CA,OR,WA,NV,AZ,UT,CO,NM,TX"
MARITAL = "M,S,D,W,U"
#: Fixed: the domain of cd_education_status.
EDUCATION = "2 yr Degree,4 yr Degree,Advanced Degree,College,Primary,Secondary,Unknown"
FIRST_DAY, DAYS = "date '1995-01-10'", 2400


def _pick(values: str, at: str) -> str:
    return f"split_part('{values}', ',', cast(({at}) % {values.count(',') + 1} + 1 as int))"


def _of_arm(values, kind: str) -> str:
    """The value of arm j."""
    return f"cast(split_part('{','.join(map(str, values))}', ',', cast(j + 1 as int)) as {kind})"


_START = f"(k * 37 + 11) % {DAYS}"
_YEAR = "cast(1995 + k % 7 as int)"


def _persons(template: int) -> dict[str, str]:
    own = {"year": _YEAR, "marital": _pick(MARITAL, "k + j"), "education": _pick(EDUCATION, "2 * k + j"), "low": _of_arm([a for a, _ in BANDS], "decimal(7,2)"), "high": _of_arm([b for _, b in BANDS], "decimal(7,2)")}
    return own | ({"dependants": _of_arm(DEPENDANTS, "int")} if template == 13 else {})


def _places(template: int) -> dict[str, str]:
    return {"state": _pick(STATES, "k + 3 * j + i"), "p_low": _of_arm([a for a, _ in PROFITS[template]], "int"), "p_high": _of_arm([b for _, b in PROFITS[template]], "int")}


def _tables(template: int) -> dict[str, tuple[dict[str, int], dict[str, str]]]:
    """name -> (sizes of the axes j and i, columns). A column named start is a number of days after FIRST_DAY here."""
    if template in (12, 20, 98):
        return {"revenue": ({"j": 3}, {"category": _pick(CATEGORIES, "k + j"), "start": _START})}
    if template in (13, 48, 85):
        return {"persons": ({"j": 3}, _persons(template)), "places": ({"j": 3, "i": 3}, _places(template))}
    if template == 18:
        return {
            "buyers": ({}, {"gender": _pick("M,F", "k"), "education": _pick(EDUCATION, "k"), "year": _YEAR}),
            "months": ({"j": 6}, {"month": "cast((k + 2 * j) % 12 + 1 as int)"}),
            "states": ({"j": 7}, {"state": _pick(STATES, "k + j")}),
        }
    if template in (37, 82):
        return {"stock": ({}, {"price": "cast(k * 7 % 61 + 10 as int)", "start": _START}), "makers": ({"j": 4}, {"maker": "cast((k * 3 + 25 * j) % 100 as int)"})}
    return {"customers": ({}, {"city": "concat('City ', cast(k % 20 as varchar(20)))", "income": "cast(k * 977 % 70000 as int)"})}


def params(spark: SparkSession, template: int, n: int) -> dict[str, DataFrame]:
    """The parameter tables of instances 1 to n."""
    out = {}
    for name, (axes, columns) in _tables(template).items():
        df = spark.range(1, n + 1).withColumnRenamed("id", "k")
        for axis, size in axes.items():
            df = df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
        out[name] = df.selectExpr("cast(k as int) as instance", *[f"date_add({FIRST_DAY}, cast({e} as int)) as {c}" if c == "start" else f"{e} as {c}" for c, e in columns.items()])
    return out


def params_sql(template: int, n: int) -> str:
    """The same as common table expressions in DuckDB's SQL, without the leading WITH; names end in the template's number."""
    out = []
    for name, (axes, columns) in _tables(template).items():
        listed = ", ".join(f"cast({FIRST_DAY} + cast({e} as int) as date) as {c}" if c == "start" else f"{e} as {c}" for c, e in columns.items())
        out.append(f"{name}{template} as (select cast(k as int) as instance, {listed} from {', '.join([f'range(1, {n + 1}) t(k)', *(f'range({size}) {axis}_({axis})' for axis, size in axes.items())])})")
    return ", ".join(out)
