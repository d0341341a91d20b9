"""Small generated frames that the tests share."""

from __future__ import annotations

import pandas as pd

from tidegrid.operators.features import GENERATION, WEATHER


def silver_pandas(hours: int = 220, start: str = "2026-03-25 00:00:00") -> pd.DataFrame:
    """Hourly market rows in plain arithmetic progressions, across a spring clock change."""
    h = pd.Series(range(hours), dtype=float)
    rows = {"series_id": "one", "ts": pd.date_range(start, periods=hours, freq="h"), "price_eur_mwh": 40 + h / 10, "load_mw": 40000 + h}
    base = {"biomass_mw": 1000, "lignite_mw": 3000, "gas_mw": 2000, "hard_coal_mw": 1000, "hydro_mw": 200, "solar_mw": 100,
            "wind_offshore_mw": 100, "wind_onshore_mw": 200}
    for name in GENERATION:
        if name in base:
            rows[name] = base[name] + h / 20
    rows["nuclear_mw"] = 0.0
    rows["wind_total_mw"] = 300 + h / 10
    for name, value in zip(WEATHER, (10, 60, 8, 50, 100)):
        rows[name] = value + h / 100
    return pd.DataFrame(rows)


def table(spark, columns: str, rows):
    """A frame from tuples; timestamps given as text are read as UTC."""
    schema = ", ".join(columns.split(", "))
    plain = schema.replace(" timestamp", " string")
    df = spark.createDataFrame(rows, plain)
    for part in schema.split(", "):
        name, kind = part.split(" ")
        if kind == "timestamp":
            df = df.withColumn(name, df[name].cast("timestamp"))
    return df


def values(df, *columns, order=None):
    """Rows of some columns as tuples, sorted."""
    out = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(out, key=order or repr)
