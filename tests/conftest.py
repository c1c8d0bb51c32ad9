from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from stratusqc.constants import VARIABLES  # noqa: E402
from stratusqc.session import local_session  # noqa: E402

T0 = datetime(2024, 6, 1)
SPEC = "map<string,struct<min:double,max:double,step_max:double,persistence_max:int,unit:string>>"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_readings(spark):
    """Wide readings from {station: {variable: [values]}}, one per ``minutes``."""

    def build(data, minutes=60):
        rows = []
        for station, series in data.items():
            n = max(len(v) for v in series.values())
            for i in range(n):
                measures = [float(series[v][i]) if v in series and series[v][i] is not None else None for v in VARIABLES]
                rows.append((station * 1000 + i, station, T0 + timedelta(minutes=minutes * i), *measures, "test"))
        fields = ", ".join(f"{v} double" for v in VARIABLES)
        return spark.createDataFrame(rows, f"reading_id long, station_id long, ts timestamp, {fields}, ingest_source string")

    return build


@pytest.fixture(scope="session")
def make_stations(spark):
    """Stations from (id, lat, lon[, specs])."""

    def build(*rows):
        full = [
            (r[0], f"ST{r[0]}", f"Station {r[0]}", float(r[1]), float(r[2]), "A", "active", T0.date(), r[3] if len(r) > 3 else None)
            for r in rows
        ]
        return spark.createDataFrame(
            full,
            "station_id long, station_code string, name string, latitude double, longitude double, state string, "
            f"status string, install_date date, sensor_specs {SPEC}",
        )

    return build
