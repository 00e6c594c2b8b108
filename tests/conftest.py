import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fundwatch.schema import TRANSFER_SCHEMA  # noqa: E402

T0 = datetime(2026, 9, 16, 12, 0, 0, tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Transfers from tuples (id, seconds after T0, sender, receiver, amount, {other columns})."""

    def build(rows, extra=""):
        names = TRANSFER_SCHEMA.fieldNames()
        data = []
        for i, (tid, at, sender, receiver, amount, *rest) in enumerate(rows):
            row = dict.fromkeys(names)
            row.update(transaction_id=tid, ts=T0 + timedelta(seconds=at), sender_account=sender, receiver_account=receiver, amount=float(amount), currency="INR", channel="UPI")
            row.update(rest[0] if rest else {})
            data.append(tuple(row[n] for n in names))
        return spark.createDataFrame(data, TRANSFER_SCHEMA)

    return build


@pytest.fixture(scope="session")
def rows():
    def collect(df, *by):
        out = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(out, key=lambda r: tuple(str(r[b]) for b in by)) if by else out

    return collect
