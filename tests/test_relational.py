"""The DB-API source over SQLite."""

import json
import sqlite3
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F, types as T

from fundwatch.schema import TABLES
from fundwatch.sources.relational import RelationalSource, read_dbapi


@pytest.fixture()
def path(tmp_path):
    file = str(tmp_path / "bank.db")
    with sqlite3.connect(file) as db:
        for name, ddl in TABLES.items():
            db.execute(f"CREATE TABLE {name} ({', '.join(f.name for f in T.StructType.fromDDL(ddl))})")
        rows = [(f"r{i:03d}" if i % 10 else None, f"R{i:03d}", i, i % 2 if i % 7 else None, i / 4, "2026-09-16 12:00:00" if i % 3 else None) for i in range(200)]
        db.executemany("INSERT INTO rules (id, rule_code, risk_score_contribution, is_active, threshold_value, created_at) VALUES (?, ?, ?, ?, ?, ?)", rows)
    db.close()
    return file


def test_every_row_once_in_key_ranges(spark, path):
    df = read_dbapi(spark, "rules", "sqlite3", {"database": path}, partitions=4)
    got = df.collect()
    assert sorted(r["rule_code"] for r in got) == [f"R{i:03d}" for i in range(200)]
    one = next(r for r in got if r["rule_code"] == "R001")
    assert (one["risk_score_contribution"], one["is_active"], one["threshold_value"]) == (1, True, 0.25)
    assert df.filter("rule_code = 'R001'").select(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).first()[0] == "2026-09-16 12:00:00"
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 66  # 45 keys a range, and the 20 rows without a key in the first


def test_conditions_reach_the_database(spark, path):
    options = {"module": "sqlite3", "connect": json.dumps({"database": path}), "dbtable": "rules", "partitionColumn": "id", "numPartitions": "3", "conditions": '[["risk_score_contribution", ">", 150], ["is_active", "=", true]]'}
    reader = RelationalSource(options).reader(T.StructType.fromDDL("rule_code string, risk_score_contribution int"))
    parts = [sorted(reader.read(p)) for p in reader.partitions()]
    want = [(f"R{i}", i) for i in range(151, 200) if i % 2 and i % 7]
    assert sorted(r for p in parts for r in p) == want and max(map(len, parts)) <= 8
    noon = datetime(2026, 9, 16, 12, tzinfo=timezone.utc)
    df = read_dbapi(spark, "rules", "sqlite3", {"database": path}, columns=["rule_code"],
                    conditions=[("risk_score_contribution", ">=", 190), ("is_active", "=", True), ("rule_code", ">", "R193"), ("created_at", "=", noon)])
    assert df.columns == ["rule_code"]
    assert sorted(r[0] for r in df.collect()) == ["R197", "R199"]  # R195 has no time
    assert df.filter("rule_code = 'R197'").count() == 1 and df.count() == 2  # a filter of one use does not stay
    with pytest.raises(ValueError):
        read_dbapi(spark, "rules", "sqlite3", {"database": path}, conditions=[("id", "LIKE", "%")])


def test_repeated_keys_empty_tables_and_names(spark, path):
    with sqlite3.connect(path) as db:
        db.executemany("INSERT INTO devices (id, device_fingerprint) VALUES (?, ?)", [("same" if i < 50 else f"z{i}", str(i)) for i in range(60)])
    db.close()
    df = read_dbapi(spark, "devices", "sqlite3", {"database": path}, partitions=6, columns=["id", "device_fingerprint"])
    assert sorted(int(r["device_fingerprint"]) for r in df.collect()) == list(range(60))
    assert df.count() == 60
    for name in set(TABLES) - {"rules", "devices"}:
        assert read_dbapi(spark, name, "sqlite3", {"database": path}).isEmpty()
    with pytest.raises(ValueError):
        read_dbapi(spark, "secrets", "sqlite3", {"database": path})
    with pytest.raises(Exception, match="plain name"):
        read_dbapi(spark, "atms", "sqlite3", {"database": path}, key="id; DROP TABLE atms").collect()
