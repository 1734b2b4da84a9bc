"""Persistence on a panel whose rates are known."""

from datetime import date

from pyspark.sql import functions as F

from gondola.plans import validation

FACTS = "month date, store_id long, category string, position string, gap double, direction string"


def test_persistence(spark):
    months = [date(2000 + k // 12, k % 12 + 1, 1) for k in range(24)]
    rows = [(m, 1, "flip", ("Overpriced", "Fair")[k % 2], float(k % 2), "Sustained Fair") for k, m in enumerate(months)]
    rows += [(m, 2, "still", "Fair", 10.0 + 0.05 * k, None if k == 5 else "A") for k, m in enumerate(months) if k != 3]
    rows += [(m, 3, "lost", "Unknown", None, "Insufficient Data") for m in months]
    facts = spark.createDataFrame(rows, FACTS)
    got = {(r["stratum"], r["measure"], r["horizon"]): r for r in validation.persistence(facts, F.col("category")).collect()}
    assert {k[1:] for k in got} == {(m, f"T+{n}") for m in ("direction", "magnitude", "action") for n in (1, 2, 3)}
    rate = lambda *k: (got[k]["n"], got[k]["persisted"])
    assert [rate("flip", "direction", f"T+{n}") for n in (1, 2, 3)] == [(23, 0.0), (22, 100.0), (21, 0.0)]
    assert [rate("flip", "magnitude", f"T+{n}") for n in (1, 2, 3)] == [(23, 0.0), (22, 100.0), (21, 0.0)]
    # month 3 is absent, so no pair ends or begins there
    assert [rate("still", "direction", f"T+{n}") for n in (1, 2, 3)] == [(21, 100.0), (20, 100.0), (19, 100.0)]
    assert [rate("still", "magnitude", f"T+{n}")[1] for n in (1, 2, 3)] == [100.0, 0.0, 0.0]
    assert rate("still", "action", "T+1") == (19, 100.0)
    assert rate("lost", "action", "T+1") == (23, 100.0) and ("lost", "direction", "T+1") not in got
    assert got["still", "direction", "T+1"]["p_value"] == 1.0 and got["still", "direction", "T+1"]["lift"] == 0.0
    assert got["flip", "direction", "T+2"]["p_value"] == 1 / 501
    assert 40 < got["flip", "direction", "T+2"]["by_chance"] < 56
    again = validation.persistence(facts, F.col("category")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got.values()))
