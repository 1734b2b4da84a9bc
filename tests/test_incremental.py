"""Marts that outlive an application: only what changed files touch is built again, and all marts equal a full build."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from gondola.plans import facts, pricing, scores, serving
from gondola.sources import snapshots, tables, workspace

SF = "/root/testdata/sf0.001"
MARTS = [tables.conformed, facts.shelves, facts.signals, facts.own_prices, facts.rival_prices, facts.prices, scores.demand, scores.risk, scores.ready, pricing.pricing, serving.actions, serving.queue]


@pytest.fixture
def folder(spark, tmp_path):
    """The tables, lineitem as a folder of one file for rows before 1998 and one for the rest."""
    sf = tmp_path / "sf"
    sf.mkdir()
    for t in ("part", "orders", "events", "supplier", "nation", "region", "customer"):
        shutil.copy(f"{SF}/{t}.parquet", sf / f"{t}.parquet")
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    for old in ("l_shipdate < '1998-01-01'", "l_shipdate >= '1998-01-01'"):
        line.where(old).coalesce(1).write.mode("append").parquet(str(sf / "lineitem.parquet"))
    return str(sf)


def version(spark, sf, m):
    return snapshots.manifest(spark, workspace.mart_path(spark, sf, m.__name__))


def canon(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def add(spark, sf, month, n=40):
    fresh = spark.read.parquet(f"{SF}/lineitem.parquet").limit(n).withColumn("l_shipdate", F.lit(dt.datetime(*month, 5)))
    fresh.coalesce(1).write.mode("append").parquet(f"{sf}/lineitem.parquet")


def test_only_changed_months_are_built(spark, folder):
    for m in MARTS:
        m(spark, folder)
    first = {m.__name__: version(spark, folder, m) for m in MARTS}
    rows = facts.own_prices(spark, folder).count()
    # nothing changed: nothing is built, in this application or, without its memory, in another one
    workspace._seen.clear()
    serving.queue(spark, folder)
    assert all(version(spark, folder, m).version == first[m.__name__].version for m in MARTS)
    # a later month
    add(spark, folder, (2030, 3))
    serving.queue(spark, folder)
    own = version(spark, folder, facts.own_prices)
    assert own.marks["changed"] == ["2030-03-01"] and own.version == 2
    built = sum(spark.read.parquet(f"{workspace.mart_path(spark, folder, 'own_prices')}/data/{f.path}").count() for f in own.files if f not in first["own_prices"].files)
    assert 0 < built < rows / 10
    # late rows of an old month, and a file that goes
    add(spark, folder, (1995, 6))
    part = next(f for f in version(spark, folder, tables.conformed).marks["values"] if version(spark, folder, tables.conformed).marks["values"][f] == ["2030-03-01"])
    shutil.os.remove(part.split(":", 1)[1])
    serving.queue(spark, folder)
    assert all(version(spark, folder, m).marks["changed"] == ["1995-06-01", "2030-03-01"] for m in (tables.conformed, facts.shelves, facts.own_prices, facts.rival_prices))
    assert facts.own_prices(spark, folder).where("month = '2030-03-01'").count() == 0
    got = {m.__name__: canon(m(spark, folder)) for m in MARTS}
    workspace.forget(spark, folder)
    for m in MARTS:
        m(spark, folder)
        assert version(spark, folder, m).version == 1 and canon(m(spark, folder)) == got[m.__name__], m.__name__


def test_other_changes_build_anew(spark, folder):
    facts.own_prices(spark, folder)
    part = spark.read.parquet(f"{SF}/part.parquet").withColumn("p_name", F.concat(F.lit("red "), "p_name"))
    shutil.os.remove(f"{folder}/part.parquet")
    part.coalesce(1).write.parquet(f"{folder}/part.parquet")
    assert facts.own_prices(spark, folder).agg(F.min("own_brand")).first()[0] == 1.0  # all are of the own brand now
    assert version(spark, folder, facts.own_prices).marks["changed"] is None and workspace.tidy(spark, folder, keep=1) > 0
    assert facts.own_prices(spark, folder).count() > 0


def test_a_changed_plan_builds_anew(spark, folder):
    calls = []

    def build(x):
        @workspace.mart("k")
        def changing(session, sf):
            calls.append(x)
            return tables.table(session, sf, "region").select((F.col("r_regionkey") * x).alias("k"))

        return changing

    assert build(1)(spark, folder).agg(F.max("k")).first()[0] == 4
    workspace._seen.clear()
    assert build(1)(spark, folder).agg(F.max("k")).first()[0] == 4 and version(spark, folder, build(1)).version == 1
    workspace._seen.clear()
    assert build(3)(spark, folder).agg(F.max("k")).first()[0] == 12 and version(spark, folder, build(1)).version == 2
