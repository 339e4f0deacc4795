"""Every query of the engine's own operators against its SQL oracle, on the smallest tables."""

import pytest

from tests.oracle import duck, spark_rows
from trajecta.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, data, name):
    assert spark_rows(registry.QUERIES[name](spark, data)) == duck(data, registry.ORACLES[name])


def test_queries_without_oracle_run(spark, data):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        rows = registry.QUERIES[name](spark, data)
        assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns), name


def test_option_masks_by_hand(spark, data):
    wanted = ["STANDARD POLISHED TIN", "small brass", "LARGE"]
    got = {r["value"]: r["mask"] for r in registry.QUERIES["option_masks"](spark, data).collect()}
    values = {r["p_type"] for r in spark.read.parquet(f"{data}/part.parquet").select("p_type").collect()}
    assert set(got) == values
    for value, mask in got.items():
        for j, w in enumerate(wanted):
            a, b = set(value.lower().split()), set(w.lower().split())
            if a >= b or b >= a:  # one holds all words of the other: as like as can be
                assert mask >> j & 1
            elif not a & b and len(a) == len(b) == 1 and not set("".join(a)) & set("".join(b)):
                assert not mask >> j & 1


def test_micro_batches_hold_every_row_once(spark, data):
    rows = registry.QUERIES["microbatch_partitions"](spark, data)
    assert rows.count() == rows.distinct().count()


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["case"]: r["n_steps"] for r in rows}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not any(name.startswith("op") and name[2].isdigit() for name in registry.QUERIES)
