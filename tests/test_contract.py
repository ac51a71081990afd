"""Driver contract: entry smoke, registry shape, oracle coverage."""

import re

import __spark_entry__ as E


def test_entry_runs_and_has_rows(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["label", "dataset", "seeds", "mean", "stderr", "mean_first_step"]
    assert len(rows) > 0
    assert {r["label"] for r in rows} <= {"Baseline", "Variant A", "Variant B"}


def test_registry_names_and_oracles():
    qs, orc = E.queries(), E.oracle_sql()
    assert len(qs) >= 200
    assert set(orc) <= set(qs)
    # every oracle-less query of the library itself is a deliberate rows-only check
    own = {n for n in qs if not re.match(r"op\d+_|pipeline$", n)}
    assert own - set(orc) == set()
