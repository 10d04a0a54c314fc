"""The driver's contract."""

import os

import pytest

SMALL = "/root/testdata/sf0.001"


def test_names_and_oracles_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"envelope_rms", "kg_interpret", "coherence_network"} <= set(e.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", ["envelope_rms", "amplitude_features", "onset_aglr", "fatigue_windows", "wpli_network", "adl_activation"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SMALL}/events.parquet')")
    got = e.queries()[name](spark, SMALL).toPandas()
    want = con.execute(e.oracle_sql()[name]).df()[list(got.columns)]
    assert len(got) == len(want)
    keys = [c for c in got.columns if got[c].dtype.kind in "iO"]
    got, want = (x.sort_values(keys or list(x.columns)).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert ((got[c] - want[c]).abs().fillna(0) <= 1e-5 * (1 + want[c].abs().fillna(0))).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
