"""Every registered query with an oracle on the smallest tables; a third by default, all with FULL_ORACLES=1 (seven minutes)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
QUICK = (
    "standardised_growth_summary transform_pca fill_method_2 pair_vintages news accuracy_by_year compare_models "
    "panel_gram local_level stream_vintages stream_late_events stream_weekly_windows value_as_of vintage_pairs lost_pairs "
    "irregular_vintage_changes vintage_diff released_cells revised_cells released_series revision_impact "
    "decomposition_gaps update_report select_params backfill first_factor_scores first_factor_loadings factor_ar_table "
    "component_contributions interpolate_cubic cubic_reproduces_polynomial fill_method_2_cubic wide_vintage_to_long "
    "panel_wide impact_matrix chain_breaks compare_models_with_p stored_params stored_vintages quarter_report year_report"
).split()
CHOSEN = sorted(entry_points.oracle_sql()) if os.environ.get("FULL_ORACLES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    for t in (t for t in tables.split() if os.path.exists(f"{DIR}/{t}.parquet")):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([r[i] for i in order] for r in rows), key=lambda r: [str(x) for x in r if not isinstance(x, float)] + [str(x) for x in r])


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, con, name):
    df = entry_points.queries()[name](spark, DIR)
    cur = con.execute(entry_points.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = plain([tuple(r) for r in df.collect()], df.columns), plain(cur.fetchall(), names)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert (math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) if isinstance(x, float) and y is not None else x == y), (a, b)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
