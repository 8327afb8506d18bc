import duckdb
import pytest

import __spark_entry__ as entry
from tracebraid.plans import catalog, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["deployment_observations", "abductive_hypotheses", "structural_psl_closed_form", "group_mask_40", "stage1_micro", "metric_shift", "evidence_all", "root_ranking", "path_reachability", "a2_a3_compare"]


def rounded(v):
    return round(float(v), 5) if isinstance(v, float) else None if v != v else v


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    sql = con.execute(oracle.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(rounded, r)) for r in sql.fetchall()) if name != "metric_shift" else sorted((tuple(map(rounded, r)) for r in sql.fetchall()), key=repr)
    got = [tuple(rounded(r[n]) for n in names) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_sql_has_a_query():
    assert set(oracle.ORACLES) <= set(catalog.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["case_id", "source", "relation", "target", "abductive_support"]
