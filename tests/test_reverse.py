"""Reverse matching ranks jobs for every résumé, also where jobs have more candidates than a shortlist recalls."""

import os

import pytest

from veritrail.plans import matching
from veritrail.plans.registry import ORACLES, QUERIES, table

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_resume_is_ranked(spark):
    import duckdb

    names = ["resume_id", "job_id", "score_final", "evidence_evaluated", "rank"]
    got = sorted(tuple(r) for r in QUERIES["reverse_match"](spark, SF).select(*names).collect())
    customers = table(spark, SF, "customer")
    assert customers.groupBy("c_nationkey").count().where(f"count > {matching.COARSE_K}").count() > 0
    assert {r[0] for r in got} == {r.c_custkey for r in customers.collect()}
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['reverse_match']})").fetchall()
    assert [(a, b, round(float(c), 6), d, e) for a, b, c, d, e in got] == sorted((a, b, round(float(c), 6), d, e) for a, b, c, d, e in want)
