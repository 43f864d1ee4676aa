"""Every registered query runs, and agrees with its SQL twin where it has one.

The smallest tables hold trees of a single tip, which the SQL twins do not
describe, so the next size is used.
"""

import subprocess
import sys
from pathlib import Path

import pytest

from spanloom.plans import all_queries, all_sql
from tests.compare import DATA, compare, connect

FOLDER = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    status, _, _, note = compare(spark, con, FOLDER, all_queries()[name], all_sql().get(name))
    assert status in ("ok", "rows-only"), note


def test_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 200"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)


@pytest.mark.parametrize("name", ["a14_box_stats", "w04", "w05_ordinal_in_group", "w11_pair_events", "r07_nest_unnest"])
def test_no_job_before_the_action(spark, name):
    """Building a plan reads footers (one job a table) and runs nothing else."""
    name = next(n for n in all_queries() if n.startswith(name))
    spark.sparkContext.setJobGroup(f"build {name}", name)
    all_queries()[name](spark, FOLDER)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"build {name}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3
