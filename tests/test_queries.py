"""Every registered query on the smallest tables, next to its DuckDB SQL."""

import os

import pytest

SF_DIR = "/root/testdata/sf0.001"
if not os.path.isdir(SF_DIR):
    pytest.skip("test tables are not here", allow_module_level=True)

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
import check  # noqa: E402


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, db, name):
    ok, note = check.compare(spark, db, SF_DIR, name)
    assert ok, note


def test_groups_cover_all_users_with_the_best_number_of_letters(spark):
    queries = contract.queries()
    users = {r.user_id for r in queries["student_profiles"](spark, SF_DIR).collect() if r.avg_difficulty is not None}
    best = [r.k for r in queries["cluster_k_selection"](spark, SF_DIR).collect() if r.best]
    letters = [(r.user_id, r.study_group) for r in queries["student_groups"](spark, SF_DIR).collect()]
    assert len(best) == 1 and len({g for _, g in letters}) == best[0]
    assert {u for u, _ in letters} == users and len(letters) == len(users)
    members = []
    for page in queries["group_members"](spark, SF_DIR).collect():
        ids = [int(i) for i in page.member_ids.split(", ")]
        assert len(ids) == page.members
        members += [(i, page.study_group) for i in ids]
    assert sorted(members) == sorted(letters)


def test_model_intervals_lie_between_the_labels(spark):
    queries = contract.queries()
    rows = queries["revision_interval_model"](spark, SF_DIR).collect()
    targets = {(r.user_id, r.subject, r.difficulty) for r in queries["revision_summary"](spark, SF_DIR).collect()}
    assert {(r.user_id, r.subject, r.difficulty) for r in rows} == targets and len(rows) == len(targets)
    assert all(r.base_interval is None or 2 <= r.base_interval <= 7 for r in rows)
    sessions = {(r.user_id, r.subject, r.difficulty): r.sessions for r in rows if r.sessions is not None}
    schedule = queries["revision_schedule_model"](spark, SF_DIR).groupBy("user_id", "subject", "difficulty").count().collect()
    assert {(r.user_id, r.subject, r.difficulty): r["count"] for r in schedule} == sessions
