import time
from pathlib import Path

import pytest
from conftest import records
from pyspark.sql import functions as F
from samples import attempts, log

from studylattice.operators import leaderboard, revision
from studylattice.operators import quiz as Q
from studylattice.sources import files


def bank(spark, n=40):
    rows = [(i, "maths" if i % 4 else "x-ray", "easy", f"q{i}", "a", "b", "c", "d", "a") for i in range(n)]
    return spark.createDataFrame(rows, "question_id long, subject string, difficulty string, question string, option1 string, option2 string, option3 string, option4 string, answer string")


def test_bank_is_title_cased_and_counted(spark):
    rows = Q.question_bank(bank(spark))
    assert records(Q.question_bank_counts(rows), "subject", "difficulty", "questions") == [("Maths", "Easy", 30), ("X-Ray", "Easy", 10)]
    assert rows.first().options == ["a", "b", "c", "d"]


def test_sample_is_distinct_repeatable_and_seeded(spark):
    rows = Q.question_bank(bank(spark))
    first = records(Q.quiz_sample(rows), "subject", "place", "question_id")
    assert first == records(Q.quiz_sample(rows.repartition(7)), "subject", "place", "question_id")
    assert len({r[2] for r in first}) == 10
    assert first != records(Q.quiz_sample(rows, seed=1), "subject", "place", "question_id")
    assert Q.quiz_sample(rows.limit(3)).count() == 3


def test_grading_needs_the_exact_answer(spark):
    responses = spark.createDataFrame([(1, 0, "a"), (1, 1, "A"), (1, 2, None), (2, 3, "a")], "session_id long, question_id long, choice string")
    assert records(Q.grade_responses(responses, Q.question_bank(bank(spark))), "session_id", "score", "total") == [(1, 1, 3), (2, 1, 1)]


def test_unknown_questions_are_asked_all_the_same(spark):
    responses = spark.createDataFrame([(1, 0, "a"), (1, 999, "a"), (1, None, "a")], "session_id long, question_id long, choice string")
    assert records(Q.grade_responses(responses, Q.question_bank(bank(spark))), "session_id", "score", "total") == [(1, 1, 3)]


def test_numbering_matches_the_log(spark, many_partitions):
    rows = attempts(spark)
    numbered = Q.attempt_numbering(rows.drop("attempt_no"))
    assert records(numbered, "log_pos", "attempt_no") == records(rows, "log_pos", "attempt_no")


def test_numbering_continues_and_ignores_case_of_the_subject(spark):
    old = log(spark, [(1, "Maths", "Easy", 1), (1, "maths", "Hard", 1), (2, "Art", "Easy", 1)])
    new = log(spark, [(1, "MATHS", "Easy", 1), (2, "Maths", "Easy", 1), (1, "Maths", "Easy", 1)]).drop("attempt_no")
    got = Q.continue_numbering(new, old)
    assert records(got, "log_pos", "user_id", "attempt_no") == [(0, 1, 3), (1, 2, 1), (2, 1, 4)]
    assert got.filter("user_id is null").count() == 0


def test_finished_attempts(spark):
    sessions = spark.sql(
        "SELECT 7L session_id, '12' user_id, 'Art' subject, 'Easy' difficulty, TIMESTAMP_NTZ'2025-01-01 10:00:00' started_at,"
        " TIMESTAMP_NTZ'2025-01-01 10:07:30.9' finished_at, 'some/where/bank.csv' dataset_path"
        " UNION ALL SELECT 8L, 'x12', 'Art', 'Easy', TIMESTAMP_NTZ'2025-01-01 10:00:00', TIMESTAMP_NTZ'2025-01-01 10:01:00', 'bank.csv'"
    )
    grades = spark.createDataFrame([(7, 3, 5), (8, 1, 5)], "session_id long, score int, total int")
    row = Q.finished_attempts(sessions, grades).collect()
    assert len(row) == 1
    row = row[0]
    assert (str(row.attempt_ts), row.user_id, row.dataset, row.time_spent_mins) == ("2025-01-01 10:07:30", 12, "bank.csv", 7.52)


def test_combine_fills_missing_columns(spark):
    both = Q.combine_logs(log(spark, [(1, "Art", "Easy", 1)]).drop("dataset"), log(spark, [(2, "Art", "Easy", 1)]))
    assert records(both, "user_id", "dataset", "log_pos") == [(1, None, 0), (2, "bank.csv", 1)]


def test_filter_and_domains(spark):
    rows = attempts(spark)
    assert Q.attempts_filter(rows, user_id=7, subject="Maths", difficulty="Hard").count() == 3
    assert Q.attempts_filter(rows, user_id=9).count() == 9
    assert Q.attempts_filter(rows).count() == 20
    values = [(r.domain, r.value) for r in Q.filter_domains(log(spark, [(10, "B", "Easy", 1), (9, "A", "Easy", 1)])).collect()]
    assert values == [("difficulty", "Easy"), ("subject", "A"), ("subject", "B"), ("user", "9"), ("user", "10")]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_attempts(attempts(spark), path, "first")
    plan = Q.attempts_filter(files.read_attempt_log(spark, path), user_id=7, subject="Maths").select("score")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in text and "EqualTo(subject,Maths)" in text
    assert "ReadSchema: struct<user_id:bigint,subject:string,score:int>" in text


def test_csv_log_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "log.csv")
    rows = attempts(spark)
    files.write_attempts_csv(rows, path)
    files.write_attempts_csv(rows.filter("log_pos = 0"), path)
    back = files.read_attempts_csv(spark, path)
    assert back.count() == 21
    assert records(back.dropDuplicates(["log_pos"]), *rows.columns) == records(rows, *rows.columns)


def test_csv_header_in_any_order_and_bad_values(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        " Score ,TIMESTAMP,user_id,subject,difficulty,total,dataset,attempt_no,time_spent(mins)\n"
        "3,2031-05-01T20:00:00,41,Maths,Hard,5,bank.csv,1,9\n"
        "oops,2031-05-02 08:15,42,Maths,Hard,5,bank.csv,1,0.25\n"
        ",2031-05-02 08:15,43,Maths,Hard,5,bank.csv,1,0.25\n"
    )
    rows = files.read_attempts_csv(spark, str(path))
    assert records(rows, "user_id", "score", "time_spent_mins", "log_pos") == [(41, 3, 9.0, 0), (43, None, 0.25, 2)]
    assert records(files.rejected_attempts(spark, str(path)), "user_id", "score", "reason") == [("42", "oops", "score")]


def without_positions(spark, rows, path):
    """A log in one CSV file, its lines in log order and without a ``log_pos``."""
    files.write_attempts_csv(rows.drop("log_pos").coalesce(1), path)
    return [p for p in Path(path).iterdir() if p.suffix == ".csv"]


@pytest.fixture
def tiny_splits(spark):
    """Files are read in many splits, several of them by one task."""
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "3"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_lines_of_a_csv_log_are_its_order(spark, tmp_path, tiny_splits):
    made = [(i % 3, "Maths" if i % 2 else "Art", "Easy", (7 * i) % 6) for i in range(200)]
    rows = log(spark, made).withColumn("attempt_no", F.lit(1)).orderBy("log_pos")
    assert len(without_positions(spark, rows, str(tmp_path / "log.csv"))) == 1
    back = files.read_attempts_csv(spark, str(tmp_path / "log.csv"))
    assert back.rdd.getNumPartitions() > 5
    assert records(back, "log_pos", "user_id", "score") == records(rows, "log_pos", "user_id", "score")
    # More files: those changed later come after, and rows that are rejected keep their number.
    time.sleep(1.1)
    (tmp_path / "log.csv" / "a-later.csv").write_text(
        "timestamp,user_id,subject,difficulty,score,total,dataset,attempt_no,time_spent(mins)\n"
        "never,1,Art,Easy,1,5,b.csv,1,1\n2031-05-01T20:00:00,77,Art,Easy,1,5,b.csv,1,1\n"
    )
    back = files.read_attempts_csv(spark, str(tmp_path / "log.csv"))
    assert [r.log_pos for r in back.filter("user_id = 77").collect()] == [201]


def test_queries_over_a_csv_log_agree_with_the_parquet_log(spark, tmp_path, tiny_splits):
    made = [(i % 4, ["Maths", "Science", "English"][i % 3], ["Easy", "Hard"][i % 2], (11 * i) % 6) for i in range(90)]
    rows = Q.attempt_numbering(log(spark, made)).orderBy("log_pos")
    without_positions(spark, rows, str(tmp_path / "log.csv"))
    files.append_attempts(rows, str(tmp_path / "log"), "all")
    text, table = files.read_attempts_csv(spark, str(tmp_path / "log.csv")), files.read_attempt_log(spark, str(tmp_path / "log"))
    for operator in (leaderboard.progress_leaderboard, revision.recent_attempts, lambda r: revision.revision_interval_model(r, trees=5)):
        found, want = operator(text), operator(table)
        assert records(found, *want.columns) == records(want, *want.columns)


def test_a_batch_enters_the_log_once(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "log"), attempts(spark)
    half = rows.filter("log_pos < 10")
    assert files.append_attempts(half, path, "one")
    assert not files.append_attempts(half, path, "one")
    assert files.append_attempts(rows.filter("log_pos >= 10"), path, "two")
    assert records(files.read_attempt_log(spark, path), *rows.columns) == records(rows, *rows.columns)
    # Killed between the rows and the name: readers see nothing of it, and the next try is whole.
    with monkeypatch.context() as patch:
        patch.setattr(files, "_renamed", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            files.append_attempts(half, path, "three")
    assert files.read_attempt_log(spark, path).count() == 20
    assert files.append_attempts(half, path, "three") and files.read_attempt_log(spark, path).count() == 30
    # Two drivers at once: the second finds the name taken when it renames.
    with monkeypatch.context() as patch:
        patch.setattr(files, "_exists", lambda *a: False)
        assert not files.append_attempts(half, path, "three")
    assert files.read_attempt_log(spark, path).count() == 30
    with pytest.raises(ValueError, match="named"):
        files.append_attempts(half, path, "a/b")


def test_missing_columns_are_named(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("user_id,subject\n1,Maths\n")
    with pytest.raises(files.MissingColumns, match="difficulty"):
        files.read_attempts_csv(spark, str(path))


def test_rejected_rows_are_shown(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "user_id,timestamp,subject,difficulty,score,total,dataset,attempt_no,time_spent(mins)\n"
        "5,2031-05-01T20:00:00,Maths,Hard,3,5,bank.csv,1,9\n"
        "x5,2031-05-01T20:00:00,Maths,Hard,3,5,bank.csv,2,9\n"
        "5,some day,Maths,Hard,3,5,bank.csv,3,9\n"
    )
    assert records(files.read_attempts_csv(spark, str(path)), "user_id", "attempt_no") == [(5, 1)]
    assert records(files.rejected_attempts(spark, str(path)), "attempt_no", "reason") == [("2", "user_id"), ("3", "timestamp")]


def test_files_with_other_headers_are_refused(spark, tmp_path):
    head = "user_id,timestamp,subject,difficulty,score,total,dataset,attempt_no,time_spent(mins)\n"
    other = "timestamp,user_id,subject,difficulty,total,score,dataset,attempt_no,time_spent(mins)\n"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.csv").write_text(head + "5,2031-05-01T20:00:00,Maths,Hard,3,5,bank.csv,1,9\n")
    (tmp_path / "log" / "b.csv").write_text(other + "2031-05-01T20:00:00,5,Maths,Hard,5,2,bank.csv,1,9\n")
    with pytest.raises(Exception, match="header"):
        files.read_attempts_csv(spark, str(tmp_path / "log")).collect()


def test_quotes_commas_and_line_breaks_survive(spark, tmp_path):
    odd = [("art", "easy", 'Say "hi", then\ngo', " lead", "tail ", "a,b", "d", " lead"), ("art", "easy", "plain", "p", "q", "r", None, "p")]
    columns = "Subject string, Difficulty string, Question string, Option1 string, Option2 string, Option3 string, Option4 string, Answer string"
    path = str(tmp_path / "bank")
    files.write_csv(spark.createDataFrame(odd, columns), path)
    back = files.read_questions_csv(spark, path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(odd, key=repr)


def test_doubled_quotes_are_read(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text(
        "Subject,Difficulty,Question,Option1,Option2,Option3,Option4,Answer\n"
        'art,easy,"Pick ""one"", or two",p,q,r,s,q\n'
    )
    row = files.read_questions_csv(spark, str(path)).first()
    assert (row.question, row.answer) == ('Pick "one", or two', "q")


def test_malformed_bank_line_can_never_be_answered(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text(
        "Subject,Difficulty,Question,Option1,Option2,Option3,Option4,Answer\n"
        "art,easy,Pick one,p,q,r,s,q\n"
        "art,easy,Pick one, or two,p,q,r,s,q\n"
    )
    rows = Q.question_bank(files.read_questions_csv(spark, str(path))).collect()
    assert [r.answer in r.options for r in rows] == [True, False]
    assert rows[0].subject == "Art"


def test_csv_export_has_a_header(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), path)
    assert spark.read.csv(path, header=True).columns == ["a", "b"]
