import time

from conftest import records
from pyspark.sql import functions as F
from samples import attempts, log

from studylattice.operators import leaderboard, quiz
from studylattice.sources import files
from studylattice.streaming import attempt_log, generations

CELL = (*attempt_log.CELL, "score", "attempts", "passes", "fails")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_state_equals_the_batch_after_every_append(spark, tmp_path):
    source, state, progress = (str(tmp_path / d) for d in ("log", "state", "progress"))
    rows = attempts(spark)
    rows.filter("log_pos % 2 = 0").repartition(3).write.parquet(source)
    attempt_log.run_available(stream(spark, source, rows.schema), state, progress)
    half = rows.filter("log_pos % 2 = 0")
    assert records(attempt_log.read_cells(spark, state), *CELL) == records(attempt_log.running_cells(half), *CELL)

    rows.filter("log_pos % 2 = 1").repartition(2).write.mode("append").parquet(source)
    attempt_log.run_available(stream(spark, source, rows.schema), state, progress)
    assert records(attempt_log.read_cells(spark, state), *CELL) == records(attempt_log.running_cells(rows), *CELL)

    board = ("subject", "rank", "user_id", "attempts")
    streamed = leaderboard.subject_leaderboard(attempt_log.read_cells(spark, state))
    assert records(streamed, *board) == records(leaderboard.subject_leaderboard(rows), *board)


def test_generations_bound_what_is_read_and_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generations, "GENERATION", 3)
    source, state, progress = (str(tmp_path / d) for d in ("log", "state", "progress"))
    rows = attempts(spark)
    rows.limit(0).write.parquet(source)
    attempt_log.run_available(stream(spark, source, rows.schema), state, progress)
    assert attempt_log.read_cells(spark, state).count() == 0
    for part in range(12):
        rows.filter(f"log_pos % 12 = {part}").coalesce(1).write.mode("append").parquet(source)
    attempt_log.run_available(stream(spark, source, rows.schema), state, progress)
    cells = attempt_log.read_cells(spark, state)
    assert records(cells, *CELL) == records(attempt_log.running_cells(rows), *CELL)
    assert len(list((tmp_path / "state").glob("generation=*"))) <= generations.KEPT + 1


def test_a_hundred_batches_leave_few_folders_and_a_reader_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generations, "GENERATION", 5)
    path, schema = str(tmp_path / "state"), "k int, v long"
    generations.start(spark, path, schema)
    most, reader = 0, None
    for batch in range(100):
        generations.save(spark.createDataFrame([(batch % 7, batch)], schema).coalesce(1), path, ["k"], batch)
        most = max(most, len(list((tmp_path / "state").glob("generation=*/batch_id=*"))))
        if batch == 90:
            reader = generations.newest(spark, path, ["k"])
    assert most <= 5 * (generations.KEPT + 1) + 1
    assert records(generations.newest(spark, path, ["k"]), "k", "v") == sorted((b % 7, b) for b in range(93, 100))
    assert records(reader, "k", "v") == sorted((b % 7, b) for b in range(84, 91))
    # A batch that runs again sees the batches before it only, and overwrites its own.
    generations.save(spark.createDataFrame([(1, 990)], schema), path, ["k"], 99)
    assert records(generations.newest(spark, path, ["k"]), "k", "v")[1] == (1, 990)


def test_micro_batches_number_like_one_batch(spark, tmp_path):
    source, log_path, counts, progress = (str(tmp_path / d) for d in ("in", "log", "counts", "progress"))
    rows = attempts(spark).drop("attempt_no").withColumn("subject", F.expr("IF(log_pos % 4 = 0, upper(subject), subject)"))
    for low, high in ((0, 6), (6, 7), (7, 13)):
        rows.filter(f"log_pos >= {low} and log_pos < {high}").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files come in order of their times
    run = lambda: attempt_log.number_available(stream(spark, source, rows.schema), log_path, counts, progress)
    run()
    want = quiz.attempt_numbering(rows)
    columns = ("log_pos", "user_id", "subject", "attempt_no")
    assert records(files.read_attempt_log(spark, log_path), *columns) == records(want.filter("log_pos < 13"), *columns)
    # After a restart, and with a batch that stopped between the log and its counts.
    rows.filter("log_pos >= 13").coalesce(1).write.mode("append").parquet(source)
    run()
    last = sorted((tmp_path / "counts").glob("generation=*/batch_id=*"))[-1]
    commits = sorted((p for p in (tmp_path / "progress" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for path in [*last.iterdir(), *last.glob(".*"), commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")]:
        path.unlink(missing_ok=True)
    run()
    assert records(files.read_attempt_log(spark, log_path), *columns) == records(want, *columns)
    totals = want.groupBy("user_id", F.initcap("subject").alias("subject")).agg(F.count("*").alias("attempts"))
    assert records(generations.newest(spark, counts, attempt_log.COUNTED), "user_id", "subject", "attempts") == records(
        totals, "user_id", "subject", "attempts"
    )


def test_weights_from_cells_equal_weights_from_attempts(spark):
    rows = log(spark, [(u, "Maths", "Easy", s) for u in (1, 2) for s in (0, 3, 5, 2)])
    cells = attempt_log.running_cells(rows)
    columns = ("subject", "difficulty", "passes", "fails")
    assert records(leaderboard.difficulty_weights(cells), *columns) == records(leaderboard.difficulty_weights(rows), *columns)


def test_sketches_of_users_keep_their_error(spark, tmp_path):
    """Micro-batches that share users, and a restart: within two percent of the exact counts."""
    source, state, progress = (str(tmp_path / d) for d in ("in", "state", "progress"))
    rows = spark.range(120_000).selectExpr(
        "id AS log_pos", "IF(id % 1000 = 0, NULL, id % 40000) AS user_id",
        "CASE WHEN id % 40000 < 9000 THEN 'Maths' WHEN id % 40000 < 9100 THEN NULL ELSE 'Art' END AS subject",
    )
    for part in range(3):
        rows.filter(f"log_pos % 3 = {part}").coalesce(1).write.mode("append").parquet(source)
        attempt_log.sketch_available(stream(spark, source, rows.schema), state, progress)
    exact = {r.subject: r.n for r in rows.groupBy("subject").agg(F.countDistinct("user_id").alias("n")).collect()}
    got = {r.subject: r for r in leaderboard.estimated_participation(attempt_log.read_sketches(spark, state)).collect()}
    assert got.keys() == exact.keys()
    for subject, row in got.items():
        assert abs(row.participants - exact[subject]) <= 0.02 * exact[subject]
        assert abs(row.all_users - 39_960) <= 0.02 * 39_960
    assert max(r.share for r in got.values()) == 100
    once = leaderboard.estimated_participation(leaderboard.user_sketches(rows))
    assert records(once, "subject", "participants") == sorted(((s, r.participants) for s, r in got.items()), key=repr)
    assert leaderboard.estimated_participation(leaderboard.user_sketches(rows.limit(0))).count() == 0
