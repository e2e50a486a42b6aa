"""Small hand-checked tables."""

from __future__ import annotations

from datetime import datetime

# An invented log: (timestamp, user, subject, level, score, total, attempt number, minutes), in log
# order. Times are not in log order, two pairs share a time, and some levels were never tried.
ATTEMPTS = """
2031-03-04T08:00:00,7,Maths,Hard,1,5,1,12
2031-03-02T18:30:00,7,Maths,Hard,2,5,2,8
2031-03-09T07:15:00,7,Maths,Easy,4,5,3,5
2031-03-06T21:00:00,7,Maths,Hard,3,4,4,10
2031-03-05T10:00:00,7,Latin,Easy,5,5,1,6
2031-03-05T10:00:00,7,Latin,Intermediate,3,5,2,7
2031-03-01T09:00:00,7,Latin,Easy,4,5,3,9
2031-03-08T12:00:00,9,Maths,Intermediate,2,5,1,11
2031-03-03T12:00:00,9,Maths,Easy,5,5,2,4
2031-03-07T16:45:00,9,Maths,Hard,0,5,3,20
2031-03-11T16:45:00,9,Maths,Intermediate,4,5,4,6
2031-03-10T19:20:00,9,Maths,Intermediate,3,5,5,7
2031-03-02T06:00:00,9,Latin,Hard,1,5,1,15
2031-03-12T06:00:00,9,Latin,Hard,2,5,2,14
2031-03-04T14:10:00,9,Latin,Hard,3,5,3,13
2031-03-06T14:10:00,9,Latin,Easy,5,5,4,3
2031-03-13T20:00:00,12,Science,Intermediate,2,5,1,8
2031-03-14T07:05:30,7,Maths,Easy,5,5,5,0.75
2031-03-12T11:00:00,7,Latin,Hard,2,5,4,5
2031-03-12T11:00:00,7,Latin,Easy,1,5,5,5
"""

SCHEMA = (
    "log_pos long, attempt_ts timestamp_ntz, user_id long, subject string, difficulty string, "
    "score int, total int, dataset string, attempt_no int, time_spent_mins double"
)


def attempts(spark):
    rows = []
    for pos, line in enumerate(ATTEMPTS.strip().splitlines()):
        at, user, subject, level, score, total, number, minutes = line.split(",")
        rows.append(
            (pos, datetime.fromisoformat(at), int(user), subject, level, int(score), int(total), "bank.csv", int(number), float(minutes))
        )
    return spark.createDataFrame(rows, SCHEMA)


def log(spark, rows):
    """Attempts from (user, subject, level, score) or (..., total), an hour apart, in log order."""
    full = []
    for pos, row in enumerate(rows):
        user, subject, level, score, *rest = row
        total = rest[0] if rest else 5
        at = datetime(2025, 1, 1 + pos // 24 % 28, pos % 24)
        full.append((pos, at, user, subject, level, score, total, "bank.csv", None, 5.0))
    return spark.createDataFrame(full, SCHEMA)
