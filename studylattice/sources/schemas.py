"""Column types of the tables, and the header names a log file must have."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of an attempt log and their types.
ATTEMPT_TYPES = {
    "timestamp": T.TimestampNTZType(),
    "user_id": T.LongType(),
    "subject": T.StringType(),
    "difficulty": T.StringType(),
    "score": T.IntegerType(),
    "total": T.IntegerType(),
    "dataset": T.StringType(),
    "attempt_no": T.IntegerType(),
    "time_spent(mins)": T.DoubleType(),
    "log_pos": T.LongType(),
}
# The header of an attempt log file.
ATTEMPT_HEADER = (
    "timestamp",
    "user_id",
    "subject",
    "difficulty",
    "score",
    "total",
    "dataset",
    "attempt_no",
    "time_spent(mins)",
)
ATTEMPT_RENAMES = {"timestamp": "attempt_ts", "time_spent(mins)": "time_spent_mins", "userid": "user_id"}

# The header of a question bank file.
QUESTION_HEADER = (
    "Subject",
    "Difficulty",
    "Question",
    "Option1",
    "Option2",
    "Option3",
    "Option4",
    "Answer",
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
