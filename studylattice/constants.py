"""Fixed values. These define the results and must not be tuned."""

# Difficulty levels in teaching order, and their numeric rank.
LEVELS = ("Easy", "Intermediate", "Hard")
LEVEL_RANK = {"Easy": 1, "Intermediate": 2, "Hard": 3}

# Subjects with learned difficulty weights, and the starting weight per level.
WEIGHTED_SUBJECTS = ("Maths", "Science", "Social Studies", "English")
BASE_WEIGHT = {"Easy": 1.0, "Intermediate": 1.3, "Hard": 1.6}
PASS_RATIO = 0.6
PASS_FACTOR = 1.05
FAIL_FACTOR = 0.95

# Score factor per level in the gap forecast; the question count its prediction is clamped to.
GAP_FACTOR = {"Easy": 0.8, "Intermediate": 1.0, "Hard": 1.2}
MAX_SCORE = 5

# Score percentage -> days until the next revision, and the label bands.
REVISION_BANDS = ((90.0, 7), (75.0, 5), (60.0, 3))
REVISION_FLOOR_DAYS = 2
PERFORMANCE_BANDS = ((80.0, "Excellent"), (60.0, "Good"))
PERFORMANCE_FLOOR = "Needs Practice"

# Letter, lowest grade, grade-point value.
GPA_SCALE = (
    ("A+", 97.0, 4.0),
    ("A", 93.0, 4.0),
    ("A-", 90.0, 3.7),
    ("B+", 87.0, 3.3),
    ("B", 83.0, 3.0),
    ("B-", 80.0, 2.7),
    ("C+", 77.0, 2.3),
    ("C", 73.0, 2.0),
    ("C-", 70.0, 1.7),
    ("D+", 67.0, 1.3),
    ("D", 60.0, 1.0),
    ("F", 0.0, 0.0),
)

QUESTIONS_PER_QUIZ = 5
PEER_LAMBDA = 0.4
DAYS_UNTIL_QUIZ = 14
STUDY_BLOCK_HOURS = 1.5
BREAK_HOURS = 0.25
MODEL_SEED = 42
FOREST_TREES = 100
CLUSTER_RANGE = (2, 9)
CLUSTER_RESTARTS = 30

# Reference instant for schedules, so that a run is repeatable.
AS_OF = "2025-01-01 09:00:00"
