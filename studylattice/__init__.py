"""Learning analytics over quiz, course and study-plan tables, as Spark DataFrame operators."""
