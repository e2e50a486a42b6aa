"""Small corpora with the cases every operator has to stand."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use as names of their own.
CLASHING = "score int, component_id int, kept string, a int, b int, n int, features string, label int, weight string, band int"


def words(seed: int, count: int) -> list[str]:
    made = random.Random(seed)
    return ["".join(made.choice("abcdefghijklmnop") for _ in range(made.randint(1, 6))) for _ in range(count)]


def corpus() -> list[tuple[int | None, str | None]]:
    """Distinct texts, exact and near copies, chains, short, empty, null, very long and repeated ones."""
    rows: list[tuple[int | None, str | None]] = [(i, " ".join(words(i, 60))) for i in range(1, 30)]
    base = words(999, 100)
    rows += [(100 + i, " ".join(base)) for i in range(6)]
    for i in range(12):  # near copies at several distances
        edited = list(base)
        for k in range(i):
            edited[(7 * k + i) % 100] = f"edit{i}x{k}"
        rows.append((200 + i, " ".join(edited)))
    for i in range(6):  # a chain: neighbours alike, ends not
        rows.append((300 + i, " ".join(words(555, 80)[6 * i : 50 + 6 * i])))
    rows += [(400, ""), (401, None), (402, "   \n\t "), (403, "one"), (404, "One"), (405, "two words"), (406, "TWO  words\n")]
    rows += [(407, "a b c d e"), (408, "a b c d e f"), (409, "x" * 100_000), (410, " ".join(words(7, 30_000)))]
    rows += [(411, "Größe é ÀÉ tête"), (412, "größe é ÀÉ tête"), (1, " ".join(words(1, 60))), (None, " ".join(base)), (None, None)]
    return rows


def frame(spark, rows, partitions: int = 3):
    full = [(i, t, "en", "s", len(t) if t else 0, *([None] * 10)) for i, t in rows]
    return spark.createDataFrame(full, f"{DOCS}, {CLASHING}").repartition(partitions)
