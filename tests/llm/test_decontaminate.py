from edges import CLASHING, corpus, frame, words

from studylattice.llm import decontaminate


def items():
    made = [(1, " ".join(words(3, 60)[10:40])), (2, " ".join(words(410, 30))), (3, ""), (4, None), (5, "one"), (6, "TWO words")]
    made += [(7, " ".join(words(7, 30_000)[12_345:12_380])), (8, " ".join(words(4, 60)[5:25] + ["other"] * 3)), (None, "a b c d e")]
    made += [(9, " ".join(words(999, 100)[:9])), (10, " ".join(words(999, 100)[20:95])), (9, "a b c d e")]
    return made


def runs(text, size):
    found = (text or "").encode().lower().split()
    return set(zip(*[found[i:] for i in range(size)])) if len(found) >= size else set()


def expected():
    found = []
    for doc_id, text in corpus():
        for item_id, item in items():
            size = min(5, len((item or "").split()))
            wanted = runs(item, size) if size else set()
            shared = len(wanted & runs(text, size)) if size else 0
            if item_id is not None and wanted and 100 * shared >= 80 * len(wanted):
                found.append((doc_id, item_id, len(wanted), shared))
    return found


def item_frame(spark, rows):
    return spark.createDataFrame([(i, t, *([None] * 10)) for i, t in rows], f"item_id long, text string, {CLASHING}")


def test_hits_equal_brute_force(spark):
    got = decontaminate.contained_items(frame(spark, corpus()), item_frame(spark, items()))
    rows = [(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(expected(), key=repr)
    assert len(rows) > 15


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    got = decontaminate.contained_items(frame(spark, corpus()), item_frame(spark, items()))
    assert sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()), key=repr) == sorted(expected(), key=repr)


def test_clean_rows_keep_all_columns(spark):
    docs = frame(spark, corpus())
    left = decontaminate.without_items(docs, item_frame(spark, items()))
    leaked = {i for i, *_ in expected()}
    assert left.columns == docs.columns
    # The row without an id holds leaked text too; the one without a text stays.
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(
        i or -1 for i, t in corpus() if i not in leaked or (i is None and t is None)
    )


def test_empty_tables(spark):
    assert decontaminate.contained_items(frame(spark, []), item_frame(spark, items())).count() == 0
    assert decontaminate.contained_items(frame(spark, corpus()), item_frame(spark, [])).count() == 0
    assert decontaminate.without_items(frame(spark, corpus()), item_frame(spark, [])).count() == len(corpus())
