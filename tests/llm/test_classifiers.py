import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from edges import corpus, frame, words

from studylattice.llm import common, licenses, lm_score, quality, toxicity

LABELS = "doc_id long, quality int, toxic int, text string, label int, weight double"
INSULTS = ["blockhead", "numbskull", "nincompoop"]


def labelled(spark, count=600):
    """Documents of which a sixth is shouting or repetition, and a fifth insults somebody."""
    made, labels, known = [], [], words(0, 400)
    for i in range(1000, 1000 + count):
        text = random.Random(i).choices(known, k=40 + i % 50)
        bad, toxic = i % 6 == 0, i % 5 == 1
        if bad:
            text = [w.upper() + "!!" for w in text] if i % 12 else text[:2] * 30
        if toxic:
            text.insert(len(text) // 2, INSULTS[i % 3])
        made.append((i, " ".join(text)))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (1001, None, None), (1002, 7, -1), (9_999_999, 1, 0), (1003, 1, 0)]
    docs = frame(spark, made + corpus())
    return docs, spark.createDataFrame([(*r, None, None, None) for r in labels], LABELS), {r[0]: r[1:3] for r in labels[:count]}


def accuracy(rows, truth, column):
    own = [r for r in rows if r.doc_id in truth and r.held_out]
    assert len(own) > 80
    return np.mean([r.predicted == truth[r.doc_id][column] for r in own])


def held_out(doc_id, modulus, left_out):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == left_out


@pytest.mark.parametrize(
    ("module", "column", "modulus", "left_out", "threshold"),
    [(quality, 0, 4, 2, 0.7), (toxicity, 1, 5, 0, 0.5)],
    ids=["quality", "toxicity"],
)
def test_held_out_accuracy_and_edges(spark, module, column, modulus, left_out, threshold):
    docs, labels, truth = labelled(spark)
    model = module.train(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == held_out(r.doc_id, modulus, left_out) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    assert accuracy(rows, truth, column) > 0.95
    keep = module.good_documents if module is quality else module.harmless_documents
    kept = keep(docs, model)
    assert kept.columns == docs.columns
    wanted = [r for r in rows if (r.score >= threshold) == (module is quality)]
    assert kept.count() == len(wanted)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labels_and_no_documents(spark, module):
    docs, labels, _ = labelled(spark, 20)
    model = module.train(docs, labels.limit(0))
    assert {r.score for r in module.score(docs, model).collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0
    one_class = labels.filter("quality = 1 and toxic = 0")
    assert module.score(docs, module.train(docs, one_class)).count() == docs.count()


def test_labels_left_out_are_not_learned_from(spark):
    docs, labels, _ = labelled(spark, 60)
    sample = common.labelled_sample(docs, labels, "toxic", 5, 0, 1000)
    texts = {bytes(r.text) for r in sample.collect()}
    out = {bytes(r.text) for r in common.texts_of(docs).collect() if held_out(r.doc_id, 5, 0) and r.text is not None}
    assert texts and not texts & out
    assert common.labelled_sample(docs, labels, "toxic", 5, 0, 20).count() < 40


def test_misspelled_insults_share_their_parts():
    made = random.Random(5)
    texts, marks = [], []
    for i in range(400):
        line = words(i, 30)
        if i % 4 == 0:
            line[made.randrange(30)] = INSULTS[i % 3]
        texts.append(" ".join(line))
        marks.append(float(i % 4 == 0))
    model = toxicity.fit(texts, np.array(marks), np.ones(400))
    plain = " ".join(words(9_001, 10))
    clean, wrong = model.score([plain, plain + " numbskulll"])
    assert wrong > 3 * clean
    assert model.score([""])[0] < 0.5


def test_subword_means_equal_a_plain_loop():
    random_pull = np.random.default_rng(0).normal(size=toxicity.BUCKETS)
    text = "ab größe a xyz-abcdefghijk 42".lower().encode()
    found = toxicity._Words.of(text)
    spelled = [bytes(found.data[a:b]) for a, b in zip(found.starts, found.ends)]
    assert spelled == ["ab".encode(), "größe".encode(), b"a", b"xyz", b"abcdefghijk", b"42"]
    for word, pull in zip(spelled, found.pulls(random_pull)):
        marked = np.frombuffer(b" " + word + b" ", np.uint8)
        buckets = []
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                code = sum(int(toxicity._CODES[k][marked[i + k]]) for k in range(n)) & 0xFFFFFFFF
                buckets.append(int(toxicity._bucket(np.array([code], np.uint32))[0]))
        assert pull == pytest.approx(random_pull[buckets].mean() if buckets else 0.0)


def test_additive_model_finds_an_interaction():
    rows = np.random.default_rng(1).uniform(size=(3000, 3))
    marks = ((rows[:, 0] > 0.5) != (rows[:, 1] > 0.5)).astype(float)
    model = quality._Trainer(rows[:2000], marks[:2000], np.ones(2000)).train()
    assert ((model.score(rows[2000:]) > 0.5) == marks[2000:]).mean() > 0.93
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}


def test_features_of_odd_texts():
    table = quality.features(pa.array([None, b"", b" ", b"a a a a", "É".encode()], pa.binary()))
    assert table.shape == (5, len(quality.FEATURES)) and np.isfinite(table).all()
    assert not table[:2].any()
    assert table[3][quality.FEATURES.index("same_as_previous")] == 0.75


def test_pseudo_likelihood(spark):
    """Real order scores better than shuffled order, and better than single-word shares."""
    order = [f"w{i}" for i in range(40)]
    made = random.Random(0)
    rows = []
    for i in range(300):
        start = made.randrange(40)
        rows.append((i, " ".join(order[(start + k) % 40] for k in range(60))))
    docs = frame(spark, rows)
    vocabulary = lm_score.vocabulary(docs)
    network = lm_score.train(docs, vocabulary, rounds=4, stride=2, step_rows=64)
    shuffled = rows[0][1].split()
    made.shuffle(shuffled)
    asked = rows[:1] + [(1000, " ".join(shuffled)), (1001, ""), (1002, None), (None, "w1 unheard"), (None, "w1 unheard")]
    got = lm_score.score(frame(spark, asked), vocabulary, network).collect()
    means = {r.doc_id: r.mean_log_likelihood for r in got}
    assert means[0] > means[1000] and means[0] > np.log(1 / 40)
    assert [(r.n_words, r.log_likelihood, r.mean_log_likelihood) for r in got if r.doc_id in (1001, 1002)] == [(0, 0.0, None)] * 2
    assert len([r for r in got if r.doc_id is None and r.n_words == 2]) == 2
    assert lm_score.score(docs.limit(0)).count() == 0


def test_pseudo_likelihood_equals_a_plain_loop():
    texts = pa.array([b"a b c a", b"", b"zz a"], pa.binary())
    hashes = np.unique(common.hashed_words(pa.array([b"a b c"], pa.binary()))[0])
    vocabulary = lm_score.Vocabulary(hashes, np.ones(1 << lm_score.RARE_BITS))
    network = lm_score.Network()
    counts, sums = lm_score.pseudo_likelihood(texts, vocabulary, network)
    assert counts.tolist() == [4, 0, 2]
    p = network.parts
    for text, total in zip(texts.to_pylist(), sums):
        found = common.hashed_words(pa.array([text], pa.binary()))[0]
        numbers = [lm_score.EDGE] * 2 + vocabulary.numbers(found).tolist() + [lm_score.EDGE] * 2
        plain = 0.0
        for i, word in enumerate(found, 2):
            around = np.concatenate([p["embed"][numbers[k]] for k in (i - 2, i - 1, i + 1, i + 2)])
            hidden = np.tanh(around @ p["mix"] + p["mix_bias"])
            group, member = numbers[i] % lm_score.CLASSES, numbers[i] // lm_score.CLASSES
            for scores, at in ((hidden @ p["class"] + p["class_bias"], group), (hidden @ p["member"][group] + p["member_bias"][group], member)):
                plain += scores[at] - np.log(np.exp(scores).sum())
            if numbers[i] == lm_score.RARE:
                plain += vocabulary.rare(found[i - 2 : i - 1])[0]
        assert total == pytest.approx(plain, abs=1e-4)


def test_every_word_is_predicted_from_both_sides(spark):
    """Words beyond the vocabulary, however many, follow their neighbours and tell on them."""
    vocabulary_size, made = lm_score.CLASSES * lm_score.MEMBERS, random.Random(0)
    common_words = [f"c{i}" for i in range(vocabulary_size)]
    rows = []
    for i in range(400):  # "x" is followed by rare words in -ing, "y" by rare words in -ed
        line = []
        for k in range(30):
            left, tail = made.choice([("x", "ing"), ("y", "ed")])
            line += [left, "".join(made.choice("abcdefgh") for _ in range(4)) + tail, left]
        rows.append((i, " ".join(line + [c for c in common_words for _ in range(2)] * (i == 0))))
    docs = frame(spark, rows)
    vocabulary = lm_score.vocabulary(docs)
    network = lm_score.train(docs, vocabulary, rounds=4, rate=0.5, stride=2, step_rows=64)

    def total(text):
        return lm_score.pseudo_likelihood(pa.array([text.encode()], pa.binary()), vocabulary, network)[1][0]

    fit = total("x abcding x") - total("y abcding y")
    plain = total("x abcding x") - total("x abcded x") + total("y abcded y") - total("y abcding y")
    assert fit > 0 and plain > 1
    # Neighbours outside the vocabulary are not one symbol.
    assert total("abcding x hgfeing") != total("bbcding x hgfeing")
    # The spelling is a distribution: over all first bytes, and over the first bytes that follow.
    hidden = np.random.default_rng(0).normal(size=(256, lm_score.HIDDEN)).astype(np.float32)[[0] * 256]
    for past in (0, 77):
        chances = np.zeros(256)
        for _, at, half, logs in network._halves(hidden, vocabulary.spelling, np.arange(256), np.full(256, past)):
            chances[at] += logs[np.arange(len(at)), half]
        assert np.exp(chances).sum() == pytest.approx(1, abs=1e-4)


def test_letters_of_words():
    texts = pa.array([b" Ab  c", b"", None, "dÉ".encode(), b"x"], pa.binary())
    assert len(common.hashed_words(texts)[0]) == 4
    letters = lm_score.Letters.of(texts.slice(0), np.array([True, False, True, True]))
    spelled = [bytes(letters.values[f : f + n]) for f, n in zip(letters.first, letters.count)]
    assert spelled == [b"ab ", "dÉ ".encode(), b"x "]
    assert letters.past[0] == letters.past[3] == letters.past[letters.first[2]]
    found = [(p.tolist(), o.tolist()) for p, o in letters.pieces(np.array([2, 0]))]
    assert found == [([letters.first[2], letters.first[2] + 1, 0, 1, 2], [0, 0, 1, 1, 1])]


def test_rounds_learn_from_every_position():
    """With the registered rounds and stride, whichever batch a text is in."""
    text = np.repeat(np.arange(4), [1, 700, 0, 40])
    for cut in (0, 1, 701):
        seen = [p + a for a, part in ((0, text[:cut]), (cut, text[cut:])) for t in range(lm_score.ROUNDS) for p in lm_score._turn(part, t, lm_score.STRIDE)]
        assert sorted(seen) == list(range(len(text)))


def test_licence_notices(spark):
    told = {
        1: ("some words\nReleased under the MIT License.\nmore", "MIT", 1),
        2: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 0),
        3: ("a\n\nLicensed under CC BY-NC 4.0.", "CC-BY-NC", 2),
        4: ("Licensed under the Apache License, Version 2.0.\n" + " ".join(words(4, 2000)), "Apache-2.0", 0),
        5: (" ".join(words(5, 200)) + " Licensed under the Apache License, Version 2.0. " + " ".join(words(6, 200)), "Apache-2.0", 0),
    }
    plain = [(i, t) for i, t in corpus()] + [(500, "All rights reserved."), (501, "The driver needs a valid license to rent the car.")]
    docs = frame(spark, [(-i, t) for i, (t, _, _) in told.items()] + plain)
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.licence_notices(docs).collect()}
    assert got == {(-i, line, family) for i, (_, family, line) in told.items()}
    assert licenses.licence_notices(docs.limit(0)).count() == 0


def test_every_notice_of_a_line_is_found(spark):
    """Two notices far apart, with a decoy that is more certain than both; and two in one passage."""
    decoy = "mozilla mozilla 2.0 mozilla " * 30
    gpl, apache = "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0."
    line = " ".join([*words(1, 100), gpl, *words(2, 150), decoy, *words(3, 100), apache, *words(4, 100)])
    docs = frame(spark, [(-1, line), (-2, f"{gpl} Released under the MIT License."), (-3, decoy), *corpus()])
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.licence_notices(docs).collect())
    assert got == [(-2, 0, "GPL-3.0"), (-2, 0, "MIT"), (-1, 0, "Apache-2.0"), (-1, 0, "GPL-3.0")]


def test_background_lines_come_from_whole_texts_and_repeat(spark):
    rows = [(i, "\n".join(f"line {i} {k} " + "w " * 60 * (k == 99) for k in range(100))) for i in range(20)]
    rows += [(100 + i, "the same line\n" * 50) for i in range(30)] + [(200, None), (201, ""), (202, " \n\t\n")]
    docs = frame(spark, rows)
    found = licenses.background(docs, 300)
    # Long lines can give equal passages.
    assert found == licenses.background(docs.repartition(9), 300) and 280 < len(found) == len(set(found)) <= 300
    places = [int(p.split()[2]) for p in found if p.startswith("line")]
    assert sum(p >= 40 for p in places) > 100
    everything = licenses.background(docs, 5000)
    assert 1981 < len(everything) <= 2001 and "the same line" in everything
    assert max(len(p.split()) for p in everything) == licenses.PASSAGE
    assert licenses.background(docs.limit(0)) == []


def test_samples_are_of_present_and_short_documents(spark):
    docs = frame(spark, [(i, "word " * (40 if i % 7 else 9000)) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4000)], "doc_id long, quality int, toxic int")
    sample = common.labelled_sample(docs, labels, "toxic", 5, 0, 150, 1000)
    usable = [i for i in range(400) if i % 7 and not held_out(i, 5, 0)]
    assert len(usable) > 150 and 110 < sample.count() < 190
    assert all(len(r.text) <= 1000 for r in sample.collect())
    # Without a bound on bytes, the labels of all present documents are used where they are few.
    assert common.labelled_sample(docs, labels, "toxic", 5, 0, 10_000).count() == sum(not held_out(i, 5, 0) for i in range(400))


def test_table_scores_equal_a_plain_loop():
    made = np.random.default_rng(2)
    rows = np.round(made.normal(size=(600, 4)), 2)
    marks = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0)).astype(float)
    model = quality._Trainer(rows, marks, np.ones(600)).train()
    assert model.pairs
    asked = np.vstack([made.normal(size=(40, 4)) * 3, rows[:20], [[c[0] for c in model.cuts]]])
    for row, found in zip(asked, model.score(asked)):
        total = model.intercept
        for value, cuts, table in zip(row, model.cuts, model.tables):
            total += table[sum(c <= value for c in cuts)]
        for a, b, cuts_a, cuts_b, table in model.pairs:
            total += table[sum(c <= row[a] for c in cuts_a)][sum(c <= row[b] for c in cuts_b)]
        assert found == pytest.approx(1 / (1 + np.exp(-total)))


def test_worst_passages_equal_a_plain_loop():
    made = np.random.default_rng(3)
    model = toxicity.ToxicityModel(made.normal(size=(toxicity.BUCKETS, 2)), made.normal(size=(2, 2)), np.array([0.1, 0.4]))
    texts = ["", "one", "Two words", "a b c d e", "it's  \n odd--x. Ünï " * 3, "x" * 300, " ".join(f"w{i}" for i in range(41)), "..."]
    for text, found in zip(texts, model.score(texts)):
        words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.lower()).split()
        pulls = [float(toxicity._Words.of(w.encode()).pulls(model.pull)[0]) for w in words]
        size = toxicity.PASSAGE_WORDS
        worst = max((sum(pulls[i : i + size]) / size for i in range(0, len(pulls), size)), default=0.0)
        assert found == pytest.approx(1 / (1 + np.exp(-(worst + model.offset))))
