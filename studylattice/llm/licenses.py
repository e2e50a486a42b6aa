"""Licence notices: a trained paragraph classifier over word n-grams.

A multinomial logistic regression over hashed word n-grams tells licence families apart, and from
paragraphs that are no notice. Its probabilities are calibrated on paragraphs it was not trained on; what
stays below one half is unknown. A predicted family is confirmed by comparing the paragraph with the
family's templates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylattice.llm.common import batches_of, hashed_words, shingles, texts_of

# At most so many passages of all lines, each of at most so many characters, are the paragraphs without a
# notice that training needs.
BACKGROUND_PARAGRAPHS, BACKGROUND_CHARS = 4_000, 2_000
BITS, GRAMS = 16, 3
# Longer paragraphs are read as overlapping passages of this many words.
PASSAGE, STEP = 48, 24
VARIANTS, EPOCHS, RATE, DECAY = 40, 60, 0.5, 1e-5
CONFIRMED = 0.6
UNKNOWN = "unknown"

# Usual notices of each family.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0 license", "GNU General Public License v3.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0 license", "GNU General Public License v2.0"],
    "LGPL": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU LGPL"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-clause BSD license", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "ISC": ["ISC License"],
    "Unlicense": ["Unlicense"],
    "CC0": ["CC0 1.0 Universal", "Creative Commons Zero 1.0", "CC0 1.0"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC BY 3.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
PHRASES = [
    "Licensed under the {}.",
    "Licensed under {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "Released under the {}.",
    "Released under {}.",
    "This project is distributed under the terms of the {}.",
    "Use of this source code is governed by the {}.",
    "SPDX-License-Identifier: {}",
]
TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ],
    "GPL-2.0": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Sentences that share words with notices but are none.
DECOYS = [
    "All rights reserved.",
    "The driver needs a valid license to rent the car.",
    "Permission to enter the building is granted by the office.",
    "This version of the report was released under the new editor.",
    "The general public is invited to the work of the foundation.",
    "The terms of the agreement are under review.",
]
FAMILIES = [*NAMES, UNKNOWN]

_CLEAN = bytes(32 if b < 128 and chr(b) in "!\"#$%&'()*,/:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def templates() -> list[tuple[str, str]]:
    """(family, notice) of every family and phrase, and the standard texts."""
    made = [(family, phrase.format(name)) for family, names in NAMES.items() for name in names for phrase in PHRASES]
    return made + [(family, text) for family, texts in TEXTS.items() for text in texts]


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of some texts and, per passage, its first and end word, paragraph and text.

    A paragraph is a line; its number counts all lines of the text. Punctuation is set aside, and so is
    a full stop at the end of a word.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    base = int(offsets[0])
    data = (texts.buffers()[2].to_pybytes() if texts.buffers()[2] else b"")[base : int(offsets[-1])]
    data, offsets = data.translate(_CLEAN).replace(b". ", b"  ").replace(b".\n", b" \n"), offsets - base
    array = np.frombuffer(data, np.uint8).copy()
    last = offsets[1:][np.diff(offsets) > 0] - 1
    array[last[array[last] == 46]] = 32
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(array == 10) + 1]))
    lines = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(array)]
    )
    hashes, bounds = hashed_words(lines)
    text_of = np.searchsorted(offsets, cuts[:-1], "right") - 1
    paragraph = np.arange(len(text_of)) - np.searchsorted(cuts, offsets[:-1])[text_of]
    counts = np.diff(bounds)
    many = np.where(counts > 0, np.maximum(1, -(-(counts - PASSAGE) // STEP) + 1), 0)
    owner = np.repeat(np.arange(len(counts)), many)
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = bounds[:-1][owner] + within * STEP
    end = np.minimum(first + PASSAGE, bounds[1:][owner])
    return hashes, first, end, paragraph[owner], text_of[owner]


def _buckets(hashes: np.ndarray) -> list[np.ndarray]:
    """For each n-gram length, the bucket of the n-gram that begins at every word."""
    whole = np.array([0, len(hashes)])
    return [
        (shingles(hashes, whole, n)[0] >> np.uint64(64 - BITS)).astype(np.int64) if len(hashes) >= n else np.empty(0, np.int64)
        for n in range(1, GRAMS + 1)
    ]


class LicenceModel:
    """Weights by bucket and family, biases, and the temperature of the calibration."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.weights, self.bias, self.temperature = weights, bias, temperature
        self.known = weights.any(1)

    def logits(self, hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A row of scores for each passage; the sums of its n-grams come from running sums."""
        total = np.zeros((len(first), len(self.bias)))
        used = np.zeros(len(first))
        for n, buckets in enumerate(_buckets(hashes), 1):
            stop = np.maximum(end - n + 1, first)
            used += stop - first
            # Only n-grams that the model knows cost a sum over all families.
            known = np.flatnonzero(self.known[buckets])
            sums = np.zeros((len(known) + 1, len(self.bias)))
            np.cumsum(self.weights[buckets[known]], 0, out=sums[1:])
            total += sums[np.searchsorted(known, stop)] - sums[np.searchsorted(known, first)]
        return total / np.sqrt(np.maximum(used, 1))[:, None] + self.bias

    def probabilities(self, *passage: np.ndarray) -> np.ndarray:
        scores = self.logits(*passage) / self.temperature
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def _encoded(texts: list[str]) -> pa.Array:
    return pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary())


def _pair_set(text: str) -> frozenset[int]:
    hashes, *_ = passages(_encoded([text.replace("\n", " ")]))
    return frozenset(shingles(hashes, np.array([0, len(hashes)]), 2)[0].tolist())


def _template_pairs() -> dict[str, list[frozenset[int]]]:
    found: dict[str, list[frozenset[int]]] = {}
    for family, notice in templates():
        found.setdefault(family, []).append(_pair_set(notice))
    return found


def similarity(words: np.ndarray, notices: list[frozenset[int]], whole: bool = False) -> float:
    """The largest share of a notice's word pairs, or unless ``whole`` of the passage's, that both have."""
    pairs = set(shingles(words, np.array([0, len(words)]), 2)[0].tolist())
    best = 0.0
    for notice in notices:
        shared = len(pairs & notice)
        best = max(best, shared / len(notice), shared / max(len(pairs), 1) if len(pairs) >= 3 and not whole else 0.0)
    return best


def _around(words: np.ndarray, notices: list[frozenset[int]]) -> list[np.ndarray]:
    """What is left of a passage before and after the place that has most of one of the notices."""
    pairs = shingles(words, np.array([0, len(words)]), 2)[0].tolist()
    places = []
    for notice in notices:
        hits = np.cumsum([0, *(p in notice for p in pairs)])
        start = np.arange(max(len(pairs) - len(notice), 0) + 1)
        end = np.minimum(start + len(notice), len(pairs))
        at = int((hits[end] - hits[start]).argmax())
        shared = int(hits[end[at]] - hits[at])
        places.append((shared / len(notice), shared, at, int(end[at]) + 1))
    *_, start, end = max(places)
    return [words[:start], words[end:]]


def _confirmed(
    model: LicenceModel, notices: dict[str, list[frozenset[int]]], hashes: np.ndarray, first: np.ndarray, end: np.ndarray, owners: list
) -> dict[tuple, tuple[float, float]]:
    """By owner and family, the probability and similarity of the most certain passage that a template confirms.

    What is around a confirmed notice is looked at again, so that one passage can hold several. There
    a template must be found itself; that the rest is part of one does not count.
    """
    best: dict[tuple, tuple[float, float]] = {}
    again = False
    while len(first):
        chances = model.probabilities(hashes, first, end)[:, :-1]
        rests = []
        for at in np.flatnonzero(chances.max(1) >= 0.5):
            family, words = int(chances[at].argmax()), hashes[first[at] : end[at]]
            own, chance = notices[FAMILIES[family]], float(chances[at].max())
            likeness = similarity(words, own, again)
            if likeness >= CONFIRMED:
                key = (owners[at], family)
                best[key] = max(best.get(key, (0.0, 0.0)), (chance, likeness))
                rests += [(owners[at], rest) for rest in _around(words, own) if len(rest) > 2]
        owners, again = [owner for owner, _ in rests], True
        bounds = np.cumsum([0, *(len(rest) for _, rest in rests)])
        hashes = np.concatenate([rest for _, rest in rests]) if rests else hashes[:0]
        first, end = bounds[:-1], bounds[1:]
    return best


def fit(background: list[str]) -> LicenceModel:
    """Train on templates with words left out or put around them, and on background paragraphs."""
    random = np.random.default_rng(0)
    filler = [w for p in background for w in p.split()[:40]][:20_000] or ["the", "of", "and"]
    notices = _template_pairs()
    everything = [pairs for found in notices.values() for pairs in found]
    texts, families = [], []
    made = templates()
    for family, notice in made:
        per = max(2, VARIANTS * len(NAMES[family] + TEXTS.get(family, [])) // sum(f == family for f, _ in made))
        for variant in range(per):
            words = notice.split()
            if variant and len(words) > 8:
                words = [w for w in words if random.random() > 0.08]
            if variant % 3 == 2:
                around = [str(w) for w in random.choice(filler, 6)]
                words = around[:3] + words + around[3:]
            texts.append(" ".join(words))
            families.append(FAMILIES.index(family))
    plain = [p for p in background if p.split()]
    hashes_of = [passages(_encoded([p]))[0] for p in plain]
    plain = [p for p, h in zip(plain, hashes_of) if similarity(h[:PASSAGE], everything) < 0.3]
    for p in plain + DECOYS * 5:
        texts.append(" ".join(p.split()[:PASSAGE]))
        families.append(FAMILIES.index(UNKNOWN))
    hashes, first, end, _, text = passages(_encoded(texts))
    label = np.array(families)[text]
    rows, columns = [], []
    for n, buckets in enumerate(_buckets(hashes), 1):
        counts = np.maximum(end - n + 1 - first, 0)
        owner = np.repeat(np.arange(len(first)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
        rows.append(owner)
        columns.append(buckets[at])
    row, column = np.concatenate(rows), np.concatenate(columns)
    value = 1 / np.sqrt(np.bincount(row, minlength=len(first)))[row]
    held = random.random(len(first)) < 0.2
    target = np.eye(len(FAMILIES))[label]
    weight = np.where(held, 0.0, 1 / np.bincount(label[~held], minlength=len(FAMILIES))[label])
    weight /= weight.sum()
    buckets, column = np.unique(column, return_inverse=True)
    weights, bias = np.zeros((len(buckets), len(FAMILIES))), np.zeros(len(FAMILIES))
    square_w, square_b = np.full(weights.shape, 1e-8), np.full(bias.shape, 1e-8)

    def scores() -> np.ndarray:
        parts = [np.bincount(row, weights[column, k] * value, len(first)) for k in range(len(FAMILIES))]
        return np.stack(parts, 1) + bias

    def softmax(s: np.ndarray) -> np.ndarray:
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)

    for _ in range(EPOCHS):
        slope = (softmax(scores()) - target) * weight[:, None]
        step = np.stack([np.bincount(column, slope[row, k] * value, len(buckets)) for k in range(len(FAMILIES))], 1)
        step += DECAY * weights
        square_w += step * step
        square_b += slope.sum(0) ** 2
        weights -= RATE * step / np.sqrt(square_w)
        bias -= RATE * slope.sum(0) / np.sqrt(square_b)
    final = scores()[held]
    losses = {t: -np.log(softmax(final / t)[np.arange(held.sum()), label[held]] + 1e-12).mean() for t in (0.25, 0.5, 0.75, 1, 1.5, 2, 3)}
    table = np.zeros((1 << BITS, len(FAMILIES)), np.float32)
    table[buckets] = weights
    return LicenceModel(table, bias, min(losses, key=losses.get))


def background(docs: DataFrame, most: int = BACKGROUND_PARAGRAPHS) -> list[str]:
    """Passages of distinct lines of all texts: at most ``most``, the ones whose lines have the smallest hashes.

    A line with more than PASSAGE words gives so many of them from a place its hash decides. All lines
    are looked at; of about twenty times the wanted number the distinct ones are sorted.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    lines = texts.agg(F.coalesce(F.sum(breaks), F.lit(0))).first()[0]
    scale = 1 << 40
    share = min(scale, scale * 20 * most // max(lines, 1) + 1)
    rows = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "")
    drawn = rows.withColumn("draw", F.xxhash64("line")).filter(F.pmod("draw", F.lit(scale)) < share).distinct()
    words = F.split(F.trim("line"), "[\\x20\\x09-\\x0D]+")
    first = F.pmod(F.shiftrightunsigned("draw", 20), F.greatest(F.size("words") - PASSAGE + 1, F.lit(1)).cast("long"))
    passage = F.array_join(F.slice("words", first.cast("int") + 1, PASSAGE), " ")
    found = drawn.orderBy(F.pmod("draw", F.lit(scale)), "line").limit(most).withColumn("words", words)
    return sorted({r[0] for r in found.select(F.substring(passage, 1, BACKGROUND_CHARS)).collect()})


def train(docs: DataFrame) -> LicenceModel:
    """The model, with at most BACKGROUND_PARAGRAPHS passages of ``docs`` as background."""
    return fit(background(docs))


def licence_notices(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Paragraphs of ``docs`` (doc_id, text) that are licence notices.

    Returns doc_id, paragraph (its line in the text, from 0), family, probability and similarity with the
    family's templates. A paragraph has a row for every family that is found in it, by the most certain of
    its passages that a template confirms. What the classifier does not give an even chance, and what no
    template confirms, is unknown and not returned.

    A null or empty text has no notices; a null doc_id is kept; repeated rows are reported as often as
    they occur; other columns are ignored; an empty table gives an empty result.
    """
    model = model if model is not None else train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    notices = _template_pairs()
    names = ["doc_id", "paragraph", "family", "probability", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", 1 << 20):
                hashes, first, end, paragraph, text = passages(batch["text"])
                if not len(first):
                    continue
                best = _confirmed(shared.value, notices, hashes, first, end, list(zip(text.tolist(), paragraph.tolist())))
                rows = [
                    (batch["doc_id"][row].as_py(), line, FAMILIES[family], chance, likeness)
                    for ((row, line), family), (chance, likeness) in sorted(best.items())
                ]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "doc_id long, paragraph long, family string, probability double, similarity double"
    return texts_of(docs).mapInArrow(run, schema)
