import public_tokenizers
import pytest
from edges import corpus, frame

from studylattice.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_every_id_is_packed_once(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    pieces = packing.pack(frame(spark, rows), PATH).collect()
    wanted = dict(zip([i for i, _ in rows], ids_of([t for _, t in rows])))
    for doc_id, ids in wanted.items():
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        at = 0
        for p in own:
            assert p.start == at and p.length == len(p.ids) // 4 > 0 and p.doc_tokens == len(ids)
            found = [int.from_bytes(p.ids[k : k + 4], "little") for k in range(0, len(p.ids), 4)]
            assert found == ids[at : at + p.length]
            at += p.length
        assert at == len(ids)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        # Full, or a power of two: nothing is padded.
        assert at == 1024 or (at < 1024 and at & (at - 1) == 0)


def test_nulls_repeats_and_empty_table(spark):
    pieces = packing.pack(frame(spark, [(None, None), (1, None), (1, None), (2, "a")]), PATH).collect()
    assert sorted((p.doc_id or -1, p.doc_tokens) for p in pieces) == [(-1, 1), (1, 1), (1, 1), (2, 2)]
    assert packing.pack(frame(spark, []), PATH).count() == 0


ODD = ["", " ", "a  b", " a", "a ", "a\n \nb", "a \n b", "x\t y", "a   b", "\n \n", "it's  ok 's", "<|endoftext|> a <|endoftext|>b", "tab\t b", "a  b", "\x1c \x1c"]


@pytest.mark.parametrize("text", ODD + ["é" * 200, "a" * 5000, "1 2 33 444"])
def test_cached_words_give_the_ids_of_the_whole_text(text):
    encoder = packing.Encoder(PATH)
    for _ in range(2):
        found = encoder.encode([text, "some words", text])
        assert [list(memoryview(f).cast("I")) for f in found] == [i[:-1] for i in ids_of([text, "some words", text])]


@pytest.mark.parametrize("sizes", [[5], [10, 9, 8, 1, 1, 1], list(range(1, 11)) * 3])
def test_first_fit_decreasing(sizes):
    """The tree gives the bins of the plain search from the left."""
    plain = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        spot = next((b for b in plain if sum(sizes[i] for i in b) + sizes[item] <= 10), None)
        if spot is None:
            plain.append(spot := [])
        spot.append(item)
    assert packing.first_fit_decreasing(sizes, 10) == plain
    packed = packing.pack_group(sizes, 10)
    assert sorted((i, k) for s in packed for i, start, n in s for k in range(start, start + n)) == [
        (i, k) for i, n in enumerate(sizes) for k in range(n)
    ]
