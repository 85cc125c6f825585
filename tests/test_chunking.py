import random

import pytest

from lexigrid.errors import ConfigError
from lexigrid.operators.chunking import fixed_windows, recursive_chunks, recursive_spans

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def slow(text, size, overlap, separators=SEPARATORS):
    """The cascade written as its definition says, with lists of words instead of offsets in flight."""
    if len(text) <= size:
        return [(0, len(text))] if text.strip() else []
    for n, sep in enumerate(separators):
        if sep and sep in text:
            break
    else:
        out = []
        for at in range(0, len(text), max(1, size - overlap)):
            if text[at : at + size].strip():
                out.append((at, min(at + size, len(text))))
            if at + size >= len(text):
                break
        return out
    pieces, at = [], 0
    for piece in text.split(sep):
        pieces.append((at, at + len(piece)))
        at += len(piece) + len(sep)
    out, held = [], []

    def close():
        a, b = held[0][0], held[-1][1]
        rest = separators[n + 1 :] if b - a > size else separators
        out.extend((a + x, a + y) for x, y in slow(text[a:b], size, overlap, rest))

    for piece in pieces:
        if held and piece[1] - held[0][0] > size:
            close()
            tail, room = [], overlap
            for p in reversed(held):
                room -= p[1] - p[0] + len(sep)
                if room < 0 or overlap <= 0:
                    break
                tail.insert(0, p)
            held[:] = tail
        held.append(piece)
    close()
    return out


@pytest.mark.parametrize("seed", range(6))
def test_worklist_equals_the_definition(seed):
    r = random.Random(seed)
    for _ in range(300):
        text = "".join(r.choice(["a", "bc", " ", "  ", ". ", "\n", "\n\n", "word", "longerword"]) for _ in range(r.randint(0, 60)))
        size = r.randint(2, 40)
        overlap = r.choice([0, size // 4, size - 1])
        spans = recursive_spans(text, size, overlap)
        assert spans == slow(text, size, overlap), (text, size, overlap)
        assert all(text[a:b].strip() and b - a <= size for a, b in spans)


def test_chunks_hold_their_span(spark):
    text = "One two.\n\nThree é🙂 four. Five " * 30
    docs = spark.createDataFrame([("d", "s", text), ("e", "t", ""), ("b", "u", " \n ")], "document_id string, source string, content string")
    for chunks in (recursive_chunks(docs, 50, 10), fixed_windows(docs, 50, 10)):
        rows = chunks.orderBy("chunk_index").collect()
        assert {r.document_id for r in rows} == {"d"} and [r.chunk_index for r in rows] == list(range(len(rows)))
        assert all(r.content == text[r.start_offset : r.end_offset] for r in rows)
        assert len({r.chunk_id for r in rows}) == len(rows)


def test_fixed_windows_end_at_the_first_that_reaches_the_end(spark):
    docs = spark.createDataFrame([("d", "s", "x" * 25)], "document_id string, source string, content string")
    assert [(r.start_offset, r.end_offset) for r in fixed_windows(docs, 10, 5).orderBy("start_offset").collect()] == [(0, 10), (5, 15), (10, 20), (15, 25)]
    with pytest.raises(ConfigError):
        fixed_windows(docs, 10, 10)
