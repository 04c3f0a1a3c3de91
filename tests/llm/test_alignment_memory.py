"""What a worker of op12 holds is bounded by the size of a piece, and results don't depend on it."""

import tracemalloc

import pyarrow as pa

from packetloom.llm import alignment as al
from .test_alignment import texts


def block(n):
    rows = texts(3, n)
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], ["doc_id", "text"])


def test_blocks_are_the_same_whatever_the_pieces():
    tokens, part = al.load(*al._paths(None, None)), block(300)
    whole, small = (al.aligned_block(tokens, part, size) for size in (1 << 30, 40))
    assert [c.to_pylist() for c in small[0]] == [c.to_pylist() for c in whole[0]]
    assert all(bytes(x) == bytes(y) for x, y in zip(small[1:], whole[1:], strict=True)) and len(whole[2]) > 100


def test_a_block_takes_little_more_memory_than_its_pieces():
    tokens = al.load(*al._paths(None, None))
    part = block(30_000)
    while sum(len(t.encode()) for t in part.column("text").to_pylist()) < al.BLOCK_BYTES:
        part = pa.RecordBatch.from_arrays([pa.concat_arrays([c, c]) for c in part.columns], part.schema.names)
    al.aligned_block(tokens, part.slice(0, 100), al.PIECE_BYTES)
    tracemalloc.start()
    try:
        al.aligned_block(tokens, part, al.PIECE_BYTES)
        n = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n < 30 * part.column("text").nbytes, n / part.column("text").nbytes


def test_the_library_is_made_for_the_first_text_that_needs_it():
    tokens = al.Tokens(*al._paths(None, None))
    assert "library" not in vars(tokens.a)
    text = "a\U000e0fff<|endoftext|>"  # an unassigned code point goes to the library; a special token's string is text
    ids = tokens.encode([text])[0][0]
    assert "library" in vars(tokens.a) and b"".join(tokens.a_bytes[i] for i in ids.tolist()) == (" " + text).encode() and len(ids) > 6
