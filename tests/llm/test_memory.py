"""What a Python worker takes for the texts of a batch."""

import tracemalloc

import pyarrow as pa
import pytest

from kinstats.llm import common, debruijn, packing, similar


class Given:
    """Stands for a frame; hands back the function that an operator has for its batches."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def batch_of(texts, **more):
    n = len(texts)
    return pa.RecordBatch.from_pydict({"doc": pa.array(range(n), pa.int64())} | more | {"text": pa.array(texts, pa.string())})


def peak_mb(run, batch):
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in run(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def texts():
    """8 MB, no word twice."""
    return [" ".join(f"w{k}x{i}" for i in range(400)) for k in range(2000)]


def test_sizes_of_pieces_are_found_without_copies_of_the_texts():
    batch = batch_of(["x" * 10_000] * 1000 + [None, "", "é" * 600_000])
    tracemalloc.start()
    sizes = [x.num_rows for x in common.pieces(batch, "text", 1 << 20)]
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sizes == [104] * 9 + [66, 1] and most < 2  # the two empty texts go with the last 64, the one of 1.2 MB alone


def test_removal_of_spans_takes_a_megabyte_of_text_at_a_time(texts):
    rows, most = peak_mb(debruijn.occurrences(Given(), 20), batch_of(texts, t=pa.array([0] * len(texts), pa.int64())))
    assert rows > len(texts) and most < 70


def test_packing_forgets_words():
    import public_tokenizers

    ids = packing.word_ids(public_tokenizers.path("word_bpe_49k.json"), 100_000)
    for k in range(0, 180_000, 20_000):
        ids.of([b" ".join(b"a%d" % i for i in range(k, k + 20_000))])
    assert len(ids.ids) <= 120_000


def test_near_dedup_takes_a_megabyte_of_text_at_a_time(texts):
    run = similar.sketches(Given(), 5, 10)
    assert len(list(run(iter([batch_of(texts)])))) >= 7
