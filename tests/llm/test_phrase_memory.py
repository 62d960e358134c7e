"""What a worker of the collocations holds beside its batch."""

import random
import tracemalloc

import pyarrow as pa

from tracekit.llm import collocations


def test_words_of_a_large_batch():
    draw = random.Random(3)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8))) for _ in range(40000)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 70, pa.binary()), pa.array(["en"] * 70), pa.array([0] * 70, pa.int32())], ["text", "lang", "shard"])
    tracemalloc.start()
    total = sum(w.size for _, _, w, *_ in collocations._words(batch, shards=True))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert total == 70 * 40000
    assert peak < 140e6, peak
