"""What a Python worker holds at once of a batch of texts, beyond the batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from lakemill.llm import quality_lines as Q
from lakemill.llm import similar as S
from tests.llm.corpus import prose


def peak_mb(batches):
    tracemalloc.start()
    try:
        for _ in batches:
            pass
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_pieces_bound_memory():
    """A batch of 8.6 MB: pieces of 2 MB took 120 MB for SimHashes and 44 MB for line marks."""
    rnd = random.Random(1)
    some = [prose(rnd, 600) + "\n" + prose(rnd, 200) for _ in range(60)]
    texts = pa.array([some[k % 60] for k in range(2400)])
    ids = pa.array(np.arange(len(texts)))
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], names=["row", "id", "text"])
    assert peak_mb(S._prefixes(iter([batch]), np.zeros(0, dtype=np.uint64))) < 60
    new = {c: pa.nulls(len(texts)) for c in Q.NEW}
    batch = pa.RecordBatch.from_arrays([ids, texts, *new.values()], names=["doc_id", "text", *new])
    assert peak_mb(Q._label(iter([batch]), "text", None)) < 22
