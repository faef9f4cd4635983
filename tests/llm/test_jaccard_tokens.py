"""First-level buckets hold nodes that share a min-hash, not those that happen to share 16 bits of it."""

import random

import numpy as np
import pyarrow as pa

from tabulon.llm import jaccard_join as J


def test_buckets_of_unlike_nodes_stay_empty():
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(6)) for _ in range(20_000)]
    texts += [t + " more" for t in texts[:50]]
    order = J.first_coordinates()
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc_id", "key", "text"])
    (out,) = J._sketches(iter([batch]), J.GRAM, order)
    (rows,) = J._roots(iter([pa.RecordBatch.from_arrays([out.column(2), out.column(5)], names=["node", "tokens"])]), order)
    path, node = rows.column(0).to_numpy(), rows.column(2).to_numpy()
    assert len(path) == len(texts) * len(order)
    _, which, size = np.unique(path, return_inverse=True, return_counts=True)
    shared = set(node[size[which] > 1].tolist())
    pairs = out.column(2).to_pylist()
    pairs = set(pairs[:50]) | set(pairs[20_000:])
    assert len(shared & pairs) > 50
    assert len(shared - pairs) < 20  # by 16 bits nearly every node shares a bucket
