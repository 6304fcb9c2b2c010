"""What a Python worker holds while it decodes: one batch of rows, whatever number the files of an Arrow batch make."""

import tracemalloc

import pyarrow as pa
import pytest

from plumbline.plans import formats

SCHEMA = {
    formats._reverse_index: ("grp long, ord long, pos long, fault string", 256),
    formats._reflog: ("grp long, line long, old string, new string, at long", 100),
    formats._pack_index: ("grp long, pos long, oid string, off long, crc long, fault string", 256),
    formats._commit_graph: ("grp long, pos long, oid string, tree string, parents string, generation long, date long", 64),
}


def decoded(make, schema, size, groups):
    fields = [tuple(f.split()) for f in schema.split(", ")]
    keys = pa.array([list(range(g * size, (g + 1) * size)) for g in range(groups)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(groups), pa.int64()), keys], names=["grp", "keys"])
    return formats._batches((out for row in formats._rows([batch]) for out in make(*row)), fields)


@pytest.mark.parametrize("make", SCHEMA, ids=lambda f: f.__name__)
def test_a_worker_holds_one_batch(make):
    schema, size = SCHEMA[make]
    few, many = (list(map(lambda b: b.num_rows, decoded(make, schema, size, n))) for n in (1, 30_000 // size))
    assert sum(few) > 0 and len(many) > 3 and max(many) <= formats._OUT
    peaks = []
    for groups in (15_000 // size, 60_000 // size):
        batches = decoded(make, schema, size, groups)
        tracemalloc.start()
        for _ in batches:
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


def test_no_rows_no_batches():
    assert list(formats._batches([], [("a", "long")])) == []
