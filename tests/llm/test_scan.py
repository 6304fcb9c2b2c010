import subprocess
import sys

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import textscan as ts

texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab \t\n\r\x0b\x0c\x1f é漢A")), max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_and_lines(values):
    for part in ts.slices(pa.array(values, pa.string())):
        data = part.buf.tobytes()
        starts, ends, first = part.words()
        a, b, line = part.lines()
        for i in range(part.n_docs):
            raw = (values[part.first + i] or "").encode()
            assert [data[x:y] for x, y in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == raw.split()
            assert [data[x:y] for x, y in zip(a[line[i] : line[i + 1]], b[line[i] : line[i + 1]])] == raw.split(b"\n")


def test_equal_spans_hash_alike_and_unlike_ones_differ():
    words = [b"a", b"b", b"ab", b"ba", b"a\0", b"x" * 255, b"x" * 256, b"x" * 257, b"x" * 300_000, b"12345678", b"123456781", b"12345678\0"]
    for n in (256, 1024, 4096):  # words whose difference vanishes in every polynomial modulo a power of two
        signs = np.array([bin(i).count("1") & 1 for i in range(n)])
        words += [(97 + signs).astype(np.uint8).tobytes(), (98 - signs).astype(np.uint8).tobytes()]
    data = b" ".join(words + words)
    part = ts.Slice(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), 0)
    starts, ends, _ = part.words()
    h = ts.span_hashes(part.buf, starts, ends)
    assert (h[: len(words)] == h[len(words) :]).all()
    assert len(set(h.tolist())) == len(words)


def test_windows_depend_on_order():
    h = np.array([1, 2, 1, 2, 2], dtype=np.uint64)
    w = ts.windows(h, 2)
    assert w[0] == w[2] and len(set(w.tolist())) == 3
    assert len(ts.windows(h, 6)) == 0


def test_long_documents_are_slices_of_their_own():
    values = ["a b", "c " * ts.SLICE, None, "d"]
    parts = list(ts.slices(pa.array(values)))
    assert [p.n_docs for p in parts] == [1, 1, 2]
    assert sum(p.words()[2][-1] for p in parts) == 2 + ts.SLICE + 1


def test_per_doc_and_ragged():
    assert ts.per_doc(np.array([1, 2, 3]), np.array([0, 0, 2, 3, 3])).tolist() == [0, 3, 3, 0]
    assert ts.ragged(np.array([5, 9]), np.array([2, 3])).tolist() == [5, 6, 9, 10, 11]


def test_a_worker_gives_its_memory_back_after_a_column():
    code = """
import os, re, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, sys.argv[1])
from plumbline.llm import textscan as ts
held = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
column = pa.array(["a b"])
list(ts.slices(column))
before = held()
large, small = [], []
for _ in range(2000):  # freed, but between others: the allocator keeps it
    large.append(np.ones(60_000, dtype=np.uint8))
    small.append(np.ones(2_000, dtype=np.uint8))
del large
assert held() > before + 80, "nothing was kept"
list(ts.slices(column))
assert held() < before + 40, (before, held())
"""
    root = ts.__file__.rsplit("/plumbline/", 1)[0]
    subprocess.run([sys.executable, "-c", code, root], check=True)


def test_batches_are_small(spark):
    """The JVM's buffers for a task are some times a batch: with 8 MB, two tasks and their workers held too much."""
    from plumbline.shared import ship

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    mine = spark.newSession()
    mine.conf.unset(name)
    ship(mine)
    assert int(mine.conf.get(name).rstrip("b")) <= 2 << 20
    mine.conf.set(name, "5242880")
    ship(mine)
    assert mine.conf.get(name).rstrip("b") == "5242880"
