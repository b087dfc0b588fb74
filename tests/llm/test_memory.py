"""What a kept Python worker holds while and after its tasks run; each case in a process of its own."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from veil.llm import bpe, queries

ROOT = str(Path(__file__).parents[2])

SETUP = """
import re, threading
from types import SimpleNamespace
import numpy as np, pyarrow as pa
from pyspark.sql.types import LongType, StringType, StructType
import veil.llm._common as common
from veil.llm import bpe, quality_gbdt, queries, sa_dedup

def held():
    text = open("/proc/self/smaps_rollup").read()
    return int(re.search(r"\\nAnonymous:\\s+(\\d+)", text)[1]) / 1024

def highest(run):
    \"\"\"run's result, and the most MB held meanwhile, looked at every few milliseconds\"\"\"
    most, over = [held()], threading.Event()
    def look():
        while not over.wait(0.005):
            most.append(held())
    watch = threading.Thread(target=look)
    watch.start()
    try:
        return run(), max(most)
    finally:
        over.set()
        watch.join()

class Table:
    columns = ["doc_id", "text"]
    schema = StructType().add("doc_id", LongType()).add("text", StringType())
    def select(self, *a): return self
    def mapInArrow(self, run, schema): return run

words = np.random.default_rng(1).integers(1 << 40, size=(2000, 700))
batch = pa.RecordBatch.from_pydict({
    "doc_id": list(range(2000)), "text": [" ".join(f"{w:x}" for w in row) for row in words.tolist()]})
del words
common._release() if hasattr(common, "_release") else None
"""


def measured(code: str) -> list[float]:
    out = subprocess.run([sys.executable, "-c", SETUP + code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [float(x) for x in out.stdout.split()]


def test_classifier_holds_little():
    rows, most = measured("""
run = quality_gbdt.accepted_documents(Table(), quality_gbdt.Forest(bias=1.0))
before = held()
rows, most = highest(lambda: sum(b.num_rows for b in run(iter([batch]))))
print(rows, most - before)
""")
    assert rows == 2000
    assert most < 60  # over 70 with 4 MB of text at once


def test_encoder_holds_little_and_gives_it_back(monkeypatch):
    rows, most, after = measured("""
# a schema's text is parsed by Spark only
common.documents, common.StructType = lambda df: df, SimpleNamespace(fromDDL=lambda text: None)
common.to_arrow_schema = lambda none: pa.schema({
    "doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string()})
run = bpe.encode_documents(Table(), queries.tokenizer_path())
before = held()
rows, most = highest(lambda: sum(b.num_rows for b in run(iter([batch]))))
print(rows, most - before, held() - before)
""")
    assert rows == 2000
    assert most < 135  # over 150 with a table of 250,000 words
    assert after < 50


def test_string_hashes_hold_little():
    most, times = measured("""
data = np.random.default_rng(2).integers(0, 256, 4 << 20, dtype=np.uint8)
places = np.arange(0, len(data) - 200, 50)
before = held()
count, most = highest(lambda: sa_dedup._occurrences(data, places, 200))
print(most - before, count.max())
""")
    assert times == 1
    assert most < 150  # three arrays of 32 MB; 160 with copies between steps


@pytest.mark.parametrize("bits", [12, 15, 19])
def test_pair_table_levels(bits):
    rng = np.random.default_rng(bits)
    a, b = rng.integers(0, 49_000, (2, 40_000))
    ranks = {x << 20 | y: r for r, (x, y) in enumerate(zip(a.tolist(), b.tolist()))}
    table = bpe.PairTable(ranks, bits)
    keys = np.array(list(ranks))
    assert table.rank(keys >> 20, keys & 0xFFFFF).tolist() == list(ranks.values())
    other = rng.integers(0, 49_000, (2, 5_000))
    want = [ranks.get(x << 20 | y, bpe._NONE) for x, y in zip(*other.tolist())]
    assert table.rank(*other).tolist() == want
    assert bpe.PairTable({}).rank(keys[:3] >> 20, keys[:3] & 0xFFFFF).tolist() == [bpe._NONE] * 3


def test_vocabulary_is_small():
    table = bpe.ForcedBoundaryBpe(queries.tokenizer_path()).table
    assert sum(x.nbytes for level in table.levels for x in level if isinstance(x, np.ndarray)) < 12 << 20
