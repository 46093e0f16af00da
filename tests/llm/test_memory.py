import subprocess
import sys

#: Prints what a Python worker holds, in MB: at most while it works, beyond what it had, and after the task.
WORKER = """
import ctypes, re

import numpy as np
import pyarrow as pa

from zonewalk.llm import minhash


def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) / 1024


rng = np.random.default_rng(5)
words = [f"word{i}" for i in range(50000)]
text = [" ".join(words[j] for j in rng.integers(0, len(words), 250)) for _ in range(6000)]
batch = pa.RecordBatch.from_pydict({"row": list(range(len(text))), "doc_id": list(range(len(text))), "text": text})
run = minhash.marks(5)
del words, text
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
before = most = held()
for out in run(iter([batch])):
    most = max(most, held())
del out
print(most - before, held() - before)
"""


def test_a_worker_holds_little_and_gives_it_back():
    done = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr
    most, left = map(float, done.stdout.split())
    assert most < 32 and left < 12, done.stdout
