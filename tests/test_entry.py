"""The other queries stay when the training-data package, or something it needs, is missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["maskwright.llm", "corpus_pipeline", "xxhash", "public_tokenizers"])
def test_without(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), 'scan' in e.oracle_sql())"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, pipeline, scan = done.stdout.split()
    assert int(n) > 160 and pipeline == "False" and scan == "True", done.stderr
