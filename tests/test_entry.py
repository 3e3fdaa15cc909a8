"""The entry points work without what the training-data operators need."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(before):
    code = before + "; import __spark_entry__ as e; q = e.queries(); print(e.LLM, len(q), 'scan_all' in q, set(e.oracle_sql()) <= set(q))"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_absent_packages_leave_the_core():
    for gone in ("keytide.llm", "corpus_pipeline", "xxhash"):
        llm, n, core, sql = run(f"import sys; sys.modules[{gone!r}] = None")
        assert (llm, core, sql) == ("False", "True", "True") and int(n) >= 38
