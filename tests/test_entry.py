import __spark_entry__ as entry


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == [
        "semantic_ks", "centroid_distance", "spread_distance", "combined_drift_score", "n_ref", "n_new", "status"
    ]
    assert rows[0].status == "ok" and 0.0 <= rows[0].semantic_ks <= 1.0


def test_registry_consistent():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


def test_registry_without_the_training_data_operators():
    """With the subpackage and the pipeline blocked, the other queries are registered as before."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('vigil.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) >= 50 and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
