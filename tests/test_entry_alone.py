"""The entry without the optional subpackage: every other query is still there."""

import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_the_optional_folders(tmp_path, pipeline):
    from hardwood.catalog import oracle_texts, query_table

    shutil.copytree(f"{ROOT}/hardwood", tmp_path / "hardwood", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py")):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env=env, capture_output=True, text=True, check=True, timeout=120).stdout
    assert json.loads(out) == [sorted(query_table()), sorted(oracle_texts())]
