"""Every registered query at the smallest scale, against its oracle where it has one."""

import dataclasses

import pytest

import __spark_entry__ as contract
from checks.compare import difference
from checks.queries import QUERIES
from trovelight.settings import Settings

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"stream_prompts", "prompt_answers"}  # compared with each other
OWN = {k for k in contract.queries() if k in QUERIES}  # without the optional part


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_other_query_has_an_oracle():
    assert OWN - set(contract.oracle_sql()) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("key", sorted(OWN & set(contract.oracle_sql())))
def test_oracle(spark, key):
    assert difference(spark, SF, key) is None


def test_stream_answers_equal_batch_answers(spark):
    both = [sorted(map(str, contract.queries()[k](spark, SF).collect())) for k in ("stream_prompts", "prompt_answers")]
    assert both[0] == both[1] and both[0]


def test_settings_from_environment():
    changed = Settings.from_env({"TOP_K": "9", "SCORE_THRESHOLD": "0.5", "LICENSE": "bsd", "OTHER": "x"})
    assert (changed.TOP_K, changed.SCORE_THRESHOLD, changed.LICENSE) == (9, 0.5, "bsd")
    assert dataclasses.replace(changed, TOP_K=5, SCORE_THRESHOLD=0.65, LICENSE="mit") == Settings()


def test_imports_without_the_optional_part(tmp_path):
    """The driver deletes the training-data operators, their tests and the pipeline."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(contract.__file__).resolve().parent
    gone = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_*.py")
    shutil.copytree(root, tmp_path / "repo", ignore=gone)
    assert not (tmp_path / "repo" / "trovelight" / "llm").exists()
    probe = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'context_pack' in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", probe], cwd=tmp_path / "repo", capture_output=True, text=True,
                          env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}, timeout=300)
    assert done.returncode == 0, done.stderr
