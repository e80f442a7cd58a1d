"""The entry point without the training-data operators, without a library of theirs, and with a wrong name in them."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.fixture
def repo(tmp_path):
    for name in ("millrace", "corpus_pipeline.py", "__spark_entry__.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    if not (tmp_path / "millrace" / "llm").exists():
        pytest.skip("the training-data operators are absent")
    return tmp_path


def imported(repo, before=""):
    code = f"{before}\nimport __spark_entry__ as e\nprint(len(e.queries()), sum(q.startswith('op') for q in e.queries()), 'pipeline' in e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=repo, capture_output=True, text=True, timeout=120)


def test_without_them(repo):
    shutil.rmtree(repo / "millrace" / "llm")
    (repo / "corpus_pipeline.py").unlink()
    got = imported(repo)
    assert got.returncode == 0 and got.stdout.split()[1:] == ["0", "False"] and "left out" not in got.stderr


def test_without_a_library_of_theirs(repo):
    got = imported(repo, "import sys; sys.modules['xxhash'] = None")
    assert got.returncode == 0 and got.stdout.split()[1:] == ["0", "False"] and "no module xxhash" in got.stderr


@pytest.mark.parametrize("line", ["from .common import no_such_name", "from . import no_such_module", "from .no_such_module import x"])
def test_with_a_wrong_name_in_them(repo, line):
    path = repo / "millrace" / "llm" / "simhash.py"
    path.write_text(path.read_text().replace("from . import similar", f"{line}\nfrom . import similar"))
    assert imported(repo).returncode != 0
