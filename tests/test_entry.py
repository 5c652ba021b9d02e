"""The entry points without the optional part, and with a broken one."""

import subprocess
import sys

BLOCK = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise {error}
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
print(len(q), len([n for n in q if n.startswith("op") or n == "pipeline"]), len(set(s) - set(q)))
"""


def entry_without(names, error):
    return subprocess.run([sys.executable, "-c", BLOCK.format(names=names, error=error)], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_the_rest_works_without_the_optional_part():
    for names in (["corpus_pipeline"], ["metrika.llm"]):
        made = entry_without(names, "ModuleNotFoundError(name, name=name)")
        n, optional, strange = map(int, made.stdout.split())
        assert n >= 60 and optional == 0 and strange == 0


def test_a_broken_import_is_not_swallowed():
    made = entry_without(["metrika.operators.rhymes"], "ModuleNotFoundError(name, name=name)")
    assert made.returncode != 0 and "rhymes" in made.stderr
    made = entry_without(["metrika.llm.packing"], "ImportError(name)")
    assert made.returncode != 0 and "packing" in made.stderr
