import subprocess
import sys

import __spark_entry__ as entry


def test_every_sql_belongs_to_a_query_and_names_are_unique():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {n.split("_")[0] for n in queries if n[0] == "p" and n[1].isdigit()} >= {"p2", "p4", "p5"}
    assert all(f"p{n}_found" in queries for n in (2, 4, 5))


def test_the_core_does_not_need_the_training_subpackage():
    code = "import sys; sys.modules['graphloom.llm'] = None; import __spark_entry__ as e; assert e.extra is None and 'p2_found' in e.queries(); print('ok')"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.strip() == "ok"


def test_nothing_outside_imports_the_training_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "graphloom"
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "graphloom.llm" in p.read_text()]
