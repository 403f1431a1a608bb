import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("absent", [("regseq.llm", "corpus_pipeline"), ("corpus_pipeline",), ("regex",)])
@pytest.mark.filterwarnings("ignore:text operators")
def test_imports_without_the_text_subpackage(monkeypatch, absent):
    """The entry still imports when the subpackage and the pipeline, or a library of theirs, are gone."""
    gone = [m for m in sys.modules if m.startswith("regseq.llm") or m in ("corpus_pipeline", *absent)]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)

    class Blocked:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name.startswith(absent):
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Blocked, *sys.meta_path])
    import regseq

    if hasattr(regseq, "llm"):
        monkeypatch.delattr(regseq, "llm")
    found = importlib.reload(entry)
    assert found.text_corpus is None and "flagship_promoters" in found.queries() and "pipeline" not in found.queries()
    monkeypatch.undo()
    importlib.reload(entry)
