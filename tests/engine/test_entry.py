import builtins
import importlib
import sys

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "context"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_corpus_operators(monkeypatch):
    gone = ("groundwork.llm", "corpus_pipeline")
    for name in [m for m in sys.modules if m.startswith(gone)]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(importlib.import_module("groundwork"), "llm", raising=False)
    real = builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(gone):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", refuse)
    names = set(entry.queries())
    assert names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= names
