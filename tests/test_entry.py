"""What the entry lists when corpus folders, libraries or own modules are missing."""

import sys

import pytest

import __spark_entry__ as entry
from lumastack.plans import registry


def without(monkeypatch, *names):
    for name in [m for m in sys.modules if m.startswith("lumastack.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in names:
        monkeypatch.setitem(sys.modules, name, None)


def test_without_the_corpus_folder(monkeypatch):
    without(monkeypatch, "lumastack.llm")
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLE_SQL)


def test_without_a_library(monkeypatch):
    without(monkeypatch, "public_tokenizers")
    assert set(entry.queries()) == set(registry.QUERIES)


def test_without_the_pipeline(monkeypatch):
    pytest.importorskip("lumastack.llm.queries")
    without(monkeypatch, "corpus_pipeline")
    assert "pipeline" not in entry.queries() and "op1_toxicity" in entry.queries()


def test_a_broken_module_is_an_error(monkeypatch):
    pytest.importorskip("lumastack.llm.queries")
    without(monkeypatch, "lumastack.llm.shared")
    with pytest.raises(ImportError):
        entry.queries()
