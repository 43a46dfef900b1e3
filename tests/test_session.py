"""The shared folder with and without the setting, and the entry without a third-party module."""

import builtins
from types import SimpleNamespace

import pytest

import __spark_entry__ as entry
from loadstone import session


def _stub(master, configured=None, app="app-1"):
    conf = SimpleNamespace(get=lambda name, default=None: configured or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_shared_dir_with_the_setting():
    assert session.shared_dir(_stub("spark://host:7077", "s3a://place/folder/")) == "s3a://place/folder"


def test_shared_dir_without_the_setting():
    mine = session.shared_dir(_stub("local[2]"))
    assert mine == session.shared_dir(_stub("local[2]")) != session.shared_dir(_stub("local[2]", app="app-2"))
    assert session.scratch_path(_stub("local[2]"), "x").startswith(mine + "/x-")
    with pytest.raises(RuntimeError):
        session.shared_dir(_stub("spark://host:7077"))


@pytest.mark.parametrize("missing, kept", [("corpus_pipeline", True), ("some_library", True), ("loadstone.operators.gone", False)])
def test_entry_without_a_module(monkeypatch, missing, kept):
    real = builtins.__import__

    def fake(name, *args, **kw):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(missing, name=missing)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", fake)
    if kept:
        assert len(entry.queries()) > 200 and "pipeline" not in entry.queries()
    else:
        with pytest.raises(ModuleNotFoundError):
            entry.queries()
