"""The key of pseudonyms: the session's own, or one of the application on a cluster that sets none."""

from types import SimpleNamespace

import pytest

from pulsegrid.llm import pii


def session(master, app, key=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: key or default), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_a_cluster_session_without_a_key_gets_a_secret_one_of_its_application():
    with pytest.warns(UserWarning, match="random key"):
        first = pii.pii_key(session("spark://there:7077", "app-1"))
    with pytest.warns(UserWarning):
        again, other = pii.pii_key(session("spark://there:7077", "app-1")), pii.pii_key(session("yarn", "app-2"))
    assert first == again != other and len(first) == 64 and pii.DEMO_KEY not in (first, other)
    assert pii.pii_key(session("spark://there:7077", "app-1", "own")) == "own"
