from types import SimpleNamespace

import pytest

from rentloom.llm.common import shared_folder


def _session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master, applicationId="app-of-test"))


def test_shared_folder_without_a_setting():
    one, two = shared_folder(_session("local[2]")), shared_folder(_session("local[2]"))
    assert one == two and one.startswith("file://")
    with pytest.raises(ValueError):
        shared_folder(_session("spark://host:7077"))
    assert shared_folder(_session("spark://host:7077", "hdfs://host/shared/")) == "hdfs://host/shared"
