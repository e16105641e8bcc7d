"""Intermediate tables: where they may be written, and that they go."""

import os

import pytest

from bedtrace import session
from bedtrace.operators.models import _non_negative


class FakeConf:
    def get(self, *_):
        return None


class FakeContext:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class FakeSession:
    conf = FakeConf()

    def __init__(self, master):
        self.sparkContext = FakeContext(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"])
def test_a_cluster_must_name_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        session._shared_dir(FakeSession(master))


def test_released_tables_are_gone(spark):
    df = session.cut_lineage(spark.range(10))
    path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    path = "/" + path.lstrip("/")
    assert os.path.isdir(path) and df.count() == 10
    assert session.release(spark) >= 1
    assert not os.path.exists(path) and session.release(spark) == 0


def test_non_negative_solution_meets_its_conditions():
    import numpy as np

    rng = np.random.default_rng(0)
    for k in (1, 2, 5, 9):
        for _ in range(40):
            x = rng.normal(size=(30, k))
            a, c = x.T @ x + 0.1 * np.eye(k), x.T @ rng.normal(size=30)
            w = _non_negative(a, c, np.arange(k))
            slope = c - a @ w
            assert (w >= 0).all() and (slope <= 1e-8).all() and np.abs(slope[w > 0]).max(initial=0) < 1e-8
