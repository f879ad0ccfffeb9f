"""The HDF5 layer against a stand-in that keeps arrays in files; the library itself may be missing."""

import sys

import numpy as np
import pytest

STAND_IN = '''
import os
import pickle


class Node(dict):
    def __init__(self):
        super().__init__()
        self.attrs = {}


class File:
    def __init__(self, path, mode):
        self.path, self.mode = path, mode
        if mode == "r" and not os.path.exists(path):
            raise OSError(path)
        self.root = pickle.load(open(path, "rb")) if os.path.exists(path) else Node()
        self.attrs = self.root.attrs

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.mode != "r":
            pickle.dump(self.root, open(self.path, "wb"))

    def __contains__(self, name):
        return name in self.root

    def __getitem__(self, name):
        return self.root[name]

    def __delitem__(self, name):
        del self.root[name]

    def create_dataset(self, name, shape, dtype):
        import numpy
        self.root[name] = numpy.zeros(shape, dtype)
        return self.root[name]
'''


@pytest.fixture
def h5(spark, tmp_path, monkeypatch):
    try:
        import h5py  # noqa: F401

        pytest.skip("written for the stand-in")
    except ImportError:
        pass
    (tmp_path / "h5py.py").write_text(STAND_IN)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    yield __import__("h5py")
    sys.modules.pop("h5py", None)


def test_round_trips(spark, h5, tmp_path):
    from partita.sources import hdf5

    path = str(tmp_path / "data.h5")
    with h5.File(path, "a") as f:
        group = h5.Node()
        group.update(data=np.array([1.0, 2.0, 0.0, 4.0], np.float32), indices=np.array([1, 0, 2, 2], np.int32), indptr=np.array([0, 1, 1, 4]))
        group.attrs["shape"] = [3, 3]
        f.root["train"] = group
        f.root["otest/knns"] = np.array([[2, 1], [3, 0]], np.int32)
    assert sorted(map(tuple, hdf5.read_csr(spark, path, rows_per_task=2).collect())) == [(0, 1, 1.0), (2, 0, 2.0), (2, 2, 4.0)]
    assert [tuple(r) for r in hdf5.read_knns(spark, path).orderBy("query_id").collect()] == [(0, [2, 1]), (1, [3, 0])]

    h = spark.createDataFrame([(0, 1, 0.5), (2, 0, 1.5)], "comp int, col_id long, val double")
    lists = spark.createDataFrame([(0, 0, 7), (0, 1, 3), (2, 0, 1)], "comp int, pos int, doc_id long")
    for _ in range(2):  # the second write replaces the first
        hdf5.write_index(h, lists, 3, 2, 2, path, algo="lists")
    h2, lists2 = hdf5.read_index(spark, path)
    assert sorted(map(tuple, h2.collect())) == sorted(map(tuple, h.collect())) and sorted(map(tuple, lists2.collect())) == sorted(map(tuple, lists.collect()))

    found = spark.createDataFrame([(0, 1, 5, 2.0), (4, 1, 9, 4.0), (4, 2, 8, 3.0)], "query_id long, rank int, doc_id long, score double")
    ids = spark.createDataFrame([(0,), (2,), (4,)], "query_id long")
    hdf5.write_results(found.limit(0), ids, 2, str(tmp_path / "none.h5"))
    assert not (tmp_path / "none.h5").exists()
    hdf5.write_results(found, ids, 2, path, params="a=1;")
    with h5.File(path, "r") as f:
        assert f["knns"].tolist() == [[6, 0], [0, 0], [10, 9]] and f["dists"].tolist() == [[2.0, -np.inf], [-np.inf] * 2, [4.0, 3.0]]
    assert hdf5.attribute(path, "params") == "a=1;" and hdf5.attribute(path, "missing") == "unknown"
    with pytest.raises(OSError):
        hdf5.read_csr(spark, str(tmp_path / "absent.h5"))
