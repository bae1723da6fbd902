"""Array files read by ranges of rows equal NumPy's own rows."""

import numpy as np
import pytest

from starfield.sources import arrays, files


def rows(df):
    return [r.features for r in df.orderBy("id").collect()], [r.id for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("shape,kind,order", [((10_000, 3), "f8", "C"), ((9_000, 2), "f4", "F"), ((5_000,), "i4", "C"), ((700, 2, 3), ">i2", "F"), ((0, 4), "f8", "C")])
def test_split_file(spark, tmp_path, shape, kind, order):
    x = np.asarray(np.random.default_rng(1).normal(size=shape) * 100).astype(kind, order=order)
    np.save(tmp_path / "x.npy", x)
    found = arrays.read_arrays(spark, str(tmp_path / "x.npy"), split=16_000)
    got, ids = rows(found)
    assert ids == list(range(len(x)))
    assert np.array_equal(np.array(got).reshape(len(x), int(np.prod(shape[1:], dtype=int))), np.ascontiguousarray(x).reshape(len(x), int(np.prod(shape[1:], dtype=int))).astype(float))
    if len(x) > 1000:
        assert found.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives(spark, tmp_path, save):
    x, y = np.arange(30_000.0).reshape(-1, 3), np.arange(10_000) % 7
    save(tmp_path / "a.npz", X=x, y=y)
    found = arrays.read_arrays(spark, "file://" + str(tmp_path / "a.npz"), split=50_000)
    got = found.orderBy("id").collect()
    assert [r.label for r in got] == [str(v) for v in y] and np.array_equal([r.features for r in got], x)
    assert (found.rdd.getNumPartitions() > 1) == (save is np.savez)
    save(tmp_path / "b.npz", Z=x)
    with pytest.raises(Exception, match="no array X"):
        arrays.read_arrays(spark, str(tmp_path / "b.npz")).count()


def test_folder_and_labels(spark, tmp_path):
    (tmp_path / "all").mkdir()
    np.save(tmp_path / "all/1.npy", np.ones((3, 2)))
    np.save(tmp_path / "all/2.npy", np.zeros((2, 2)))
    np.save(tmp_path / "names.npy", np.array(["a", "b", "c", "d", "é"]))
    got = files.read_numpy(spark, str(tmp_path / "all"), str(tmp_path / "names.npy")).orderBy("id").collect()
    assert [(r.id, r.features[0], r.label) for r in got] == [(0, 1, "a"), (1, 1, "b"), (2, 1, "c"), (3, 0, "d"), (4, 0, "é")]
