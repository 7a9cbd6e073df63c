"""Saved campaigns: slices of arrays, archives without seeds, round trips, refused pickles."""

import io
import math
import os
import pickle
import zipfile

import numpy as np
import pytest

from rareflow.sources import archives


def saved(path, **arrays):
    np.savez_compressed(path, **arrays)


def test_slices_give_every_row_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    theta, other = rng.random((57, 3)), np.asfortranarray(rng.random((20, 3)))
    margins = rng.random(57)
    margins[4] = np.nan
    saved(tmp_path / "a.npz", theta_0=theta, margins_0=margins, seeds_0=np.arange(57) % 5, theta_1=other, margins_1=np.arange(20.0),
          labels=np.array(["x", "y"], dtype=object), param_names=np.array(["p", "q", "r"], dtype=object))
    df = archives.read_archives(spark, str(tmp_path / "a.npz"), rows=10)
    assert df.rdd.getNumPartitions() == 8
    got = {(r.arm, r.pos): r for r in df.collect()}
    assert len(got) == df.count() == 77
    for k in range(57):
        r = got["x", k]
        assert r.theta == theta[k].tolist() and r.seed == k % 5 and (r.margin is None if k == 4 else r.margin == margins[k])
    assert all(got["y", k].theta == other[k].tolist() and got["y", k].seed is None and got["y", k].margin == k for k in range(20))


def test_round_trip(spark, tmp_path):
    rows = [(f"arm{k % 3}", [k / 7, k / 9], None if k % 11 == 0 else k - 50.0, None if k % 3 == 2 else k % 4) for k in range(200)]
    points = spark.createDataFrame(rows, "arm string, theta array<double>, margin double, seed int").repartition(3)
    archives.write_archives(points, str(tmp_path / "out"), ["a", "b"], rows=40)
    assert all(f.endswith(".npz") for f in os.listdir(tmp_path / "out")) and len(os.listdir(tmp_path / "out")) >= 5
    key = lambda r: (r[0], r[1])
    got = archives.read_archives(spark, str(tmp_path / "out")).select("arm", "theta", "margin", "seed").collect()
    assert sorted(map(tuple, got), key=key) == sorted(rows, key=key)
    with np.load(tmp_path / "out" / os.listdir(tmp_path / "out")[0]) as one:
        assert one["param_names"].tolist() == ["a", "b"] and len(one["labels"]) >= 1


def test_folder_without_archives(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path)).count() == 0


def test_unequal_arrays_are_refused(spark, tmp_path):
    saved(tmp_path / "a.npz", theta_0=np.zeros((3, 1)), margins_0=np.zeros(2), labels=np.array(["x"]))
    with pytest.raises(Exception, match="lengths"):
        archives.read_archives(spark, str(tmp_path / "a.npz")).count()


class Harm:
    def __reduce__(self):
        return math.sqrt, (4.0,)


def test_labels_that_are_code_are_refused(tmp_path):
    raw = io.BytesIO()
    np.lib.format.write_array(raw, np.array(["x"], dtype=object), allow_pickle=True)
    start = raw.getvalue()[: raw.getvalue().index(b"\n") + 1]
    with zipfile.ZipFile(tmp_path / "a.npz", "w") as z:
        z.writestr("labels.npy", start + pickle.dumps(Harm()))
    with zipfile.ZipFile(tmp_path / "a.npz") as z, pytest.raises(pickle.UnpicklingError, match="math.sqrt"):
        archives.texts(z, "labels")
