"""Readers and writers."""

import zipfile

import numpy as np
import pandas as pd
import pytest

from cytolake.operators import model
from cytolake.sources import readers, writers


@pytest.fixture()
def frame():
    rnd = np.random.default_rng(0)
    return pd.DataFrame(rnd.uniform(size=(12, 4)), index=[f"CpG{i}" for i in range(12)], columns=[f"S{i}" for i in range(4)]).rename_axis("probe").reset_index()


def test_file_kinds(spark, tmp_path, frame):
    frame.to_csv(tmp_path / "m.csv", index=False)
    frame.to_csv(tmp_path / "m.tsv", index=False, sep="\t")
    frame.to_parquet(tmp_path / "m.parquet")
    frame.to_feather(tmp_path / "m.feather")
    frame.to_pickle(tmp_path / "m.pkl")
    for name in ("m.csv", "m.tsv", "m.parquet", "m.feather", "m.pkl"):
        got = readers.read_table(spark, str(tmp_path / name), trusted=True).toPandas().sort_values("probe")
        assert np.allclose(got.iloc[:, 1:].astype(float), frame.sort_values("probe").iloc[:, 1:])
    assert readers.read_table(spark, str(tmp_path / "m.parquet"), "S2").columns[0] == "S2"
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "m.pkl"))
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(IndexError):
        readers.read_table(spark, str(tmp_path / "m.feather"), 99)
    (tmp_path / "m.odd").write_text("x")
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "m.odd"))


def test_studies(spark, tmp_path, frame):
    frame["S1"] = frame["S1"].astype(str)
    frame.loc[0, "S1"] = "odd"
    frame.to_csv(tmp_path / "m.csv", index=False)
    pd.DataFrame({"id": [f"S{i}" for i in range(6)], "group": list("AABBAB")}).to_csv(tmp_path / "p.csv", index=False)
    study = readers.load_study(spark, str(tmp_path / "m.csv"), str(tmp_path / "p.csv"))
    assert study.meta["n_coerced"] == 1 and study.samples() == ["S0", "S1", "S2", "S3"]
    assert study.cells.where("value is null").count() == 1
    assert readers.load_study(spark, str(tmp_path / "m.csv")).samples() == ["S0", "S1", "S2", "S3"]
    with pytest.raises(KeyError):
        readers.load_study(spark, str(tmp_path / "m.csv"), spark.createDataFrame([("S0", "A")], "id string, g string"))
    with pytest.raises(KeyError):
        readers.load_study(spark, str(tmp_path / "m.csv"), ann=spark.createDataFrame([("CpG0", "1")], "id string, chr string"))
    with pytest.raises(TypeError):
        readers.load_study(spark, 5)
    writers.save_study(study, str(tmp_path / "saved"))
    again = readers.load_saved(spark, str(tmp_path / "saved"))
    assert again.meta == study.meta and again.cells.exceptAll(study.cells).count() == 0
    with pytest.raises(FileExistsError):
        writers.save_study(study, str(tmp_path / "saved"), overwrite=False)
    for kind in ("csv", "tsv", "pickle"):
        path = str(tmp_path / (f"saved-{kind}" if kind != "pickle" else "saved.pkl"))
        writers.save_study(study, path, kind)
        again = readers.load_saved(spark, path, trusted=True)
        assert again.meta == study.meta and again.ann is None and again.cells.dtypes == study.cells.dtypes
        for a, b in ((again.cells, study.cells), (again.pheno, study.pheno)):
            assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    with pytest.raises(ValueError):
        readers.load_saved(spark, str(tmp_path / "saved.pkl"))


def test_formats_whose_library_is_absent_say_so(spark, tmp_path):
    """Excel and HDF5 need packages; without them there is a clear error and no file."""
    import importlib.util

    res = spark.createDataFrame([("a", 1.0)], "probe_id string, logFC double")
    study = model.Study(spark.createDataFrame([("a", "x", 1.0)], "probe_id string, sample_id string, value double"), spark.createDataFrame([("x",)], "sample_id string"))
    sheet = spark.createDataFrame([("x", "A")], "sample_id string, g string")
    wide = spark.createDataFrame([("a", 1.0)], "probe_id string, x double")
    for package, file, write in (
        ("openpyxl", "r.xlsx", lambda p: writers.export_results(res, p, "excel")), ("tables", "s.h5", lambda p: writers.save_study(study, p, "hdf5")),
        ("h5py", "e.h5", lambda p: writers.export_hdf5(wide, wide, sheet, p))):
        if importlib.util.find_spec(package) is None:
            with pytest.raises(ImportError, match=package):
                write(str(tmp_path / file))
            assert not (tmp_path / file).exists()
        else:
            write(str(tmp_path / file))
            assert (tmp_path / file).exists()
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", "")
    if importlib.util.find_spec("openpyxl") is None:
        with pytest.raises(ImportError, match="openpyxl"):
            readers.read_table(spark, str(tmp_path / "x.xlsx"))


def test_hdf5_keys(spark, tmp_path, monkeypatch):
    """One table is read, several are refused; the store is a stand-in, as its library may be absent."""
    tables = {"/M": pd.DataFrame({"S1": [0.1, 0.2]}, index=pd.Index(["a", "b"], name="id"))}

    class Store:
        def __init__(self, path, mode):
            self.keys, self.__getitem__ = lambda: list(tables), tables.__getitem__

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def __getitem__(self, key):
            return tables[key]

    monkeypatch.setattr(pd, "HDFStore", Store)
    (tmp_path / "m.h5").write_bytes(b"")
    got = readers.read_table(spark, str(tmp_path / "m.h5"))
    assert got.columns == ["id", "S1"] and got.count() == 2
    tables["/other"] = tables["/M"]
    with pytest.raises(ValueError, match="2 tables"):
        readers.read_table(spark, str(tmp_path / "m.h5"))


def test_row_blocks(spark):
    wide = spark.createDataFrame([(f"p{i}", float(i), None) for i in range(7)], "probe_id string, x double, y double")
    got = list(writers.row_blocks(wide, ["x", "y"], 3))
    assert [len(ids) for ids, _ in got] == [3, 3, 1] and got[2][0] == ["p6"] and got[0][1][1, 0] == 1.0 and got[0][1][:, 1].tolist() != got[0][1][:, 0].tolist()


def test_results(spark, tmp_path):
    res = spark.createDataFrame([("a", 1.0, 2.0, 0.1, 3.0)], "probe_id string, logFC double, mean_A double, pval double, other double")
    writers.export_results(res, str(tmp_path / "r.csv"))
    assert spark.read.csv(str(tmp_path / "r.csv"), header=True).columns == ["probe_id", "logFC", "mean_A", "pval"]
    writers.export_results(res, str(tmp_path / "all.tsv"), "tsv", include_all=True)
    with pytest.raises(RuntimeError):
        writers.export_results(res, str(tmp_path / "x"), "odd")
    with pytest.raises(FileExistsError):
        writers.export_results(res, str(tmp_path / "r.csv"), overwrite=False)


def test_pack_and_wide(spark):
    cells = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", None)], "probe_id string, sample_id string, value double")
    packed = {r.probe_id: r["values"] for r in model.pack(cells, ["y", "x", "z"]).collect()}
    assert packed == {"a": [2.0, 1.0, None], "b": [None, None, None]}
    wide = model.wide_from_cells(cells, ["x", "y"])
    assert model.cells_from_wide(wide, "probe_id").where("value is not null").count() == 2
