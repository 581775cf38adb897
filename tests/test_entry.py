"""Every query with SQL, against DuckDB on the smallest data, where those are at hand."""

import glob
import importlib
import math
import os
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__
from tidegrid.session import set_checkpoint_folder

FOLDER = "/root/testdata/sf0.001"
CORE = [n for m in __spark_entry__._modules() if not m.__name__.startswith("tidegrid.llm") for n in m.SQL]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", CORE)
def test_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.collect(), df.columns) == table(cursor.fetchall(), names)


def test_entry(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_does_not_use_the_subpackage():
    root = os.path.join(os.path.dirname(__file__), "..", "tidegrid")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "tidegrid.llm" not in open(path).read()


def test_a_missing_optional_package_leaves_the_core(monkeypatch):
    whole = importlib.import_module

    def without(name):
        if name == "tidegrid.llm.queries":
            raise ImportError("a package of the subpackage is missing")
        return whole(name)

    monkeypatch.setattr(importlib, "import_module", without)
    names = set(__spark_entry__.queries())
    assert "p1_found" in names and "p7_found" not in names and set(__spark_entry__.oracle_sql()) <= names


def test_a_cluster_must_name_its_checkpoint_folder():
    def fake(master, folder):
        made = []
        scala = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: not made, get=lambda: made[0]))
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: scala), getConf=lambda: conf, master=master, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        set_checkpoint_folder(fake("spark://host:7077", None))
    assert set_checkpoint_folder(fake("spark://host:7077", "/shared/x")) == "/shared/x"
    assert os.path.isdir(set_checkpoint_folder(fake("local[2]", None)))
