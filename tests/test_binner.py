import pandas as pd
import pytest
from pyspark.sql import DataFrame

from gneiss.errors import NotFitted
from gneiss.operators.binner import Binner
from gneiss.plans.store import clean, own_folder, stored


def frame(n=200):
    return pd.DataFrame({"age": [float(i % 50) for i in range(n)], "city": ["AB"[i % 2] for i in range(n)], "y": [int(i % 50 > 25) for i in range(n)]})


@pytest.mark.parametrize("method", ["quantile", "uniform", "cart", "optimal"])
def test_lifecycle(spark, method):
    table = frame()
    binner = Binner(method, 4)
    with pytest.raises(NotFitted):
        binner.transform(table)
    out = binner.fit_transform(table, "y")
    assert isinstance(out, pd.DataFrame) and "age_bin" in out.columns and out["age_bin"].between(0, 3).all()
    assert binner.feature_names_out("woe")[0] == "age_woe"
    woe = binner.set_output("spark").transform(table, "woe")
    assert isinstance(woe, DataFrame) and woe.where("age_woe <> 0").count() > 0
    assert isinstance(binner.set_output("pandas").bin_stats(spark.createDataFrame(table), "y"), pd.DataFrame)
    assert isinstance(binner.set_output(None).transform(spark.createDataFrame(table)), DataFrame)
    with pytest.raises(ValueError):
        binner.set_output("csv")


def test_clean(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    assert stored(spark.range(3)).count() == 3
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    clean(spark)
    assert not files.exists(path)
