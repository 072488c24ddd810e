"""Path arithmetic on Arrow batches: no interpreted lambdas, NULL and NaN in their places, same values as the column formulas."""
import math

import pytest
from pyspark.sql import functions as F

from skychan.functions import geo
from skychan.operators import features as fe
from skychan.operators.sampling import keep_linked
from skychan.plans.fixture import observations
from tests.conftest import SF_SMALL


def test_path_columns_are_not_interpreted_element_by_element(spark):
    lk = keep_linked(observations(spark, SF_SMALL))
    pp = fe.fit_path_preproc(lk)
    d = fe.data_vector(lk, pp, dtype="double")
    d = fe.angles_inverse(d.withColumn("a", F.slice("x", 21, 80)), "a")
    assert "lambda" not in d._jdf.queryExecution().executedPlan().toString()


def test_angles_agree_with_the_column_formulas(spark):
    lk = fe.with_los_terms(keep_linked(observations(spark, SF_SMALL)))
    aoa, _ = fe._los_terms()
    d = lk.select(*fe._TERMS, F.posexplode("nlos_ang").alias("k", "a"), fe.relative_angles(F.col("nlos_ang")).alias("r"))
    phi, theta = geo.rotate(F.col("a")[0], F.col("a")[1], aoa, inverse=True)
    got = F.col("r")[F.col("k")]
    turn = F.abs(F.pmod(phi - got["aoa_phi"] + 540.0, F.lit(360.0)) - 180.0)
    away = F.sin(F.radians(theta)) > 1e-6
    r = d.agg(F.count("*"), F.max(F.when(away, turn)), F.max(F.abs(theta - got["aoa_theta"]))).first()
    assert r[0] > 0 and r[1] < 1e-7 and r[2] < 1e-6


def test_null_and_nan_keep_their_places(spark):
    nan = math.nan
    rows = [(1, [3.0, 4.0, 0.0], [100.0, None, nan], [[0.0, 90.0, 0.0, 90.0], None, [1.0, 2.0]], [1e-6, None, nan]),
            (2, None, [100.0], [[0.0, 90.0, 0.0, 90.0]], [1e-6]), (3, [3.0, 4.0, 0.0], None, None, None), (4, [3.0, 4.0, 0.0], [], [], [])]
    df = spark.createDataFrame(rows, "obs_id int, dvec array<double>, nlos_pl array<double>, nlos_ang array<array<double>>, nlos_dly array<double>")
    pl, exc = fe.path_loss_raw(F.col("nlos_pl"), 200.0, 2), fe.excess_delay(F.col("nlos_dly"), F.col("dvec"))
    x = fe.angles_transform(df, n_max_paths=2)
    got = {r[0]: r[1:] for r in x.select("obs_id", pl, exc, "ang_x").collect()}
    assert got[1][0] == [100.0, None] and got[1][1] == [pytest.approx(1e-6 - 5 / 299792458.0), None, None]
    assert got[1][2][1::2] == [None] * 4 and None not in got[1][2][::2]
    assert got[2][0] == [100.0] and got[2][1] == [None] and got[2][2] == [None] * 8
    assert got[3][:2] == (None, None) and got[4][:2] == ([], []) and got[3][2] == got[4][2] == [None] * 8
