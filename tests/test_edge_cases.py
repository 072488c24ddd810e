"""Edge cases of FIXTURES.md section C, on small literal tables."""
import tempfile

import pytest
from pyspark.sql import functions as F

from skychan.functions import geo
from skychan.functions.arrays import head_sort
from skychan.operators import features as fe
from skychan.operators import metrics as me
from skychan.operators import sampling as sa
from skychan.sources import decode as dc
from skychan.sources import io as sio


def _sph(spark, x, y, z):
    df = spark.createDataFrame([(float(x), float(y), float(z))], "x double, y double, z double")
    r, p, t = geo.cart_to_sph(F.col("x"), F.col("y"), F.col("z"))
    return df.select(r.alias("r"), geo.canon_phi(p).alias("p"), t.alias("t")).first()


def test_zero_vector(spark):
    assert tuple(_sph(spark, 0, 0, 0)) == (0.0, 0.0, 0.0)


def test_poles(spark):
    assert _sph(spark, 0, 0, 5)["t"] == 0.0
    assert _sph(spark, 0, 0, -5)["t"] == 180.0
    assert _sph(spark, 0, 0, 5)["p"] == 0.0


def test_branch_cut(spark):
    assert _sph(spark, -1, -0.0, 0)["p"] == 180.0
    assert _sph(spark, -1, 0.0, 0)["p"] == 180.0


def _decode_cells(spark, cells, col="dvec"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"obs_id bigint, {col} string")
    return dc.decode_observations(df, with_rejects=True).orderBy("obs_id").select(col, f"{col}__reject").collect()


def test_malformed_json_is_null_and_counted(spark):
    rows = _decode_cells(spark, ["oops", "[1,2", "", "5", '{"a":1}', "[NaN,1]"])
    assert [r[0] for r in rows] == [None] * 6
    assert [r[1] for r in rows] == [True, True, False, True, True, True]


def test_wrong_size_kept_and_null_element(spark):
    rows = _decode_cells(spark, ["[1,2]", "[1,null]"])
    assert rows[0][0] == [1.0, 2.0]
    assert rows[1][0] == [1.0, None]
    from skychan.operators.quality import validate
    df = spark.createDataFrame([(0, "[1,2]")], "obs_id bigint, dvec string")
    rep = validate(dc.decode_observations(df)).first()
    assert rep["n_wrong_size"] == 1 and rep["is_valid"] is False


def test_receiver_spellings(spark):
    df = spark.createDataFrame([("0",), ("1",), ("Terrestrial",), ("Aerial",), (" 0 ",)], "r string")
    out = [r[0] for r in df.select(dc.normalize_rx(F.col("r"))).collect()]
    assert out == ["Terrestrial", "Aerial", "Terrestrial", "Aerial", "Terrestrial"]


def test_unknown_receiver(spark):
    df = spark.createDataFrame([(2,)], "r int")
    assert df.select(dc.normalize_rx(F.col("r"), "null")).first()[0] is None
    oh = df.select(F.array(*[F.when(dc.normalize_rx(F.col("r"), "null") == n, 1.0).otherwise(0.0)
                             for n in ("Terrestrial", "Aerial")])).first()[0]
    assert oh == [0.0, 0.0]
    with pytest.raises(Exception):
        df.select(dc.normalize_rx(F.col("r"), "error")).collect()


def test_code_range(spark):
    df = spark.createDataFrame([(0, "300"), (1, "2")], "obs_id bigint, rx_type string")
    rows = dc.decode_observations(df, with_rejects=True).orderBy("obs_id").collect()
    assert rows[0]["rx_type"] is None and rows[0]["rx_type__reject"] is True
    assert rows[1]["rx_type"] == 2


def _write_csv(spark, path, rows, cols):
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


ROW = {"dvec": "[1,2,3]", "rx_type": "0", "link_state": "2", "los_pl": "100", "los_ang": "[0,0,0,0]",
       "los_dly": "1e-6", "nlos_pl": "[150]", "nlos_ang": "[[1,2,3,4]]", "nlos_dly": "[2e-6]"}


def test_missing_column_permuted_and_missing_path(spark, tmpdir_path):
    cols = list(ROW)
    a = f"{tmpdir_path}/a.csv"
    b = f"{tmpdir_path}/b.csv"
    c = f"{tmpdir_path}/c.csv"
    _write_csv(spark, a, [tuple(ROW[k] for k in cols)], cols)
    nb = [k for k in cols if k != "los_dly"]
    _write_csv(spark, b, [tuple(ROW[k] for k in nb)], nb)
    rc = list(reversed(cols))
    _write_csv(spark, c, [tuple(ROW[k] for k in rc)], rc)
    with pytest.warns(UserWarning):
        d = sio.load_observations(spark, [a, b, c, f"{tmpdir_path}/nope.csv"])
    rows = d.collect()
    assert len(rows) == 2
    assert all(r["dvec"] == [1.0, 2.0, 3.0] and r["link_state"] == 2 for r in rows)
    with pytest.raises(RuntimeError):
        sio.load_observations(spark, [f"{tmpdir_path}/nope.csv"])


def test_format_by_suffix():
    assert sio.format_of("x.CSV") == "csv"
    assert sio.format_of("x", "csv") == "csv" and sio.format_of("x", ".csv") == "csv"
    with pytest.raises(ValueError):
        sio.format_of("noext")
    with pytest.raises(ValueError):
        sio.format_of("x.xlsx")


def test_save_refuses_empty(spark, tmpdir_path):
    df = spark.createDataFrame([], "obs_id bigint, dvec array<float>")
    with pytest.raises(ValueError):
        sio.save_observations(df, f"{tmpdir_path}/e.csv")


def test_all_no_link_errors(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "obs_id bigint, link_state int")
    with pytest.raises(ValueError, match="No valid links"):
        sa.require_rows(sa.keep_linked(df))


def test_split_sizes(spark):
    df = spark.range(10).withColumnRenamed("id", "obs_id")
    parts = sa.split_frames(df, val_ratio=0.2, test_ratio=0.1, seed=42)
    assert [p.count() for p in parts] == [7, 2, 1]
    assert sa.split_cuts(15000, 0.2, 0.0) == (12000, 15000)


@pytest.mark.parametrize("val,test", [(0.6, 0.4), (-0.1, 0.0), (1.1, 0.0)])
def test_bad_ratios(val, test):
    with pytest.raises(ValueError):
        sa.split_cuts(10, val, test)


def test_augmentation_tiny_n(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0, 1) for i in range(9)],
                               "obs_id bigint, dvec array<double>, rx_type int, link_state int")
    assert sa.augment_los_zero(df, frac=0.1).count() == 9


def test_augmentation_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, float(i) - 50], 0, 1) for i in range(100)],
                               "obs_id bigint, dvec array<double>, rx_type int, link_state int")
    out = sa.augment_los_zero(df, frac=0.1, label="los")
    add = out.where("aug_index is not null").collect()
    assert len(add) == 10
    assert all(r["dvec"][0] == 0.0 and r["dvec"][1] == 0.0 and r["dvec"][2] >= 0 and r["link_state"] == 2 for r in add)


def test_constant_slot_min_max_and_zero_variance(spark):
    df = spark.createDataFrame([([5.0, 1.0],), ([5.0, 3.0],)], "v array<double>")
    mm = fe.fit_min_max(df, "v")
    assert [r[0] for r in df.select(fe.min_max_transform(F.col("v"), mm)[0]).collect()] == [0.0, 0.0]
    st = fe.fit_standard(df, "v")
    assert st.scale[0] == 1.0
    assert [r[0] for r in df.select(fe.standard_transform(F.col("v"), st)[0]).collect()] == [0.0, 0.0]
    assert st.scale[1] == pytest.approx(1.0) and st.var[1] == pytest.approx(1.0)


def test_d3d_clamped(spark):
    df = spark.createDataFrame([([0.5, 0.0, 0.0],)], "dvec array<double>")
    base = df.select(fe.condition_base(F.col("dvec"), F.lit(1.0))).first()[0]
    assert base[0] == 1.0 and base[1] == 0.0


@pytest.mark.parametrize("n", [1, 19, 20, 100])
def test_timing_stats(spark, n):
    import statistics
    vals = [float((i * 37) % 101) + 0.5 for i in range(n)]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    r = me.timing_stats(df, ["g"], "v").first()
    s = sorted(vals)
    assert r["count"] == n
    assert r["median_ms"] == pytest.approx(statistics.median(vals))
    assert r["stddev_ms"] == pytest.approx(statistics.stdev(vals) if n > 1 else 0.0)
    assert r["p95_ms"] == (s[int(0.95 * n)] if n >= 20 else s[-1])
    assert r["p99_ms"] == (s[int(0.99 * n)] if n >= 100 else s[-1])


def test_head_sort(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 9.0, 8.0],)], "x array<double>")
    assert df.select(head_sort(F.col("x"), 3)).first()[0] == [3.0, 2.0, 1.0, 9.0, 8.0]
    with pytest.raises(ValueError):
        head_sort(F.col("x"), 0)


def test_class_absent_from_truth(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 2)], "label int, prediction int")
    rep = {r["class"]: r for r in me.classification_report(df).collect()}
    assert rep["LOS"]["recall"] == 0.0 and rep["LOS"]["support"] == 0
    acc = {r["label"]: r["accuracy"] for r in me.per_class_accuracy(df).collect()}
    assert acc[2] is None and acc[0] == 1.0
    cm = {r["label"]: (r["pred_0"], r["pred_1"], r["pred_2"]) for r in me.confusion_matrix(df).collect()}
    assert cm == {0: (1, 0, 0), 1: (0, 1, 1), 2: (0, 0, 0)}


def test_config_checks():
    from skychan.schema import ChannelConfig
    with pytest.raises(ValueError):
        ChannelConfig(frequency=0)
    with pytest.raises(ValueError):
        ChannelConfig(add_zero_los_frac=1.5)
    assert ChannelConfig().wavelength == pytest.approx(2.99792458e8 / 28e9)


@pytest.mark.parametrize("n,sizes", [(0, [0, 0]), (1, [0, 1]), (10, [8, 2]), (15000, [12000, 3000])])
def test_split_sizes_two_way(spark, n, sizes):
    df = spark.range(n).withColumnRenamed("id", "obs_id")
    s = sa.exact_split(df, val_ratio=0.2, seed=42)
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert [got.get("train", 0), got.get("val", 0)] == sizes


def test_timing_stats_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert me.timing_stats(df, ["g"], "v").count() == 0


def test_read_history_layout(spark, tmpdir_path):
    import json
    path = f"{tmpdir_path}/saved_history.json"
    with open(path, "w") as f:
        json.dump({"config": {"seed": 42}, "history": {"accuracy": [0.6, 0.7, 0.69], "loss": [0.9, 0.7, 0.71],
                                                        "val_accuracy": [0.65, 0.69, 0.68]}}, f, indent=2)
    h = me.read_history(spark, path)
    rows = h.orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == [1, 2, 3] and rows[1]["val_accuracy"] == 0.69
    assert me.best_epoch(h, "val_accuracy").first()["epoch"] == 2


def test_reads_index_column_layout(tmpdir_path, spark):
    """CSV as a pandas writer leaves it: an unnamed leading index column, arrays
    as JSON lists, an unknown receiver code 2 (kept; flagged by validate)."""
    import csv
    import json
    path = f"{tmpdir_path}/obs.csv"
    cols = list(ROW)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow([""] + cols)
        for i, rx in enumerate(("0", "1", "2")):
            r = dict(ROW, rx_type=rx, nlos_pl=json.dumps([150.5] * 20))
            w.writerow([i] + [r[c] for c in cols])
    d = sio.load_observations(spark, path)
    rows = d.orderBy("rx_type").collect()
    assert [r["rx_type"] for r in rows] == [0, 1, 2]
    assert rows[0]["nlos_pl"] == [150.5] * 20
    from skychan.operators.quality import validate
    rep = validate(d.drop("_source_file", "obs_id")).first()
    assert rep["n_bad_code"] == 1


def _csv_file(path, cols, rows):
    import csv
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(cols)
        w.writerows([[r[c] for c in cols] for r in rows])


def test_folder_with_permuted_and_lacking_headers(tmpdir_path, spark):
    """Files of one folder bind by name, a file without a column drops out, formats may be mixed,
    and the stream makes the same keys as the batch reader wherever the files lie."""
    import json
    import os
    import shutil
    row = dict(ROW, rx_type="0", link_state="2", nlos_pl=json.dumps([150.5] * 20))
    folder = f"{tmpdir_path}/in put"
    os.mkdir(folder)
    cols = list(row)
    _csv_file(f"{folder}/a.csv", cols, [row])
    _csv_file(f"{folder}/b.csv", cols[::-1], [row, dict(row, rx_type="1.0")])
    _csv_file(f"{folder}/c.csv", [c for c in cols if c != "los_dly"], [row])
    with pytest.warns(UserWarning, match="los_dly"):
        d = sio.load_observations(spark, folder, fmt="csv")
    got = sorted((r["rx_type"], r["link_state"], r["nlos_pl"] == [150.5] * 20) for r in d.collect())
    assert got == [(0, 2, True), (0, 2, True), (1, 2, True)]
    with pytest.raises(RuntimeError, match="los_dly"):
        sio.load_observations(spark, folder, fmt="csv", strict=True)
    one = f"{tmpdir_path}/one"
    os.mkdir(one)
    shutil.copy(f"{folder}/b.csv", f"{one}/b.csv")
    keys = sorted(r["obs_id"] for r in d.collect() if r["_source_file"].endswith("b.csv"))
    from skychan.streaming.ingest import ingest
    s = ingest(spark, one, f"{tmpdir_path}/out", f"{tmpdir_path}/ck")
    assert sorted(r["obs_id"] for r in s.collect()) == keys
    sio.save_observations(d.drop("_source_file"), f"{tmpdir_path}/p.parquet")
    both = sio.load_observations(spark, [f"{one}/b.csv", f"{tmpdir_path}/p.parquet"])
    assert both.count() == 5 and both.filter("link_state = 2").count() == 5


def test_null_and_short_paths_keep_their_slots(spark):
    """Short, NULL and partly NULL paths: vectors have 120 slots, blocks keep their place, inverses hold."""
    from skychan.operators import features as fe
    full = [[10.0, 80.0, -20.0, 100.0]] * 20
    rows = [(1, [100.0, 50.0, 30.0], 0, 2, [90.0 + i for i in range(20)], full, [1e-6 + i * 1e-8 for i in range(20)]),
            (2, [100.0, 50.0, 30.0], 1, 1, [99.0, 97.0], [full[0], full[0][:3]], [2e-6, None]),
            (3, [10.0, 5.0, 3.0], 1, 1, None, None, None),
            (4, None, 0, 1, [99.0], [None], [2e-6])]
    df = spark.createDataFrame(rows, "obs_id bigint, dvec array<double>, rx_type int, link_state int, nlos_pl array<double>, nlos_ang array<array<double>>, nlos_dly array<double>")
    pp = fe.fit_path_preproc(df)
    path = f"{tempfile.mkdtemp(prefix='skychan-test-')}/pp"
    pp.save(spark, path)
    assert fe.PathPreproc.load(spark, path) == pp
    d = fe.data_vector(df, pp, dtype="double")
    x = {r["obs_id"]: r["x"] for r in d.collect()}
    assert all(len(v) == 120 for v in x.values())
    assert [i for i, v in enumerate(x[2]) if v is not None] == [0, 1, 20, 21, 40, 41, 60, 80, 100]
    assert x[3] == [None] * 120 and x[4][100] is None and x[4][0] is not None
    inv = {r["obs_id"]: r for r in fe.data_vector_inverse(d, pp, sort=False).collect()}
    assert inv[2]["nlos_pl_hat"][2] is None
    assert inv[2]["nlos_pl_hat"][:2] == pytest.approx([99.0, 97.0])
    assert inv[2]["nlos_ang_hat"][0] == pytest.approx(full[0]) and inv[2]["nlos_ang_hat"][1][3] is None


def test_model_with_null_features(spark):
    from skychan.operators.model import LinkStateModel
    rows = [(i, [float(i % 40) * 30, 5.0, 3.0], i % 2, 2 if i % 40 < 20 else 1) for i in range(200)]
    df = spark.createDataFrame(rows + [(900, None, 0, 1), (901, [1.0, 2.0, 3.0], 0, None)],
                               "obs_id bigint, dvec array<double>, rx_type int, link_state int")
    m = LinkStateModel(max_iter=20, augment="none").fit(df)
    assert m.n_left_out == 2
    p = {r["obs_id"]: r for r in m.predict_proba(df).collect()}
    assert len(p) == 202 and p[900]["prediction"] is None and p[900]["probability"] is None
    assert p[901]["prediction"] is not None and sum(p[5]["probability"]) == pytest.approx(1.0)
