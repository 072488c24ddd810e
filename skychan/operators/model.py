"""Link-state classifier and composite channel pipeline.

The classifier is Spark ML's ``MultilayerPerceptronClassifier`` with layers
``[2R, 25, 10, 3]``. Its hidden layers are sigmoid and its solver is L-BFGS
(the reference uses ReLU and Adam): same capability, different weights, so
accuracies are not comparable across the two. Features are built and scaled
by the column operators of ``features``; the fitted scaler travels as
literals, the network as a Spark ML model.
"""
from __future__ import annotations

import json
from dataclasses import asdict
from typing import Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nn import argmax, inverse_cdf_draw, sparse_cross_entropy_row
from ..functions.uniform import hash_uniform
from ..schema import ChannelConfig
from ..session import work_path
from ..sources.decode import normalize_rx
from . import features as fe
from .sampling import augment_los_zero

MODEL_VERSION = "1"
PIECE_ROWS = 50_000


class LinkStateModel:
    """Predicts NO_LINK / NLOS / LOS from the Tx->Rx vector and receiver type."""

    def __init__(self, config: ChannelConfig | None = None, max_iter: int = 50, block_size: int = 512,
                 on_unknown_rx: str = "error", augment: str = "train"):
        self.config = config or ChannelConfig()
        self.max_iter = max_iter
        self.block_size = block_size
        self.on_unknown_rx = on_unknown_rx
        self.augment = augment          # "train" (default), "all" (P4 parity) or "none"
        self.scaler: fe.StandardState | None = None
        self.model: MultilayerPerceptronClassificationModel | None = None
        self.history: list[float] = []
        self.epochs: dict[str, list[float]] = {}     # metrics after each epoch, see fit_epochs
        self.n_train = self.n_val = 0
        self.n_left_out = 0

    @property
    def layers(self) -> list[int]:
        return [2 * len(self.config.rx_types), *self.config.n_unit_links, 3]

    # ------------------------------------------------------------ features
    def _raw_features(self, df: DataFrame, augment: bool) -> DataFrame:
        d = df.withColumn("_rx", normalize_rx(F.col("rx_type"), self.on_unknown_rx))
        if augment:
            d = augment_los_zero(d, frac=self.config.add_zero_los_frac, seed=self.config.seed)
        return fe.link_features(d, rx="_rx", categories=self.config.rx_types, out="_f")

    def _scaled(self, d: DataFrame) -> DataFrame:
        """``features`` as a vector; ``_bad`` marks rows whose features hold a NULL (zeros stand in)."""
        x = fe.standard_transform(F.col("_f"), self.scaler)
        return d.withColumn("_bad", F.exists("_f", lambda v: v.isNull())).withColumn(
            "features", array_to_vector(F.transform(x, lambda v: F.coalesce(v, F.lit(0.0)))))

    # ------------------------------------------------------------ fit / predict
    def fit(self, train: DataFrame) -> "LinkStateModel":
        """M1: fit on the training part (the only part the scaler sees). Rows whose features or label are
        NULL take no part; ``n_left_out`` counts them. Only the four columns used are read."""
        d = self._raw_features(train.select("obs_id", "dvec", "rx_type", "link_state"), self.augment in ("train", "all"))
        whole = F.col("label").isNotNull() & ~F.exists("_f", lambda v: v.isNull())
        raw = d.select("_f", F.col("link_state").cast("double").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.n_left_out = raw.filter(~whole).count()
            used = raw.filter(whole)
            self.scaler = fe.fit_standard(used, "_f", 2 * len(self.config.rx_types))
            mlp = MultilayerPerceptronClassifier(layers=self.layers, maxIter=self.max_iter,
                                                 blockSize=self.block_size, seed=self.config.seed)
            data = self._scaled(used).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                self.model = mlp.fit(data)
                self.history = list(self.model.summary().objectiveHistory)
            finally:
                data.unpersist()
        finally:
            raw.unpersist()
        return self

    def fit_epochs(self, train: DataFrame, val: DataFrame, epochs: int = 50, batch_size: int | None = None, learning_rate: float = 0.03,
                   solver: str = "l-bfgs", steps: int = 2, keep_best: bool = True) -> "LinkStateModel":
        """M1 with the metrics of every epoch (E6): an epoch takes the weights through all batches of the training part in turn, then
        loss and accuracy of both parts are taken with the weights it ended at (``epochs``: loss, accuracy, val_loss, val_accuracy).

        Rows are dealt by hash to ``ceil(rows / batch_size)`` batches (all rows in one without a size), the same in each epoch, and stored by
        batch, so a step reads its own rows only. In a batch Spark sums the gradients of all its rows ``steps`` times:
        by L-BFGS, or with ``solver="gd"`` by descent at ``learning_rate``. A step is a job, so choose batches of at least some
        100,000 rows on a cluster. ``keep_best``: the model ends with the weights of the epoch of the highest validation accuracy
        (the first of equal ones). Rows whose features or label are NULL take no part; neither do validation rows of that kind."""
        spark = train.sparkSession
        used, self.n_left_out = self._complete(self._raw_features(self._columns(train), self.augment in ("train", "all")), "epochs-train")
        held, _ = self._complete(self._raw_features(self._columns(val), self.augment == "all"), "epochs-val")
        self.scaler = fe.fit_standard(used, "_f", 2 * len(self.config.rx_types))
        self.n_train, self.n_val = used.count(), held.count()
        if not self.n_train:
            raise ValueError("no training row has all features and a label")
        batches = 1 if batch_size is None else max(1, -(-self.n_train // batch_size))
        path = work_path(spark, "epochs")
        dealt = F.pmod(F.xxhash64(F.lit(self.config.seed), "_key"), F.lit(batches)).cast("int")
        # a batch is a folder of files of about PIECE_ROWS rows each, so that many tasks write it and many read it in every step
        pieces = -(-self.n_train // (batches * PIECE_ROWS))
        piece = F.pmod(F.xxhash64(F.lit(self.config.seed + 1), "_key"), F.lit(pieces))
        table = self._scaled(used).select(F.col("_f").alias("raw"), F.transform(vector_to_array("features"), lambda v: v).alias("x"), "label",
                                          dealt.alias("batch"), piece.alias("piece"))
        table.repartition(batches * pieces, "batch", "piece").drop("piece").write.partitionBy("batch").parquet(path)
        rows = spark.read.parquet(path)
        each = [rows.filter(F.col("batch") == b).select(array_to_vector("x").alias("features"), "label") for b in sorted(r[0] for r in rows.select("batch").distinct().collect())]
        both = (rows.select(F.lit("").alias("part"), array_to_vector("x").alias("features"), "label")
                .unionByName(self._scaled(held).select(F.lit("val_").alias("part"), "features", "label"))).persist(StorageLevel.MEMORY_AND_DISK)
        self.epochs = {m: [] for m in ("loss", "accuracy", "val_loss", "val_accuracy")}
        self.history, best, weights = [], None, None
        try:
            for _ in range(epochs):
                for batch in each:
                    mlp = MultilayerPerceptronClassifier(layers=self.layers, maxIter=steps, blockSize=self.block_size, seed=self.config.seed,
                                                         solver=solver, stepSize=learning_rate)
                    if weights is not None:
                        mlp = mlp.setInitialWeights(weights)
                    self.model = mlp.fit(batch)
                    weights = self.model.weights
                found = self._metrics(both)
                for m, values in self.epochs.items():
                    values.append(found.get(m))
                score = found.get("val_accuracy", found["accuracy"])
                if best is None or score > best[0]:
                    best = (score, self.model)
        finally:
            both.unpersist()
        self.history = list(self.epochs["loss"])
        if keep_best and best is not None:
            self.model = best[1]
        return self

    @staticmethod
    def _columns(df: DataFrame) -> DataFrame:
        return df.select("obs_id", "dvec", "rx_type", "link_state")

    def _complete(self, d: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Stored features and labels of the rows that have all of them, and how many have not."""
        whole = F.col("label").isNotNull() & ~F.exists("_f", lambda v: v.isNull())
        path = work_path(d.sparkSession, name)
        (d.select(F.coalesce(F.col("obs_id").cast("string"), F.lit("")).alias("_key"), "_f", F.col("link_state").cast("double").alias("label"))
         .withColumn("_whole", F.coalesce(whole, F.lit(False))).write.parquet(path))
        rows = d.sparkSession.read.parquet(path)
        return rows.filter("_whole").drop("_whole"), rows.filter("NOT _whole").count()

    def _metrics(self, both: DataFrame) -> dict[str, float]:
        """Mean cross-entropy and accuracy of each part under the present weights: one aggregate."""
        p = self.model.transform(both).select("part", "label", vector_to_array("probability").alias("p"))
        loss = sparse_cross_entropy_row(F.col("p"), F.col("label").cast("int"))
        right = (argmax(F.col("p")) == F.col("label")).cast("double")
        out = {}
        for r in p.groupBy("part").agg(F.avg(loss).alias("loss"), F.avg(right).alias("accuracy")).collect():  # two rows
            out[f"{r.part}loss"], out[f"{r.part}accuracy"] = r.loss, r.accuracy
        return out

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """M2: ``probability`` as an array<double>, plus ``prediction`` (M4); both NULL where a feature is."""
        if self.model is None or self.scaler is None:
            raise RuntimeError("model not fitted")
        out = self.model.transform(self._scaled(self._raw_features(df, self.augment == "all")))
        p = F.when(~F.col("_bad"), vector_to_array(F.col("probability")))
        return out.withColumn("probability", p).withColumn("prediction", argmax(F.col("probability"))).drop(
            "features", "rawPrediction", "_bad", "_f", "_rx")

    def sample_link_state(self, df: DataFrame, seed: int | None = None) -> DataFrame:
        """M5: draw a state from the predicted probabilities (inverse CDF,
        seeded uniform per observation)."""
        s = self.config.seed if seed is None else seed
        p = self.predict_proba(df)
        return p.withColumn("sampled_state", inverse_cdf_draw(F.col("probability"),
                                                              hash_uniform(s, "state", F.col("obs_id"))))

    # ------------------------------------------------------------ persistence (M6)
    def save(self, spark: SparkSession, path: str) -> None:
        if self.model is None:
            raise RuntimeError("model not fitted")
        self.model.write().overwrite().save(f"{path}/mlp")
        fe.save_states(spark, {"link_scaler": self.scaler}, f"{path}/states")
        cfg = asdict(self.config)
        meta = {"version": MODEL_VERSION, "config": cfg, "history": self.history, "max_iter": self.max_iter,
                "block_size": self.block_size, "on_unknown_rx": self.on_unknown_rx, "augment": self.augment, "epochs": self.epochs}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LinkStateModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta.get("version") != MODEL_VERSION:
            import warnings
            warnings.warn(f"model version {meta.get('version')} differs from {MODEL_VERSION}")
        cfg = {k: v for k, v in meta["config"].items() if k in ChannelConfig.__dataclass_fields__}
        cfg = ChannelConfig(**{**cfg, "rx_types": tuple(cfg["rx_types"]), "n_unit_links": tuple(cfg["n_unit_links"])})
        m = cls(cfg, meta["max_iter"], meta["block_size"], meta["on_unknown_rx"], meta["augment"])
        m.scaler = fe.load_states(spark, f"{path}/states")["link_scaler"]
        m.model = MultilayerPerceptronClassificationModel.load(f"{path}/mlp")
        m.history = meta.get("history", [])
        m.epochs = meta.get("epochs", {})
        return m

    def history_frame(self, spark: SparkSession) -> DataFrame:
        """Training history as one row of arrays (the saved JSON layout)."""
        if self.epochs:
            return spark.createDataFrame([tuple(self.epochs.values())], ", ".join(f"{m} array<double>" for m in self.epochs))
        return spark.createDataFrame([(self.history,)], "loss array<double>")


class ChannelModel:
    """M7: link model plus path-model transforms under one configuration."""

    def __init__(self, config: ChannelConfig | None = None, **link_kw):
        self.config = config or ChannelConfig()
        self.link = LinkStateModel(self.config, **link_kw)
        self.path: fe.PathPreproc | None = None

    def fit(self, train: DataFrame) -> "ChannelModel":
        from .sampling import keep_linked, require_rows
        self.link.fit(train)
        linked = require_rows(keep_linked(train))
        self.path = fe.fit_path_preproc(linked, self.config.max_path_loss, self.config.n_max_paths)
        return self

    def path_input(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Generator input (obs_id, cond, x) of the linked rows."""
        if self.path is None:
            raise RuntimeError("path transforms not fitted")
        return fe.train_frame(df, self.path, keep=keep)

    def save(self, spark: SparkSession, path: str) -> None:
        if self.path is None:
            raise RuntimeError("path transforms not fitted")
        self.link.save(spark, f"{path}/link")
        self.path.save(spark, f"{path}/path")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ChannelModel":
        link = LinkStateModel.load(spark, f"{path}/link")
        m = cls(link.config)
        m.link, m.path = link, fe.PathPreproc.load(spark, f"{path}/path")
        return m
