"""Leaf-wise boosted trees as a pipeline stage: one model for all rows."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glucospan.operators import boosting
from glucospan.storage import stored


class _Shared(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    pass


class LeafwiseRegressor(
    Estimator, _Shared, HasSeed, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable
):
    """Histogram boosting with a cap on leaves and an L2 penalty. Nothing is drawn at random, so ``seed`` has
    no effect; it is there so that tree models can be exchanged."""

    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "L2 penalty of a leaf's value", TypeConverters.toFloat)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "fewest rows of a leaf", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, at most 256", TypeConverters.toInt)
    ownTask = Param(Params._dummy(), "ownTask", "training rows up to which one task fits the model", TypeConverters.toInt)

    @keyword_only
    def __init__(self, **options):
        super().__init__()
        usual = boosting.Settings()
        self._setDefault(
            maxIter=usual.rounds, stepSize=usual.step, maxLeaves=usual.leaves, l2=usual.l2,
            minInstancesPerNode=usual.least, maxBins=usual.bins, ownTask=usual.own_task,
        )
        self._set(**options)

    def getMaxLeaves(self) -> int:
        return self.getOrDefault(self.maxLeaves)

    def getL2(self) -> float:
        return self.getOrDefault(self.l2)

    def settings(self) -> boosting.Settings:
        return boosting.Settings(
            rounds=self.getMaxIter(), step=self.getStepSize(), leaves=self.getMaxLeaves(), l2=self.getL2(),
            least=self.getOrDefault(self.minInstancesPerNode), bins=self.getOrDefault(self.maxBins),
            own_task=self.getOrDefault(self.ownTask),
        )

    def _fit(self, dataset: DataFrame) -> LeafwiseModel:
        cells = vector_to_array(F.col(self.getFeaturesCol()))
        rows = dataset.select(cells.alias("_x"), F.col(self.getLabelCol()).cast("double").alias("_y"))
        first = rows.select(F.size("_x").alias("n")).first()
        if first is None:
            raise ValueError("no rows to fit on")
        names = [f"x{i}" for i in range(first["n"])]
        each = [F.col("_x")[i].alias(n) for i, n in enumerate(names)]
        rows = stored(rows.select(*each, "_y", F.lit(False).alias("_test")))
        found = boosting.models(rows, F.lit(0), names, "_y", "_test", self.settings()).first()
        if found is None:
            raise ValueError("no row has a target")
        model = LeafwiseModel()._set(trees=found["model"])
        return self._copyValues(model)


class LeafwiseModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Trees as text, so that the stage is saved and loaded with its parameters."""

    trees = Param(Params._dummy(), "trees", "first value, cut points and trees as JSON", TypeConverters.toString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = self.getOrDefault(self.trees)  # its size follows from rounds, leaves and bins alone

        @F.pandas_udf("double")
        def predicted(cells):
            import numpy as np
            import pandas as pd

            base, trees, cuts = _parsed(text)
            x = np.stack(cells.to_numpy()) if len(cells) else np.zeros((0, len(cuts)))
            return pd.Series(boosting.predict(boosting.binned(x, cuts), base, trees))

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(F.col(self.getFeaturesCol()))))


_LAST: tuple = ("", None)


def _parsed(text: str):
    """The model of a text; the last one stays parsed."""
    global _LAST
    if _LAST[0] != text:
        _LAST = text, boosting.from_json(text)
    return _LAST[1]
