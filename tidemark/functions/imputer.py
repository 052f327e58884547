"""Median imputation as a persistable ``pyspark.ml`` stage, with exact medians."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles_of


class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the exact median of every input column (nulls and NaN are missing), all columns in the same passes."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "MedianImputerModel":
        cols = self.getInputCols()
        medians = exact_quantiles_of(dataset, cols, [0.5])
        # a column without any value is filled with 0, as it carries nothing to learn
        return MedianImputerModel(inputCols=cols, outputCols=self.getOutputCols(), medians=[medians[c][0] or 0.0 for c in cols])


class MedianImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Puts the learned medians in place of missing values."""

    medians = Param(Params._dummy(), "medians", "median of each input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCols: list[str] | None = None, medians: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = {}
        for c, out, m in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.medians)):
            x = F.col(c).cast("double")
            filled[out] = F.coalesce(F.when(~F.isnan(x), x), F.lit(m))
        return dataset.withColumns(filled)
