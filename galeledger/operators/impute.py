"""Median imputation as pipeline stages, with medians from mergeable summaries.

A summary holds a feature's values of one fold in a bounded number of bytes, and summaries can be merged. So one pass over
the rows serves every fold: the medians of a fold's training rows come from the merged summaries of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expr import finite
from ..session import settle

ACCURACY = 4096  # parameter k of the summaries: ranks are right to about 0.1 %


def _summary(feature: str) -> Column:
    return F.kll_sketch_agg_double(finite(feature), F.lit(ACCURACY))


def _median(summary: Column) -> Column:
    """Median, 0 where nothing is known: a feature unknown in all training rows is constant."""
    some = F.coalesce(F.kll_sketch_get_n_double(summary), F.lit(0)) > 0
    return F.coalesce(F.when(some, F.kll_sketch_get_quantile_double(summary, F.lit(0.5))), F.lit(0.0))


def fold_medians(rows: DataFrame, fold: str, features: Sequence[str]) -> DataFrame:
    """(fold, medians): per fold, the medians of the features over the rows of all other folds.

    One pass makes a summary per (fold, feature); merges run from both ends, so each fold meets the
    summaries before and after it. A feature unknown in all other folds has median 0.
    """
    own = settle(rows.groupBy(fold).agg(*[_summary(f).alias(f"_s{i}") for i, f in enumerate(features)]), "fold-summaries")
    # One row per fold; the order is that of the folds.
    ordered = Window.partitionBy(F.lit(0)).orderBy(fold)
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    merged = own.select(fold, *[F.kll_merge_agg_double(f"_s{i}", F.lit(ACCURACY)).over(w).alias(f"_{n}{i}") for i in range(len(features)) for n, w in (("b", before), ("a", after))])
    both = lambda i: F.when(F.col(f"_b{i}").isNull(), F.col(f"_a{i}")).when(F.col(f"_a{i}").isNull(), F.col(f"_b{i}")).otherwise(F.kll_sketch_merge_double(f"_b{i}", f"_a{i}"))
    return merged.select(fold, F.array(*[_median(both(i)) for i in range(len(features))]).alias("medians"))


class _Filled(HasInputCols, HasOutputCols):
    """Shared names of the two stages."""

    def _named(self, features: Sequence[str]):
        return self._set(inputCols=list(features), outputCols=[f"_imp_{f}" for f in features])


class MedianFill(Model, _Filled, DefaultParamsReadable, DefaultParamsWritable):
    """Unknown and non-finite values become the median that was fitted."""

    medians = Param(Params._dummy(), "medians", "value per input column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = self.getOrDefault(self.medians)
        return dataset.withColumns({o: F.coalesce(finite(i), F.lit(v)) for i, o, v in zip(self.getInputCols(), self.getOutputCols(), values)})


def median_fill(features: Sequence[str], medians: Sequence[float]) -> MedianFill:
    return MedianFill()._named(features)._set(medians=[float(m) for m in medians])


class MedianImputer(Estimator, _Filled, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the medians of all input columns in one pass."""

    def _fit(self, dataset: DataFrame) -> MedianFill:
        names = self.getInputCols()
        got = dataset.agg(*[_summary(f).alias(f"_s{i}") for i, f in enumerate(names)]).select(*[_median(F.col(f"_s{i}")) for i in range(len(names))]).first()
        return median_fill(names, got)


def median_imputer(features: Sequence[str]) -> MedianImputer:
    return MedianImputer()._named(features)
