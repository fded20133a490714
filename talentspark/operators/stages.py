"""Text steps as stages of a saved model, so that a loaded model takes raw texts.

Each is a native column expression; its settings are saved with it.
"""

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentspark.functions import redact
from talentspark.functions.text import simple_normalize, stop_alpha_normalize, text_sanitize


class _TextStage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    def expression(self, text: Column) -> Column:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.expression(F.col(f"`{self.getInputCol()}`")))


class CleanText(_TextStage):
    """Plain characters and single spaces only."""

    @keyword_only
    def __init__(self, inputCol="text", outputCol="clean"):
        super().__init__()
        self._set(**self._input_kwargs)

    def expression(self, text: Column) -> Column:
        return text_sanitize(text)


class RedactText(_TextStage):
    """Personal data replaced by labels, by the rules of ``variant`` (serving or dataset)."""

    variant = Param(Params._dummy(), "variant", "serving or dataset", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol="text", outputCol="clean", variant="serving"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, variant=variant)

    def expression(self, text: Column) -> Column:
        rules = {"serving": redact.redact_serving, "dataset": redact.redact_dataset}
        if self.getOrDefault("variant") not in rules:
            raise ValueError(f"variant {self.getOrDefault('variant')}: {' or '.join(rules)}")
        return rules[self.getOrDefault("variant")](text)


class NormalizeText(_TextStage):
    """Lower-case letters and single spaces; with ``stopWords`` also without these and without words of other characters."""

    stopWords = Param(Params._dummy(), "stopWords", "words that are left out", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCol="clean", outputCol="plain", stopWords=None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, stopWords=stopWords or [])

    def expression(self, text: Column) -> Column:
        stops = self.getOrDefault("stopWords")
        return stop_alpha_normalize(text, stops) if stops else simple_normalize(text)
