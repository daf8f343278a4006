"""The isolation forest as a stage of an MLlib pipeline, with its own files."""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators.forest import IsolationForestModel

FORMAT = 1  # raised when the files of a stage change their meaning


class IsolationForestStage(Model, MLWritable, MLReadable):
    """Adds anomaly_score, decision and is_anomaly; saved and loaded with the pipeline that holds it."""

    def __init__(self, model: IsolationForestModel | None = None):
        super().__init__()
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.model.transform(dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: IsolationForestStage):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        DefaultParamsWriter.saveMetadata(self.instance, path, spark, extraMetadata={"format": FORMAT})
        self.instance.model.save(spark, f"{path}/forest")


class _Reader(MLReader):
    def __init__(self, kind: type[IsolationForestStage]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> IsolationForestStage:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        if metadata.get("format") != FORMAT:
            raise ValueError(f"forest of format {json.dumps(metadata.get('format'))} at {path}, this version reads {FORMAT}")
        stage = self.kind(IsolationForestModel.load(spark, f"{path}/forest"))
        stage._resetUid(metadata["uid"])
        return stage
