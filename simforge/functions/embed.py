"""Embedding generation (SURVEY V1, provider (b) of M9).

The model is the user's: a factory builds it once per Python worker, and
``predict_batch_udf`` feeds it Arrow batches. The output length is checked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ModelFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]


def embedding_udf(model_factory: ModelFactory, dim: int, batch_size: int = 256):
    """A column function from inputs to vectors of ``dim`` doubles.

    ``model_factory()`` returns ``predict(inputs) -> (len(inputs), dim)``.
    """

    def checked():
        predict = model_factory()

        def run(inputs: np.ndarray) -> np.ndarray:
            out = np.asarray(predict(inputs), dtype=np.float64)
            if out.shape != (len(inputs), dim):
                raise ValueError(f"the model returned shape {out.shape}, not {(len(inputs), dim)}")
            return out

        return run

    return predict_batch_udf(checked, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)


def embed(df: DataFrame, column: str, model_factory: ModelFactory, dim: int,
          out: str = "ml_generate_embedding_result", batch_size: int = 256) -> DataFrame:
    """V1: ``df`` with the embedding of ``column``; a null input is embedded as an empty string."""
    model = embedding_udf(model_factory, dim, batch_size)
    return df.withColumn(out, model(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def char_count_model(dim: int = 16) -> ModelFactory:
    """A small deterministic model: how many characters have each code modulo ``dim``."""

    def factory():
        def predict(inputs: np.ndarray) -> np.ndarray:
            out = np.zeros((len(inputs), dim))
            for i, text in enumerate(inputs):
                np.add.at(out[i], np.frombuffer(str(text).encode("utf-32-le"), np.uint32) % dim, 1.0)
            return out

        return predict

    return factory
