"""Signal measures over a table of recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.signal import RATE, measures, print_words
from corpusloom.plans.catalogue import Catalogue, table

SIGNALS = Catalogue()


def tones(embeddings: DataFrame, seconds: int = 2) -> DataFrame:
    """``(vec_id, samples)``: a tone for each vector, its components the shares of the partials of 55 Hz."""
    at = np.arange(RATE * seconds) / RATE
    partials = np.sin(2 * np.pi * 55 * np.outer(np.arange(1, 65), at)).astype(np.float32)

    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: 0.2 * (np.asarray(v, np.float32) @ partials[: len(v)]))

    return embeddings.select("vec_id", F.pandas_udf(run, "array<float>")("embedding").alias("samples"))


@SIGNALS.query("dsp_measures")
def q_measures(spark: SparkSession, d: str) -> DataFrame:
    """Loudness, pitch, timbre and length of the print of every recording (no SQL twin: Fourier transforms)."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding").repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes, much work
    t = tones(vectors)
    return t.select("vec_id", measures("samples").alias("m"), F.size(print_words("samples")).alias("print_words")).select("vec_id", "m.*", "print_words")
