"""Ending a DataFrame's lineage in the cluster's checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint: computed once, read again by later steps, and kept when executors are lost.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where all runs in one process (tests) may none be set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="postmark-"))
    return df.checkpoint()
