"""Lineage cut between the passes of a plan, so that each pass runs once, whatever reads it after."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the folder that spark.checkpoint.dir or setCheckpointDir names; a local one only in local mode."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="blockloom-cuts-"))
    return df.checkpoint()
