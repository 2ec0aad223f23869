"""Document and timeline alignment on Spark DataFrames."""

import os


def worker_path(spark) -> None:
    """Let Python workers import this package when it runs from a source tree."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
