"""Queries as the first of a session, whose columns have the numbers that Spark also gives to the variables of lambda functions."""

import subprocess
import sys

from tests.compare import query_rows, sql_rows
from tests.conftest import ROOT

FIRST = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
import __spark_entry__
__spark_entry__.queries()[sys.argv[1]](spark, sys.argv[2]).write.parquet(sys.argv[3])
"""


def test_study_area_points_first_in_a_session(spark, tiny, tmp_path):
    import __spark_entry__

    run = subprocess.run([sys.executable, "-c", FIRST, "study_area_points", tiny, str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert query_rows(spark.read.parquet(str(tmp_path / "out"))) == sql_rows(__spark_entry__.oracle_sql()["study_area_points"], tiny)
