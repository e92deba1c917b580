import os

from dossierlens.operators.extraction import extract_company_name
from dossierlens.storage import WorkFolder, stage
from pyspark.sql import functions as F


def test_a_run_removes_its_stages(spark, tmp_path):
    with WorkFolder(spark) as work:
        work.root = str(tmp_path / "run")
        assert stage(spark.range(3), "numbers", work).count() == 3 and os.listdir(work.root)
    assert not os.path.exists(tmp_path / "run")


def test_company_is_found_behind_a_long_heading(spark):
    row = spark.range(1).select(extract_company_name(F.lit("x " * 1500 + "Durand Bois SARL")).alias("whole"),
                                extract_company_name(F.lit("x " * 1500 + "Durand Bois SARL"), 2000).alias("head")).first()
    assert row.whole == "Durand Bois SARL" and row.head is None
