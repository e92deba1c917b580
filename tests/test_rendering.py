"""Rendered text of every document type."""

import os

import compare
from dossierlens.catalog import CHECKS, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_types_and_layouts_are_rendered(spark):
    name, con = "y05_render_all_documents", compare.connection(SF_DIR)
    assert compare.differences(spark, con, SF_DIR, QUERIES[name], CHECKS[name]) == ""
    assert QUERIES[name](spark, SF_DIR).where("ocr_text is null").count() == 0
    assert QUERIES[name](spark, SF_DIR).count() == con.execute("SELECT count(*) FROM lineitem").fetchone()[0]
