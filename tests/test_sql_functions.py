from datetime import datetime

from pyspark.sql import functions as F

from dossierlens.functions import sql

AS_OF = datetime(2026, 1, 1, 9)
VALUES = {
    "STRING": ["73282932000074", "35600000000007", "35600000000001", "732.829-320", None, "AGRIFRPP", "AGRI FRPP 75A", "", "FR44732829320", "732829320",
               "FR7630006000011234567890189", "30006000011234567890189", "2020-01-01", "2025-12-20", "13/02/1985", "1 mar 2024", "12 000 000,50", "URSSAF",
               "no 1O3 4567 l8B. Olivier", "it's \\ a 'quote'"],
    "DOUBLE": [None, 0.0, 20.0, 19.8, 1000.0, 200.0, 1205.5, -1.0, 0.5], "INT": [None, -1, 0, 7, 14, 30, 31]}


def test_every_function_agrees_with_its_column(spark):
    sql.register(spark, AS_OF)
    assert len(sql.FUNCTIONS) >= 17
    for name, (parameters, build) in sql.FUNCTIONS.items():
        kinds = [p.split() for p in parameters.split(", ")]
        longest = max(len(VALUES[k]) for _, k in kinds)
        # Rows in which the parameters meet in different combinations.
        rows = [tuple(VALUES[k][(i + i * n // 7 + n) % len(VALUES[k])] for n, (_, k) in enumerate(kinds)) for i in range(longest * 3)]
        df = spark.createDataFrame(rows, parameters)
        names = [p for p, _ in kinds]
        for row in df.select(F.expr(f"{name}({', '.join(names)})").alias("a"), build(AS_OF, *[F.col(n) for n in names]).alias("b")).collect():
            assert row.a == row.b, name


def test_functions_run_from_plain_sql(spark):
    sql.register(spark, AS_OF)
    got = spark.sql("SELECT rate_plausible(100, 20), rate_plausible(100, 50), parse_iso('2024-02-30'), "
                    "parse_iso('2024-02-28'), urgency(8), expiry_bucket(NULL), iban_format('FR7630006000011234567890189').ok").first()
    assert (got[0], got[1], got[2], str(got[3]), got[4], got[5], got[6]) == (True, False, None, "2024-02-28", "Urgent", "warning", True)
    plan = spark.sql("SELECT siret_luhn(concat('7328293200007', id)) FROM range(10)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
