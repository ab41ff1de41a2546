"""Stand-in frames and their log lines: rendered without formatters, and once for queries that read them several times."""

from pyspark.sql import functions as F

from canlake.plans import standin as st
from canlake.plans.catalog import sources


def test_texts_equal_those_of_a_formatter(spark):
    numbers = spark.sql("SELECT * FROM VALUES (0L, 0D), (10L, 1704067211.172425D), (255L, 1704067199.999999D), (2047L, -1.5D), (NULL, NULL) AS t(n, s)")
    for row in numbers.select(
        st.hex_text(F.col("n"), 2), F.format_string("%02X", "n"), st.hex_text(F.col("n"), 3), F.format_string("%03X", "n"),
        st.seconds_text(F.col("s")), F.format_string("%.6f", "s"),
    ).collect():
        assert (row[0], row[2], row[4]) == (row[1], row[3], row[5])


def test_frames_and_lines_use_no_formatter(spark, sf_dir):
    lines = st.log_lines(spark, sf_dir, "hcrl_carhacking")
    assert "format_string" not in lines._jdf.queryExecution().optimizedPlan().toString()


def test_dialects_share_the_rendered_frames(spark, sf_dir):
    plan = sources.frames_per_dialect(spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    assert "get_json_object" not in plan.toString()
