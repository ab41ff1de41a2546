"""Paths, cells and row ids worked out without a regular expression for each line or a shuffle of all lines."""

import random
import re

from pyspark.sql import functions as F

from canlake.functions.hexfields import bare_hex
from canlake.plans import standin as st
from canlake.sources import captures, delimited, discovery
from canlake.sources.parsing import accepted, beyond, staged


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string").select("i", column.alias("v"))
    return [r["v"] for r in rows.orderBy("i").collect()]


def test_names_of_paths(spark):
    paths = ["/a/b/run.1.csv", "/a/.hidden", "/a/b.c/plain", "name.log", "/x/two..dots", "/x/ends.", "/x/é.ü.txt", "/", ""]
    names = [p.rsplit("/", 1)[-1] for p in paths]
    assert values(spark, paths, discovery.file_stem(F.col("value"))) == [re.sub(r"(?<=.)\.[^.]*$", "", n) for n in names]
    parts = [p.split("/") for p in paths]
    assert values(spark, paths, discovery.parent_folder(F.col("value"))) == [p[-2] if len(p) > 1 else "" for p in parts]


def test_files_with_signs_in_their_names(spark, tmp_path):
    for name in ("a+b.txt", "50%.txt", "x y.txt", "é.txt", "%2B.txt"):
        (tmp_path / name).write_text("1.0,0x1,1,00,R\n")
    lines = discovery.read_lines(spark, str(tmp_path), "survival_analysis")
    assert {r["session_id"] for r in lines.collect()} == {"a+b", "50%", "x y", "é", "%2B"}


def test_hex_and_cells_beyond(spark):
    texts = [" 0x1a ", "0X0X1", "x0x1", "", None, "0x"]
    assert values(spark, texts, bare_hex("value")) == ["1A", "0X1", "X0X1", "", None, ""]
    cells = F.split("value", ",", -1)
    assert values(spark, ["a,b,c", "a,b,  ", "a", "a,b,, ,x"], F.coalesce(beyond(cells, 2), F.lit(False))) == [True, False, False, True]


def test_survival_bytes_however_they_are_spaced(spark, tmp_path):
    lines = [
        "1.0,0001,8,00 0a ff 1 2 3 4 5", "1.1, 0002 ,3 , 0A,\tFf ,0b ,T", "1.2,0003,2,00\t0a  0b", "1.3,0004,3,0a,0B,aB,R",
        "1.4,0005,3,00,01 02,03,R", "1.5,0006,2,0A,0B,R", "1.6,0007,2,zz,0b,R", "1.7,0008,1,0a", "1.8,0009,9,1,2,3,4,5,6,7,8,9,R",
    ]
    (tmp_path / "Flooding_x.txt").write_text("\n".join(lines) + "\n")
    got = delimited.parse_survival(discovery.read_lines(spark, str(tmp_path), "survival_analysis")).orderBy("line_key").collect()
    known = re.compile(r"[0-9a-f]{1,2}|[0-9A-F]{1,2}")
    for text, row in zip(lines, got, strict=True):
        cells = re.split(r"\s*,\s*", text.strip(" "))
        flagged = " " not in cells[3] and cells[-1].upper() in ("R", "T")
        parts = re.split(r"\s+", cells[3]) if " " in cells[3] else cells[3:-1] if flagged else cells[3:]
        want = [p.upper().zfill(2) if known.fullmatch(p) else "PAD" for p in parts[:8]]
        assert [row[f"Data_{i}"] for i in range(8)] == want + ["PAD"] * (8 - len(want)), text
        assert (row["reject_reason"] == "too_many_bytes") == (len(parts) > 8)


def test_row_ids_of_whole_and_broken_splits(spark):
    draw = random.Random(5)
    rows, want = [], {}
    for path in ("/c", "/a", "/b"):
        for block in (0, 100, 200):
            keys = range(1 << 33, (1 << 33) + 40) if block != 100 else sorted(draw.sample(range(200), 40))
            rows += [(path, block, key, f"{path}{block}-{key}") for key in keys]
    for i, row in enumerate(sorted(rows)):
        want[row[3]] = i
    draw.shuffle(rows)
    got = captures.with_row_ids(spark.createDataFrame(rows, "path string, file_block long, line_key long, name string"))
    assert {r["name"]: r["row_id"] for r in got.collect()} == want


def test_whole_splits_are_numbered_where_they_lie(spark, tmp_path):
    """No frame of a capture without rejects goes through a shuffle to get its row id."""
    (tmp_path / "Flooding_x.txt").write_text("".join(f"{i}.0,0001,2,00,0a,R\n" for i in range(3000)))
    parsed = staged(delimited.parse_survival(discovery.read_lines(spark, str(tmp_path), "survival_analysis")))
    numbered = captures.with_row_ids(accepted(parsed))
    assert sorted(r["row_id"] for r in numbered.collect()) == list(range(3000))
    assert moved(numbered._jdf.queryExecution().executedPlan()) == 0


def moved(plan):
    """Rows that the exchanges of an executed plan wrote to shuffles."""
    kind, found = plan.getClass().getSimpleName(), 0
    if kind == "ShuffleExchangeExec":
        found += plan.metrics().apply("shuffleRecordsWritten").value()
    if kind == "AdaptiveSparkPlanExec":
        found += moved(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        found += moved(plan.plan())
    children = plan.children()
    return found + sum(moved(children.apply(i)) for i in range(children.size()))


def test_names_of_captures_need_no_rendered_line(spark, sf_dir):
    for dialect in ("road_raw", "survival_analysis"):
        lines = st.log_lines(spark, sf_dir, dialect).select("capture", "path").distinct().collect()
        files = st.capture_files(spark, sf_dir, dialect, st.rendered(spark, sf_dir)).collect()
        assert {(r["capture"], r["path"]) for r in lines} == {(r["session_id"], r["path"]) for r in files}
