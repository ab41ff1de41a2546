"""Text parsed once, work units from bytes, row groups, contracts and measured scoring."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from canlake.operators import audits, mlp, splits
from canlake.operators.ordering import lay_out, range_partitioned, work_units
from canlake.plans import stages, standin as st
from canlake.sources import candump, captures, delimited, discovery, tables
from canlake.sources.parsing import accepted, reject_counts, staged
from canlake.storage import settle
from test_plans import plan_of


def write(folder, name, lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


@pytest.mark.parametrize("dialect", ["road_raw", "can_mirgu"])
def test_one_regex_pass(spark, sf_dir, dialect):
    """File facts, frames and rejects all read the staged fields; nothing matches the text again."""
    lines = st.log_lines(spark, sf_dir, dialect)
    injections = settle(st.injections(spark, sf_dir), "test-injections")
    parsed = candump.parse_road(lines, injections) if dialect == "road_raw" else candump.parse_mirgu(lines)
    for derived in (parsed, accepted(parsed), reject_counts(parsed), captures.with_row_ids(accepted(parsed))):
        plan = plan_of(derived).lower()
        assert "events.parquet" not in plan and "regexp_replace(translate(trim(value" not in plan


def test_staged_lines_are_not_parsed_again(spark, tmp_path):
    write(tmp_path, "a.txt", [f"Timestamp: {i}.5    ID: 0{i % 3}    000    DLC: 0" for i in range(20)] + ["noise"])
    parsed = staged(delimited.parse_hcrl(discovery.read_lines(spark, str(tmp_path), "hcrl_carhacking")))
    for derived in (captures.with_row_ids(accepted(parsed)), reject_counts(parsed)):
        plan = plan_of(derived)
        assert "FileScan text" not in plan and "regexp" not in plan.lower()
    assert accepted(parsed).count() == 20


def test_overlong_lines_are_rejected(spark, tmp_path):
    nine = " ".join(f"{i:02X}" for i in range(9))
    write(tmp_path, "h/DoS.csv", ["1.0,100,8," + ",".join(["00"] * 8) + ",T", "1.1,100,8," + ",".join(["00"] * 9) + ",R", "1.2,100,2,00,01,R,,,,,,,,,", "1.3,100,2,00,01,R" + "," * 9 + "FF"])
    write(tmp_path, "h/normal.txt", ["Timestamp: 1.0    ID: 0316    000    DLC: 8    " + nine[:23], "Timestamp: 1.1    ID: 0316    000    DLC: 8    " + nine])
    got = {tuple(r) for r in reject_counts(delimited.parse_hcrl(discovery.read_lines(spark, str(tmp_path / "h"), "hcrl_carhacking"))).collect()}
    assert got == {("DoS", "too_many_cells", 2), ("normal", "too_many_bytes", 1)}
    write(tmp_path, "s/Flooding_1.txt", ["1.0,0100,8," + nine[:23], "1.1,0100,8," + nine, "1.2,0100,2,00,01,R", "1.3,0100,8," + ",".join(nine.split()) + ",T"])
    got = {tuple(r) for r in reject_counts(delimited.parse_survival(discovery.read_lines(spark, str(tmp_path / "s"), "survival_analysis"))).collect()}
    assert got == {("Flooding_1", "too_many_bytes", 2)}
    write(tmp_path, "c/x.csv", ["Timestamp,Arbitration_ID,DLC,Data,Class", f"1.0,100,8,{nine[:23]},Normal", f"1.1,100,8,{nine},Normal", "1.2,100,2,00 01 ,Normal"])
    parsed = delimited.parse_attack_defense(discovery.read_lines(spark, str(tmp_path / "c"), "car_hacking_attack_defense"))
    assert [tuple(r) for r in reject_counts(parsed).collect()] == [("x", "too_many_bytes", 1)] and accepted(parsed).count() == 2


def test_sidecar_is_a_json_object_and_reads_back(spark, sf_dir, tmp_path):
    table = st.injections(spark, sf_dir)
    candump.write_injections(table, str(tmp_path / "sidecar"))
    want = sorted(map(tuple, table.collect()))
    assert sorted(map(tuple, candump.read_injections(spark, str(tmp_path / "sidecar"), by_line=True).collect())) == want
    assert sorted(map(tuple, candump.read_injections(spark, str(tmp_path / "sidecar")).collect())) == want
    candump.write_injections(table.limit(0), str(tmp_path / "none"))
    assert candump.read_injections(spark, str(tmp_path / "none"), by_line=True).count() == 0
    plan = plan_of(entry_module.queries()["s13_injection_metadata"](spark, sf_dir))
    assert "collect_list" not in plan and "SinglePartition" not in plan


def test_twice_the_rows_twice_the_work_units(spark, make_frames, tmp_path):
    rows = [(i, "s", i, f"{random.Random(i).randrange(2048):03X}", 0) for i in range(4000)]
    for copies in (1, 2):
        for _ in range(copies):
            make_frames(rows).repartition(1).write.mode("append").parquet(str(tmp_path / str(copies)))
    single, double = (spark.read.parquet(str(tmp_path / n)) for n in ("1", "2"))
    unit = work_units(single, 1) // 40
    assert 39 <= work_units(single, unit) <= 41 and 1.8 < work_units(double, unit) / work_units(single, unit) < 2.3
    assert range_partitioned(single, "row_id", unit_bytes=unit).rdd.getNumPartitions() > 30
    assert work_units(single, 1 << 40) == 1
    laid = lay_out(single, unit_bytes=unit)
    assert laid.n_runs > 30 and laid.frames.agg(F.max("pos")).first()[0] == 3999


def test_row_groups_prune_by_session(spark, make_frames, tmp_path):
    frames = make_frames([(i, f"s{i // 500}", i, "100", 0) for i in range(4000)]).coalesce(1)
    tables.write_frames(frames, str(tmp_path / "f"), group_rows=500)
    footers = [pq.ParquetFile(f).metadata for f in glob.glob(str(tmp_path / "f" / "*.parquet"))]
    groups = [m.row_group(i) for m in footers for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 4000 and max(g.num_rows for g in groups) <= 500 and len(groups) >= 8
    place = footers[0].schema.to_arrow_schema().get_field_index("session_id")
    hits = [g for g in groups if g.column(place).statistics.min <= "s3" <= g.column(place).statistics.max]
    assert len(hits) <= 2
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4000


def test_contract_counts_in_the_same_pass(spark, make_frames, tmp_path):
    frames = make_frames([(i, "s" if i else None, i, "100", i % 3) for i in range(30)])
    contract = audits.Contract({"no_session": F.col("session_id").isNull(), "wrong_class": F.col("Class") > 1, "undecided": F.col("session_id") > "zz"}, ("row_id", "Speed"))
    contract.watched(frames).write.parquet(str(tmp_path / "out"))
    got = {r["rule"]: (r["broken"], r["rows"]) for r in contract.report(spark).collect()}
    assert got == {"missing_columns": (1, 30), "no_session": (1, 30), "wrong_class": (10, 30), "undecided": (1, 30)}  # null counts as broken
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_scoring_is_measured(spark, make_frames, tmp_path):
    row = mlp.measured_scoring(make_frames([(i, "s", i, "100", 0) for i in range(30)]), str(tmp_path / "out")).first()
    assert row["frames"] == 30 and row["ms_per_frame"] * row["frames_per_second"] == pytest.approx(1000)


def test_unknown_holdout_sessions_fail(spark, sf_dir):
    frames = st.frames(spark, sf_dir)
    assert splits.holdout_frames(frames, st.VAL_SESSIONS, st.TEST_SESSIONS).select("split").distinct().count() == 3
    with pytest.raises(ValueError, match="cap_99_S"):
        splits.holdout_frames(frames, st.VAL_SESSIONS, ["cap_99_S"])


def test_files_reach_the_split_tables(spark, tmp_path):
    write(tmp_path, "raw/Flooding_a.txt", [f"{i}.0,0100,2,00,0{i % 8},{'T' if i > 6 else 'R'}" for i in range(10)] + ["noise"])
    write(tmp_path, "raw/FreeDriving_b.txt", [f"{i}.0,0100,2,00 0{i % 8}" for i in range(5)])
    rejects = stages.ingest(spark, str(tmp_path / "raw"), "survival_analysis", str(tmp_path / "canonical"))
    assert [tuple(r) for r in rejects.collect()] == [("Flooding_a", "too_few_cells", 1)]
    frames, _ = stages.prepare(spark.read.parquet(str(tmp_path / "canonical")), "SurvivalAnalysis", features=["deltatime"])
    stages.split(frames, str(tmp_path / "out"), "SurvivalAnalysis", val_sessions=["FreeDriving_b"])
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("split", "Class").count().collect()}
    assert got == {("train", 0, 7), ("train", 1, 3), ("val", 0, 5)}
