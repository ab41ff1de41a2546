"""Each dialect on small files with good and bad lines."""

import fnmatch
import json
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from canlake.plans import stages
from canlake.sources import candump, captures, delimited, discovery, tables
from canlake.sources.parsing import accepted, captures_without_frames, reject_counts

PAD = ["PAD"]


def write(folder, name, lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")
    return path


def frames(parsed):
    rows = captures.canonical_order(captures.with_row_ids(accepted(parsed))).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(len(rows)))
    return rows


def data(row):
    return [row[f"Data_{i}"] for i in range(8)]


def rejects(parsed):
    return {(r["session_id"], r["reject_reason"]): r["lines"] for r in reject_counts(parsed).collect()}


def test_attack_defense_with_and_without_sub_label(spark, tmp_path):
    write(tmp_path, "a_S.csv", [
        "Timestamp,Arbitration_ID,DLC,Data,Class,SubClass",
        "1.5, 0x0a3 ,8,01 02 03 04 05 06 07 08,Attack, Flooding ",
        "1.6,1ABCD,2,0a ff,Attack,",
        "bad,100,2,00 00,Normal,Normal",
    ])
    write(tmp_path, "b_D.csv", ["Timestamp,Arbitration_ID,DLC,Data,Class", "2.0,000,0,,Normal"])
    write(tmp_path, "c_D.csv", ["Arbitration_ID,Timestamp,DLC,Data", "7,3.0,1,FF"])
    parsed = delimited.parse_attack_defense(discovery.read_lines(spark, str(tmp_path), "car_hacking_attack_defense"))
    rows = frames(parsed)
    assert [(r["session_id"], r["Timestamp"], r["Arbitration_ID"], r["DLC"], r["attack_type"]) for r in rows] == [
        ("a_S", 1.5, "0A3", 8, "Flooding"), ("a_S", 1.6, "1ABCD", 2, "Normal"), ("b_D", 2.0, "000", 0, "Normal"), ("c_D", 3.0, "007", 1, "Normal"),
    ]
    assert data(rows[0]) == [f"0{i}" for i in range(1, 9)]
    assert data(rows[1]) == ["0a", "ff"] + PAD * 6  # bytes stay as written
    assert data(rows[2]) == PAD * 8
    assert rejects(parsed) == {("a_S", "bad_time"): 1}


def test_ciciov(spark, tmp_path):
    write(tmp_path, "benign.csv", [
        "ID,DATA_0,DATA_1,DATA_2,DATA_3,DATA_4,DATA_5,DATA_6,DATA_7,label,category,specific_class,DLC",
        "0x65,0x0a,f,,12.0, ,FF,00,7,BENIGN,BENIGN, benign ,[4]",
        "291.0,00,00,00,00,00,00,00,00,ATTACK,DOS,DoS,",
        "5,00,00,00,00,00,00,00,00,ATTACK,SPOOFING,gas,8.0",
        "5,00,00,00,00,00,00,00,00,ATTACK,SPOOFING,gas,many",
    ])
    write(tmp_path, "broken.csv", ["ID,DATA_0,label", "1,00,x"])
    parsed = delimited.parse_ciciov(discovery.read_lines(spark, str(tmp_path), "ciciov2024"))
    assert "Timestamp" not in parsed.columns
    rows = frames(parsed)
    assert [(r["Arbitration_ID"], r["DLC"], r["attack_type"]) for r in rows] == [("065", 4, "BENIGN"), ("291", 8, "DoS"), ("005", 8, "GAS")]
    assert data(rows[0]) == ["0A", "0F", "PAD", "12", "PAD", "FF", "00", "07"]
    assert rejects(parsed) == {("benign", "bad_dlc"): 1, ("broken", "missing_columns"): 2}  # no header line either


def test_hcrl_ragged_csv_and_text(spark, tmp_path):
    write(tmp_path, "DoS_dataset.csv", [
        "1478198376.389427,0316,8,05,21,68,09,21,21,00,6f,R",
        "1478198376.389636,018f,2,fe,5b,T",
        "1478198376.4,0000,0,T",
        "oops,1,8,00",
    ])
    write(tmp_path, "gear.csv", ["1.0,0x2,1,A,r"])
    write(tmp_path, "normal_run_data.txt", [
        "Timestamp: 1479121434.850202        ID: 0350    000    DLC: 8    05 28 84 66 6d 00 00 a2",
        "Timestamp: 1479121434.9        ID: 02c0    100    DLC: 0",
        "Timestamp: broken",
        "",
    ])
    parsed = delimited.parse_hcrl(discovery.read_lines(spark, str(tmp_path), "hcrl_carhacking"))
    rows = frames(parsed)
    got = [(r["session_id"], r["Arbitration_ID"], r["DLC"], r["attack_type"]) for r in rows]
    assert got == [
        ("DoS_dataset", "316", 8, "Normal"), ("DoS_dataset", "18F", 2, "DoS"), ("DoS_dataset", "000", 0, "DoS"), ("gear", "002", 1, "Normal"),
        ("normal_run_data", "350", 8, "Normal"), ("normal_run_data", "2C0", 0, "Normal"),
    ]
    assert data(rows[0]) == ["05", "21", "68", "09", "21", "21", "00", "6F"]
    assert data(rows[1]) == ["FE", "5B"] + PAD * 6
    assert data(rows[3]) == ["0A"] + PAD * 7
    assert data(rows[4]) == ["05", "28", "84", "66", "6D", "00", "00", "A2"]
    assert rejects(parsed) == {("DoS_dataset", "bad_time"): 1, ("normal_run_data", "malformed"): 1}


def test_survival(spark, tmp_path):
    write(tmp_path, "Flooding_dataset_KIA.txt", [
        "1.0,0153,8,00 21 10 FF 00 ff 00 ff",
        "1.1,000,2,0A,bb,T",
        "1.2,7ff,1,5,R",
        "1.3,100,2,aB,zz,T",
        "1.4,100,3,01,02,03",
        "short,line",
        "x,100,1,00,R",
        "1.5,100,0,T",
    ])
    write(tmp_path, "FreeDriving.txt", ["0.5,100,1,0A,T"])
    write(tmp_path, "other.txt", ["0.5,100,1,0A,T"])
    parsed = delimited.parse_survival(discovery.read_lines(spark, str(tmp_path), "survival_analysis"))
    rows = frames(parsed)
    got = [(r["Timestamp"], r["Arbitration_ID"], r["DLC"], r["attack_type"]) for r in rows]
    assert got == [
        (1.0, "153", 8, "Normal"), (1.1, "000", 2, "Flooding"), (1.2, "7FF", 1, "Normal"), (1.3, "100", 2, "Flooding"),
        (1.4, "100", 3, "Normal"), (1.5, "100", 0, "Flooding"), (0.5, "100", 1, "Normal"),
    ]
    assert data(rows[0]) == ["00", "21", "10", "FF", "00", "FF", "00", "FF"]
    assert data(rows[2]) == ["05"] + PAD * 7
    assert data(rows[3]) == PAD * 8  # mixed case and non-hex are unknown bytes
    assert data(rows[4]) == ["01", "02", "03"] + PAD * 5
    assert rejects(parsed) == {
        ("Flooding_dataset_KIA", "too_few_cells"): 1, ("Flooding_dataset_KIA", "bad_time"): 1, ("other", "unknown_family"): 1,
    }


META = {
    "fuzzing_1": {"injection_interval": [1.0, 2.0], "injection_data_str": "05XXXXXXXXXXXXFF", "injection_id": "XXX"},
    "max_speedometer_1": {"injection_interval": [0.0, 9.0], "injection_data_str": "xxxxxxxxxxxxxx0a", "injection_id": "0x0D0"},
    "reverse_light_on_1": {"injection_interval": [0.0, 9.0], "injection_data_str": "XX", "injection_id": None},
}


@pytest.fixture
def road(spark, tmp_path):
    hit = "0500000000000AFF"
    write(tmp_path, "attacks/fuzzing_1.log", [
        "junk",
        f"(100.0) can0 701#{hit}",  # out of scope, but sets time zero
        f"(100.999999) can0 100#{hit}",
        f"(101.0) can0 700#{hit}",
        f"(102.0) can0 100#{hit}",
        f"(102.000001) can0 100#{hit}",
        "(101.5) can0 100#0600000000000AFF",
        "(101.6) can0 100#",
        "(101.7) can0 100#ABC",
        "(101.8) can0 1234#00",
        "(oops) can0 100#00",
    ])
    write(tmp_path, "attacks/max_speedometer_1.log", ["(5.0) can0 0D0#0A", "(5.1) can0 0D1#0A", "(5.2) can0 0D0#0B"])
    write(tmp_path, "attacks/reverse_light_on_1.log", ["(5.0) can0 0D0#0A"])
    write(tmp_path, "ambient/drive.log", ["(5.0) can0 0D0#0A"])
    (tmp_path / "capture_metadata.json").write_text(json.dumps(META, indent=1))
    return tmp_path


def test_road_rule(spark, road):
    meta = candump.read_injections(spark, str(road / "capture_metadata.json"))
    assert meta.count() == 3
    parsed = candump.parse_road(discovery.read_lines(spark, str(road), "road_raw"), meta)
    rows = frames(parsed)
    got = [(r["session_id"], round(r["Timestamp"], 6), r["Arbitration_ID"], r["DLC"], r["attack_type"]) for r in rows]
    by_session = {}
    for row in got:
        by_session.setdefault(row[0], []).append(row[1:])
    assert by_session["fuzzing_1"] == [
        (0.999999, "100", 8, "Normal"), (1.0, "700", 8, "Fuzzing"), (2.0, "100", 8, "Fuzzing"), (2.000001, "100", 8, "Normal"), (1.5, "100", 8, "Normal"),
    ]
    assert [r[3] for r in by_session["max_speedometer_1"]] == ["MS", "Normal", "Normal"]
    assert by_session["reverse_light_on_1"][0][3] == "Normal"  # pattern length differs
    short = [r for r in rows if r["session_id"] == "drive"][0]
    assert data(short) == ["00"] * 7 + ["0A"]  # short payloads are padded on the left
    assert rejects(parsed) == {
        ("fuzzing_1", "malformed"): 1, ("fuzzing_1", "bad_time"): 1, ("fuzzing_1", "out_of_scope"): 1, ("fuzzing_1", "bad_payload"): 2, ("fuzzing_1", "id_out_of_range"): 1,
    }


def test_road_ingest_selects_attack_captures(spark, road, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "canonical")
    stages.ingest(spark, str(road), "road_raw", out, "fabrication", ["max_*"], str(road / "capture_metadata.json"))
    table = spark.read.parquet(out)
    assert {r[0] for r in table.select("session_id").distinct().collect()} == {"fuzzing_1", "reverse_light_on_1"}
    assert sorted(r[0] for r in table.select("row_id").collect()) == list(range(6))
    with pytest.raises(ValueError, match="no valid frame"):
        stages.ingest(spark, str(road), "road_raw", out + "2", "masquerade", None, str(road / "capture_metadata.json"))


def test_mirgu(spark, tmp_path):
    line = "({t}) can0 {i}#{p} {f}".format
    write(tmp_path, "Benign/day1.log", [line(t=1, i="100", p="0102", f=1), line(t=2, i="800", p="00", f=0)])
    write(tmp_path, "Real_attacks/fuzzing_valid_ids_dos.log", [line(t=1, i="000", p="", f=1), line(t=2, i="1", p="FF", f=1), line(t=3, i="1", p="FF", f=0)])
    write(tmp_path, "Real_attacks/reverse_speedometer_fuzzing_attack.log", [line(t=10, i="1", p="FF", f=1), line(t=79.9, i="1", p="FF", f=1), line(t=80, i="1", p="FF", f=1)])
    write(tmp_path, "Real_attacks/multiple_attacks_2.log", [line(t=10, i="1", p="FF", f=1), line(t=890, i="1", p="FF", f=1)])
    write(tmp_path, "Masquerade_attacks/x.log", [line(t=1, i="1", p="FF", f=1), "(2) can0 1#FF", "(3) can0 1#FF 2"])
    write(tmp_path, "elsewhere/x2.log", [line(t=1, i="1", p="FF", f=1)])
    parsed = candump.parse_mirgu(discovery.read_lines(spark, str(tmp_path), "can_mirgu"))
    by_session = {}
    for r in frames(parsed):
        by_session.setdefault(r["session_id"], []).append(r["attack_type"])
    assert by_session == {
        "day1": ["Normal"], "fuzzing_valid_ids_dos": ["DoS", "Fuzzing", "Normal"],
        "reverse_speedometer_fuzzing_attack": ["Spoofing", "Spoofing", "Fuzzing"],
        "multiple_attacks_2": ["Spoofing", "Fuzzing"], "x": ["Masquerade"],
    }
    empty = [r for r in frames(parsed) if r["Arbitration_ID"] == "000"][0]
    assert data(empty) == ["00"] * 8 and empty["DLC"] == 0
    assert rejects(parsed) == {("day1", "id_out_of_range"): 1, ("x", "malformed"): 2, ("x2", "unknown_family"): 1}
    assert {r[0] for r in captures_without_frames(parsed).collect()} == {"x2"}


def test_row_ids_over_many_splits(spark, tmp_path):
    for name, count in (("b", 900), ("a", 700), ("c", 3)):
        write(tmp_path, f"{name}.txt", [f"Timestamp: {i}.5    ID: 0{i % 7}    000    DLC: 0" if i % 10 else "noise" for i in range(count)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = discovery.read_lines(spark, str(tmp_path), "hcrl_carhacking")
        assert lines.select("path", "file_block").distinct().count() > 10
        rows = captures.with_row_ids(accepted(delimited.parse_hcrl(lines))).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(n, i + 0.5) for n, count in (("a", 700), ("b", 900), ("c", 3)) for i in range(count) if i % 10]
    assert [(r["session_id"], r["Timestamp"]) for r in rows] == want
    assert [r["row_id"] for r in rows] == list(range(len(want)))


@pytest.mark.parametrize("pattern", ["Pre_*.csv", "*/x?.csv", "sub/*.csv", "[ab]_1.csv", "[!a]_1.csv", "sub/**/x1.csv", "a_1.csv", "*1*", "deep/x1.csv"])
def test_exclusion_matches_like_a_shell(spark, pattern):
    root = "/data/raw"
    paths = [f"{root}/{p}" for p in ("Pre_D.csv", "a_1.csv", "b_1.csv", "sub/x1.csv", "sub/deep/x1.csv", "sub/Pre_x.csv", "c.1.csv")]
    got = {r[0]: r[1] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", discovery.is_excluded(F.col("p"), root, [pattern])).collect()}
    for path in paths:
        pure = PurePosixPath(path)
        below = str(pure.relative_to(root))
        assert got[path] == (fnmatch.fnmatchcase(pure.name, pattern) or fnmatch.fnmatchcase(below, pattern) or pure.match(pattern)), path


def test_dispatch_names_the_choices(spark):
    with pytest.raises(ValueError, match="ciciov2024"):
        captures.parser_for("nope")
    with pytest.raises(ValueError, match="metadata"):
        captures.parser_for("road_raw")
    files = spark.createDataFrame([("/a/attacks/x.log",)], "path string")
    for dialect in ("road_raw", "can_mirgu"):
        with pytest.raises(ValueError, match="variants"):
            discovery.select_captures(files, dialect, None)


def test_files_with_odd_names(spark, tmp_path):
    write(tmp_path, "a b+c%41.txt", ["Timestamp: 1.5    ID: 01    000    DLC: 0"])
    write(tmp_path, ".hidden.txt", ["Timestamp: 1.5    ID: 01    000    DLC: 0"])
    lines = discovery.read_lines(spark, str(tmp_path), "hcrl_carhacking")
    assert [r["session_id"] for r in lines.collect()] == ["a b+c%41"]


def test_tables(spark, make_frames, tmp_path):
    source = make_frames([(i, "s", i, "100", 0) for i in range(50)])
    tables.write_frames(source, str(tmp_path / "f"))
    assert tables.count_rows(spark, str(tmp_path / "f")).first()[0] == 50
    subset = tables.read_frames(spark, str(tmp_path / "f"), ["row_id", "nope", "Class"])
    assert subset.columns == ["row_id", "Class"]
    with pytest.raises(Exception, match="already exists|exists"):
        tables.write_frames(source, str(tmp_path / "f"))
    with pytest.raises(ValueError, match="row_id"):
        tables.write_frames(source.drop("row_id"), str(tmp_path / "g"))
    split = source.withColumn("split", F.lit("train"))
    tables.write_splits(split, str(tmp_path / "s"))
    empty = tables.read_split(spark, str(tmp_path / "s"), "test", split.schema)
    assert empty.count() == 0 and empty.columns == source.columns
    assert tables.read_split(spark, str(tmp_path / "s"), "train", split.schema).count() == 50
    with pytest.raises(ValueError, match="unknown split"):
        tables.read_split(spark, str(tmp_path / "s"), "dev", split.schema)
