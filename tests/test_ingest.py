"""Reading folders of CSV files, snapshots and the batch job on files."""

import csv
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rosterloom.config import ROSTER_COLUMNS, MatchConfig
from rosterloom.plans.batch import build_registry_snapshot, run_batch
from rosterloom.sources.csv_folder import (
    ColumnCountMismatch, EmptyInput, file_names, file_widths, parsed_folder, read_roster_folder,
)
from rosterloom.sources.csv_records import _lines, ends_within
from rosterloom.sources.profiles import column_profiles, misplaced_columns
from rosterloom.sources.tables import (
    batch_path, load_snapshot, read_enrollment, save_snapshot, write_batch, write_named_file,
)

CFG = MatchConfig()


def line(**cells):
    return [cells.get(c, "") for c in ROSTER_COLUMNS]


def write(path, rows, header=None, quoting=csv.QUOTE_MINIMAL, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        out = csv.writer(f, quoting=quoting, lineterminator="\n")
        out.writerow(header or [f"Col {i}" for i in range(len(ROSTER_COLUMNS))])
        out.writerows(rows)


def test_cells_keep_their_text(spark, tmp_path):
    write(tmp_path / "a.csv", [
        line(pasecureid="0012345678", school_code4="NA", case_number="", school_name='x "q" y',
             student_address1="1 Oak St\nRear", validation_output="last")])
    write(tmp_path / "b.csv", [line(pasecureid="2", case_number="")], quoting=csv.QUOTE_ALL)
    write(tmp_path / "c.CSV", [line(pasecureid="3")])
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "d.csv", [line(pasecureid="4")])
    df = read_roster_folder(spark, str(tmp_path), blank_as_null=("case_number",))
    assert df.columns == list(ROSTER_COLUMNS)
    assert {t for _, t in df.dtypes} == {"string"}
    rows = {r.pasecureid: r for r in df.collect()}
    assert set(rows) == {"0012345678", "2"}
    a = rows["0012345678"]
    assert a.school_code4 is None and a.case_number is None
    assert a.school_name == 'x "q" y' and a.student_address1 == "1 Oak St\nRear"
    assert a.validation_output == "last" and a.county == ""
    assert rows["2"].case_number is None and rows["2"].county == ""


def test_wrong_width_names_the_file(spark, tmp_path):
    write(tmp_path / "good.csv", [line(pasecureid="1")])
    write(tmp_path / "narrow.csv", [["secret"] * 24], header=[f"c{i}" for i in range(24)])
    with pytest.raises(ColumnCountMismatch) as e:
        read_roster_folder(spark, str(tmp_path))
    assert "narrow.csv" in str(e.value) and "good.csv" not in str(e.value)
    assert "secret" not in str(e.value)


@pytest.mark.parametrize("multiline", [True, False])
def test_header_only_and_wide_records(spark, tmp_path, multiline):
    write(tmp_path / "empty.csv", [], header=["just", "two"])
    write(tmp_path / "wide.csv", [line(pasecureid="1"), line(pasecureid="2", school_name="a,b") + ["x"]])
    write(tmp_path / "short.csv", [line(pasecureid="1")[:5]])
    widths = {r.file.rsplit("/", 1)[1]: (r.header_fields, r.widest)
              for r in file_widths(spark, str(tmp_path), multiline=multiline).collect()}
    assert widths == {"empty.csv": (2, 2), "wide.csv": (25, 26), "short.csv": (25, 25)}


def test_short_records_are_padded(spark, tmp_path):
    write(tmp_path / "short.csv", [line(pasecureid="1", sfa_name="s")[:5]])
    row = read_roster_folder(spark, str(tmp_path)).first()
    assert row.sfa_name == "s" and row.pasecureid == "1" and row.eligibility == ""


@pytest.fixture
def tiny_splits(spark):
    """Files are read in splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {name: spark.conf.get(name, None) for name in names}

    def set_to(size):
        for name, value in zip(names, (size, 0, 1)):
            spark.conf.set(name, str(value))

    yield set_to
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def random_cells(rng, n):
    parts = ["", "a", "bc", "é", ",", '"', '""', "\n", "\r\n", " ", "Oak St", '"\n"', ",\n,", "NA", "x" * 30]
    return [line(pasecureid=str(i), **{c: "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
                                       for c in rng.sample(ROSTER_COLUMNS[5:], 3)}) for i in range(n)]


@pytest.mark.parametrize("size", [40, 333, 5000])
def test_files_are_read_in_splits(spark, tmp_path, tiny_splits, size):
    """Cells with line breaks, quotes and commas, records and headers over borders of splits, against the csv module."""
    rng = random.Random(size)
    want = Counter()
    for name in "abc":
        rows = random_cells(rng, 60)
        if name == "b":
            rows[7] = line(pasecureid="giant", student_city="one\n" * 300, student_zip='"')
        write(tmp_path / f"{name}.csv", rows, header=[f"Col\n{i}" for i in range(25)],
              quoting=csv.QUOTE_ALL if name == "c" else csv.QUOTE_MINIMAL)
        with open(tmp_path / f"{name}.csv", newline="", encoding="utf-8") as f:
            want.update(tuple(r) for r in list(csv.reader(f))[1:])
    tiny_splits(size)
    assert _lines(spark, str(tmp_path)).rdd.getNumPartitions() > 2
    got = Counter(tuple("NA" if c is None else c for c in r) for r in read_roster_folder(spark, str(tmp_path)).collect())
    assert got == want
    assert {tuple(r)[1:] for r in file_widths(spark, str(tmp_path)).collect()} == {(25, 25)}


def test_where_a_quote_opens_a_cell():
    assert ends_within(b'a,"b', False) and not ends_within(b'a,"b"', False) and ends_within(b'a,"b""', False)
    assert not ends_within(b'a,5" pipe', False) and not ends_within(b'"a" b,c', False)
    assert ends_within(b"no quote", True) and not ends_within(b'end"', True) and ends_within(b'end","next', True)
    assert not ends_within(b'end",next"', True) and ends_within(b'""', True) and not ends_within(b'"', True)
    assert not ends_within(b"", False) and ends_within(b"", True)


def test_quotes_within_a_cell_and_one_that_is_never_closed(spark, tmp_path, tiny_splits):
    head = ",".join(f"c{i}" for i in range(25))
    rest = "," * 21
    (tmp_path / "a.csv").write_text(f'{head}\r\n\r\n1,5" pipe,x,y{rest}\r\n2,b,x,y{rest}\r\n3,"open\nto the, end{rest}')
    for size in (50, 100_000):
        tiny_splits(size)
        rows = [tuple(r)[:2] for r in read_roster_folder(spark, str(tmp_path), check=False).collect()]
        assert rows[:2] == [("1", '5" pipe'), ("2", "b")] and rows[2][0] == "3" and rows[2][1].startswith("open\nto the")


def test_blank_lines_before_the_header_and_no_last_line_end(spark, tmp_path):
    head = ",".join(f"c{i}" for i in range(25))
    (tmp_path / "a.csv").write_text("\n\r\n" + head + "\n\n" + "1" + "," * 24)
    assert [r.sfa_name for r in read_roster_folder(spark, str(tmp_path)).collect()] == ["1"]


def test_bad_bytes(spark, tmp_path):
    head = ",".join(f"c{i}" for i in range(25)).encode()
    (tmp_path / "a.csv").write_bytes(head + b"\nN\xfa\xf1ez,\xc3\xa9,\xe2\x82" + b"," * 22 + b"\n")
    cells = lambda **how: tuple(read_roster_folder(spark, str(tmp_path), **how).first())[:3]
    assert cells() == ("N\ufffd\ufffdez", "é", "\ufffd")
    assert cells(bad_bytes="spell") == ("N<fa><f1>ez", "é", "<e2><82>")
    assert cells(encoding="cp1252")[0] == "Núñez"
    with pytest.raises(ValueError):
        cells(encoding="UTF-16LE")


def test_latin1_files(spark, tmp_path):
    write(tmp_path / "a.csv", [line(student_last_name="Núñez")], encoding="latin-1")
    row = read_roster_folder(spark, str(tmp_path), encoding="ISO-8859-1").first()
    assert row.student_last_name == "Núñez"


def test_batch_folders(spark, tmp_path):
    out = str(tmp_path / "summary")
    write_batch(spark.range(3), out, "b1")
    write_batch(spark.range(5), out, "b2")
    write_batch(spark.range(2), out, "b1")
    counts = {r.batch: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()}
    assert counts == {"b1": 2, "b2": 5}
    with pytest.raises(ValueError):
        batch_path(out, "../b1")


def test_enrollment_from_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("AUN,County,Total,Extra\n0012,Elk,7,x\n")
    assert [tuple(r) for r in read_enrollment(spark, str(tmp_path), "csv").collect()] == [("0012", "Elk", 7)]


def test_whole_job_on_files(spark, tmp_path):
    registry, upload = tmp_path / "registry", tmp_path / "upload"
    registry.mkdir()
    upload.mkdir()

    def student(district, sid, name, **more):
        return line(aun9_3=district, pasecureid=sid, student_first_name=name, student_last_name="Ash",
                    student_dob="2015-01-02", eligibility="Free", student_address1="12 Oak Street",
                    case_number="c1", school_code4="0012", parent_first_name="Pat",
                    parent_last_name="Ash", **more)

    write(registry / "r.csv", [
        student("100", "0000000001", "Ana"), student("100", "0000000002", "Ben"),
        student("100", "0000000003", "Cleo"), student("999", "0000000009", "Out"),
        student("100", "", "Dropped")])
    write(upload / "u1.csv", [student(" 100 ", "0000000001", "ANA"), student("100", "77", "ben")])
    write(upload / "u2.csv", [student("200", "0000000005", "Eli")])
    build_registry_snapshot(spark, str(registry), str(tmp_path / "snapshot"))
    spark.createDataFrame([("100", "Elk", 7), ("300", "Elk", 1)], "AUN string, County string, Total bigint").write.parquet(
        str(tmp_path / "official"))
    paths = run_batch(spark, str(tmp_path / "snapshot"), str(upload), str(tmp_path / "out"), "batch2", linked=True,
                      enrollment=str(tmp_path / "official"))

    rows = spark.read.parquet(paths["district_summary"]).orderBy("AUN").collect()
    assert [(r.AUN, r.p_total, r.s_total, r.difference) for r in rows] == [("100", 3, 2, 1), ("200", 0, 1, -1)]
    assert rows[0].sebt_free == 2 and rows[0].s_not_pasecure == 1 and rows[0].address_mismatch_count == 0
    ids = spark.read.parquet(paths["one_sided_ids"])
    assert {(r.PAsecureID, r.Source) for r in ids.collect()} == {
        ("0000000002", "Primero"), ("0000000003", "Primero"), ("77", "SEBT"), ("0000000005", "SEBT")}
    left = spark.read.parquet(paths["unmatched_registry"])
    assert [r.primero_pasecureid for r in left.collect()] == ["0000000003"]
    assert "primero_parent_email" in left.columns
    assert spark.read.parquet(paths["unmatched_upload"]).count() == 1
    assert spark.read.parquet(paths["many_to_many_keys"]).count() == 0
    assert spark.read.parquet(paths["link_sizes"]).count() == 2
    assert spark.read.parquet(paths["parent_name_mismatch_pairs"]).count() == 0

    odd = spark.read.parquet(paths["odd_ids_upload"])
    assert [(r.sebt_pasecureid, r.s10digitID) for r in odd.collect()] == [("77", "2")] and "_row" not in odd.columns
    assert spark.read.parquet(paths["odd_ids_registry"]).count() == 0
    linked = spark.read.parquet(paths["linked_pairs"])
    assert sorted((r.primero_pasecureid, r.sebt_pasecureid, r.addr_similarity) for r in linked.collect()) == [
        ("0000000001", "0000000001", 1.0), ("0000000002", "77", 1.0)]
    check = spark.read.parquet(paths["enrollment_check"]).collect()
    assert [(r.SEBT_Count, r.Official_Enrollment) for r in check] == [(3, 7)]
    assert spark.read.parquet(paths["misplaced_columns"]).columns == ["column", "filled", "fitting", "likely", "file"]
    with open(paths["summary_file"], newline="") as f:
        got = list(csv.DictReader(f))
    assert paths["summary_file"].endswith("/batch2_district_summary.csv")
    assert [(r["AUN"], r["p_total"], r["difference"]) for r in got] == [("100", "3", "1"), ("200", "0", "-1")]


def test_a_failed_build_leaves_the_snapshot(spark, tmp_path):
    path, cfg = str(tmp_path / "snapshot"), MatchConfig()
    names = f"{cfg.registry.col(cfg.district)} string, {cfg.registry.col(cfg.student_id)} string"
    roster = lambda *ids: spark.createDataFrame([("1", i) for i in ids], names)
    with pytest.raises(FileNotFoundError):
        load_snapshot(spark, path)
    broken = roster("x", "y").filter("assert_true(primero_pasecureid = 'x') IS NULL")
    with pytest.raises(Exception, match="is not true"):
        save_snapshot(broken, path, cfg.registry)
    with pytest.raises(FileNotFoundError):
        load_snapshot(spark, path)
    save_snapshot(roster("a"), path, cfg.registry)
    before = load_snapshot(spark, path)
    with pytest.raises(FileExistsError):
        save_snapshot(roster("b"), path, cfg.registry)
    with pytest.raises(Exception, match="is not true"):
        save_snapshot(broken, path, cfg.registry, mode="overwrite")
    assert [r[1] for r in load_snapshot(spark, path).collect()] == ["a"]
    save_snapshot(roster("b", "c"), path, cfg.registry, mode="overwrite")
    assert sorted(r[1] for r in load_snapshot(spark, path).collect()) == ["b", "c"]
    assert [r[1] for r in before.collect()] == ["a"]


def test_files_with_misplaced_columns_are_named(spark, tmp_path):
    def rows(first, second):
        return [line(**{first: f"{100000000 + i}", second: f"{i:010d}", "student_dob": f"2015-01-{i % 28 + 1:02d}",
                        "eligibility": "Free" if i % 5 else "NA"}) for i in range(40)]
    write(tmp_path / "good.csv", rows("aun9_3", "pasecureid"))
    write(tmp_path / "swapped.csv", rows("pasecureid", "aun9_3"))
    write(tmp_path / "moved.csv", [line(aun9_3="100000001", pasecureid="Ana", student_first_name="0000000001")] * 9)
    found = misplaced_columns(column_profiles(parsed_folder(spark, str(tmp_path))))
    named = found.join(file_names(spark, str(tmp_path)), "_file").collect()
    assert {(r.file.rsplit("/", 1)[1], r.column, r.filled, r.fitting, r.likely) for r in named} == {
        ("swapped.csv", "aun9_3", 40, 0, "pasecureid"), ("swapped.csv", "pasecureid", 40, 0, "aun9_3"),
        ("moved.csv", "pasecureid", 9, 0, "student_first_name")}


def test_one_named_file_per_batch(spark, tmp_path):
    for n in (3, 5):
        path = write_named_file(spark.range(n).orderBy("id"), str(tmp_path), "b1", "ids")
    assert path == f"{tmp_path}/b1_ids.csv" and [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["b1_ids.csv"]
    assert (tmp_path / "b1_ids.csv").read_text() == "id\n0\n1\n2\n3\n4\n"


def test_nothing_to_read_is_an_error(spark, tmp_path):
    with pytest.raises(EmptyInput, match="No .csv"):
        read_roster_folder(spark, str(tmp_path))
    (tmp_path / "b.csv").write_text("")
    with pytest.raises(EmptyInput, match="No .csv"):
        read_roster_folder(spark, str(tmp_path), check=False)
