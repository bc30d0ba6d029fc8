"""CSV files read block by block, against DuckDB's reader and against a state machine over characters."""

import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentilake.sources import csv_blocks as C
from sentilake.sources import tables as T

SCHEMA = "a string, b string, c string"


def inside_after(line, inside):
    """Character by character."""
    state = "quoted" if inside else "start"
    for i, c in enumerate(line):
        if state == "quoted":
            if c == '"':
                state = "closing"
        elif state == "closing" and c == '"':
            state = "quoted"
        elif c == ",":
            state = "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "plain"
    return state == "quoted"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='a",\r ', max_size=14), st.booleans())
def test_lines_against_a_state_machine(line, inside):
    assert C.ends_inside(line.encode(), inside) == inside_after(line, inside)


def test_long_lines_take_linear_time():
    for line in ('"a""' * 50_000, 'x,"y",' * 50_000, '"' * 100_001, "," * 100_000):
        C.ends_inside(line.encode(), False), C.ends_inside(line.encode(), True)


def wild_rows(seed, n):
    rnd = random.Random(seed)
    bits = ['"', ",", "\n", "\r\n", "\n\n", " ", "x", "日本", "é", '""', "word", "NA"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 3, 9, 40])))
    return [(f"row {i}", text() or None, "tail" + text()) for i in range(n)]


def write(path, rows, end="\n", bom=""):
    quote = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\r\n') else v
    path.write_bytes((bom + end.join(["a,b,c", *(",".join(map(quote, r)) for r in rows)]) + end).encode())


@pytest.fixture
def split_at(spark):
    """Sets the size of a block for a test."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", [7, 64, 300, 5000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_blocks_equals_duckdb(spark, tmp_path, split_at, size, end):
    rows = wild_rows(size, 120 if size > 20 else 25)
    file = tmp_path / "f.csv"
    write(file, rows, end, "\ufeff")
    split_at(size)
    got = sorted(map(tuple, T.read_csv(spark, str(file), spark.createDataFrame([], SCHEMA).schema).collect()))
    assert got == sorted(rows)
    assert got == sorted(duckdb.sql(f"SELECT a, b, c FROM read_csv('{file}', header=true, all_varchar=true, quote='\"', escape='\"', delim=',', strict_mode=false)").fetchall())
    lines = spark.read.option("lineSep", "\n").text(str(file))
    if size < 5000:
        assert lines.rdd.getNumPartitions() > 3


def test_a_record_over_many_blocks(spark, tmp_path, split_at):
    rows = [("1", "x\n" * 400, "y"), ("2", None, "z"), ("3", "\n".join(f'"{i}", quoted' for i in range(200)), "\n" * 300), ("4", "b", "c")]
    write(tmp_path / "f.csv", rows)
    split_at(50)
    got = T.read_csv(spark, str(tmp_path / "f.csv"), spark.createDataFrame([], SCHEMA).schema)
    assert sorted(map(tuple, got.collect())) == rows


def test_several_files_and_their_headers(spark, tmp_path, split_at):
    split_at(40)
    for i in range(3):
        write(tmp_path / f"{i}.csv", wild_rows(i, 30), bom="\ufeff" if i else "")
    (tmp_path / "3.csv").write_text("a,b,c\n")
    schema = spark.createDataFrame([], "c string, d string, a string").schema
    got = [tuple(r) for r in T.read_csv(spark, str(tmp_path), schema).collect()]
    assert sorted(got) == sorted((c, None, a) for i in range(3) for a, _, c in wild_rows(i, 30))
    (tmp_path / "4.csv").write_text("a,c,b\n1,2,3\n")
    with pytest.raises(Exception, match="header"):
        T.read_csv(spark, str(tmp_path), schema).collect()


def test_quotes_that_open_nothing(spark, tmp_path, split_at):
    """A quote inside a value that does not begin with one is a character."""
    (tmp_path / "f.csv").write_text('a,b,c\n5" pipe,x "y" z,1\n6" pipe,"two\nlines",2\n,,\n\nlast,"not closed\n1')
    for size in (9, 10_000):
        split_at(size)
        got = T.read_csv(spark, str(tmp_path / "f.csv"), spark.createDataFrame([], SCHEMA).schema).collect()
        assert [r.a for r in sorted(got, key=str)] and {(r.a, r.b) for r in got} >= {('5" pipe', 'x "y" z'), ('6" pipe', "two\nlines"), (None, None)}
        assert len(got) == 4


def test_empty_files(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    (tmp_path / "none.csv").write_text("")
    assert T.read_csv(spark, str(tmp_path / "none.csv"), schema).collect() == []
    (tmp_path / "head.csv").write_text("a,b,c")
    assert T.read_csv(spark, str(tmp_path / "head.csv"), schema).collect() == []


def test_a_changed_split_size_is_an_error(spark, tmp_path, split_at):
    write(tmp_path / "f.csv", wild_rows(1, 60))
    split_at(100)
    df = T.read_csv(spark, str(tmp_path / "f.csv"), spark.createDataFrame([], SCHEMA).schema)
    split_at(64)
    with pytest.raises(Exception, match="maxPartitionBytes"):
        df.collect()
