"""Files with line breaks in quotes, read by many tasks, against Spark's one-task reading."""

import gzip
import random

import pytest

from plumbline.sources.files import read_many, read_text_table
from plumbline.sources.quoted import inside_after, read_quoted, records

RNG = random.Random(3)
CELLS = ["", "plain", "two words", 'a "quoted" word', "line\nbreak", "a\n\nb\n", '"', '""', 'x,"y"\n,z', "ü\n漢字", '5" pipe', " lead", "\n", ",", "NA", "x" * 300, 'tail"', "1", "\r\nwin"]


def cell(value, style):
    if style == "plain" and not any(c in value for c in ',\n\r"'):
        return value
    return '"' + value.replace('"', '""') + '"'


def table(rows, end="\n"):
    # Spark's reader takes the first line break of a file for its line end, also inside quotes
    lines = ["id,first name," + cell("odd\nname" if end == "\n" else "odd name", "q") + ",d"]
    lines += [",".join([str(i), *[cell(RNG.choice(CELLS), RNG.choice(["plain", "quoted"])) for _ in range(3)]]) for i in range(rows)]
    return end.join(lines) + RNG.choice(["", end])


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def check(spark, path, sep=","):
    whole = spark.read.csv(str(path), sep=sep, header=True, escape='"', multiLine=True, maxCharsPerColumn=-1)
    found = read_quoted(spark, str(path), sep).drop("file_name")
    assert found.columns == whole.columns
    # Spark turns line ends inside quotes into line feeds where lines end in CR LF, and counts the file's last one into a cell never closed
    plain = [tuple(c and c.replace("\r\n", "\n").rstrip("\n") for c in r) for r in rows_of(whole)]
    assert sorted(plain, key=repr) == sorted([tuple(c and c.replace("\r\n", "\n").rstrip("\n") for c in r) for r in rows_of(found)], key=repr)
    return found


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_one_task_reading(spark, small_blocks, tmp_path, end):
    path = tmp_path / "t.csv"
    path.write_bytes(table(160, end).encode())
    found = check(spark, path)
    if end == "\n":
        assert rows_of(found) == rows_of(spark.read.csv(str(path), header=True, escape='"', multiLine=True))
    assert spark.read.text(str(path), lineSep="\n").rdd.getNumPartitions() > 20


@pytest.mark.parametrize(
    "text",
    [
        "a,b\n1," + '"' + "long\n" * 200 + '"\n2,y\n',  # a record over many blocks
        'a,b\n"1","x"\n\n\n2,y\n\n',  # empty lines
        "\n\na,b\n1,2\n",
        "a,b\n",
        'a,b\n1,"never closed\nand on\n2,3\n' + "4,5\n" * 100,
        'a,b\n1,x"y\n2,"x"y\n3,"x"y,z\n4,"p" "q"\n5,6\n',  # quotes inside and after cells
        'a,b\n"""x""",""\n"",""""\n1\n1,2,3\n',  # short and long rows
        "a,a,b\n1,2,3\n",
        "﻿a,b\n1,2\n",
    ],
)
def test_edges(spark, small_blocks, tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    check(spark, path)


def test_other_separators_and_compression(spark, small_blocks, tmp_path):
    text = table(80).replace(",", ";")
    (tmp_path / "t.csv").write_text(text)
    found = check(spark, tmp_path / "t.csv", ";")
    with gzip.open(tmp_path / "t.csv.gz", "wt") as out:
        out.write(text)
    assert rows_of(read_quoted(spark, str(tmp_path / "t.csv.gz"), ";").drop("file_name")) == rows_of(found)


def test_several_files(spark, small_blocks, tmp_path):
    for name in ("u.csv", "v.csv"):
        (tmp_path / name).write_text(table(60))
    paths = [str(tmp_path / n) for n in ("u.csv", "v.csv")]
    found = read_many(spark, paths)
    assert {r["file_name"]: r["count"] for r in found.groupBy("file_name").count().collect()} == {"u.csv": 60, "v.csv": 60}
    assert rows_of(records(spark, paths).where("heading").select("file_name")) == [("u.csv",), ("v.csv",)]
    assert read_text_table(spark, paths).columns == ["id", "first name", "odd\nname", "d"]


def test_state_of_a_line():
    for text in [",".join(cell(RNG.choice(CELLS), RNG.choice(["plain", "quoted"])) for _ in range(4)) for _ in range(300)]:
        inside = False
        for line in text.split("\n"):
            inside = inside_after(line, inside, ",")
        assert not inside
        assert inside_after("x" + text.split("\n")[0], False, ",") in (True, False)
    assert inside_after('a,"b', False, ",") and not inside_after('b",c', True, ",") and inside_after('b","c', True, ",")
    assert not inside_after('5" x 3"', False, ",") and inside_after('"x"y"z,"q', False, ",")
