import pytest

from valsieve.errors import IntegrityError
from valsieve.sources import readers

COLUMNS = ["a", "b", "c"]


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def problems(spark, folder, columns=COLUMNS, separator=","):
    return {r["archivo"].rsplit("/", 1)[1]: r["problema"] for r in readers.header_problems(spark, str(folder), columns, separator).collect()}


def test_each_part_is_checked_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "t"
    write(folder, "ok.csv", "a,b,c\n1,2,3\n")
    write(folder, "quoted.csv", '"a","b",c\n')
    write(folder / "below", "short.csv", "a,b\n1,2\n")
    write(folder, "other.csv", "a,x,c,y\n")
    write(folder, "order.csv", "b,a,c\n")
    write(folder, "twice.csv", "a,b,c,c\n")
    write(folder, "empty.csv", "")
    write(folder, "late.csv", "\na,b,c\n")
    assert problems(spark, folder) == {
        "short.csv": "faltan: c", "other.csv": "faltan: b; sobran: x, y", "order.csv": "orden o repetición",
        "twice.csv": "orden o repetición", "late.csv": "faltan: a, b, c"}
    with pytest.raises(IntegrityError):
        readers.require_headers(spark, str(folder), COLUMNS)
    write(tmp_path / "semicolon", "x.csv", "a;b;c\n")
    assert problems(spark, tmp_path / "semicolon", separator=";") == {}


def test_missing_and_empty_tables_are_fine(spark, tmp_path):
    readers.require_headers(spark, str(tmp_path / "none"), COLUMNS)
    write(tmp_path / "one", "ok.csv", "a,b,c\n")
    readers.require_headers(spark, str(tmp_path / "one"), COLUMNS)


def test_only_the_first_block_of_a_file_holds_its_header(spark, tmp_path):
    write(tmp_path / "big", "big.csv", "a,b,wrong\n" + "1,2,3456789\n" * 200_000)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300k")
    try:
        found = readers.header_problems(spark, str(tmp_path / "big"), COLUMNS)
        assert [r["problema"] for r in found.collect()] == ["faltan: c; sobran: wrong"]
        rows = spark.read.text(str(tmp_path / "big")).groupBy("_metadata.file_block_start").count().count()
        assert rows > 5
    finally:
        spark.conf.set(name, before)


def test_quoted_headers(spark, tmp_path):
    write(tmp_path / "q", "q.csv", '"a, b","say ""x""",,c\n1,2,3,4\n')
    cells = [r["cabecera"] for r in readers.read_headers(spark, str(tmp_path / "q")).collect()]
    assert cells == [["a, b", 'say "x"', "", "c"]]
