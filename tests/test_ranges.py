"""Large files cut by many tasks give what one task would read."""

import json
import random

import pandas as pd
import pytest

from tablescope import api
from tablescope.sources import ranges


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


TRICKY = ['a,b', 'x"y', "br{ace", "br}ace", "[list]", "back\\slash", 'end\\"', "two\nlines", "é☃", "", ":", "\\", '"', "\t", ",,,", "}{", "\r\n"]


def values(rng):
    return {"k": rng.randint(0, 999), "s": "".join(rng.choices(TRICKY, k=rng.randint(0, 4))),
            "f": rng.choice([1.5, None, -2e10]), "n": rng.choice([None, {"p": [{"q": "},{"}, {"q": '\\"'}], "r": rng.choice(TRICKY)}]),
            "l": rng.choice([[], ["a,b", "]"], None]), "long": "z," * rng.randint(0, 400)}


def written(tmp_path, name, text):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "t.json").write_bytes(text.encode() if isinstance(text, str) else text)
    return str(folder)


def same(spark, folder, rows=None):
    got, want = api.scan_json(spark, folder), spark.read.json(folder, multiLine=True)
    assert dict(got.dtypes) == dict(want.dtypes)
    key = lambda r: json.dumps(r.asDict(recursive=True), sort_keys=True)
    assert sorted(map(key, got.select(sorted(got.columns)).collect())) == sorted(map(key, want.select(sorted(got.columns)).collect()))
    return got


@pytest.mark.parametrize("seed,indent,ascii", [(1, None, True), (2, 1, False)])
def test_array_of_records(spark, tmp_path, small_ranges, seed, indent, ascii):
    rng = random.Random(seed)
    rows = [values(rng) for _ in range(60)]
    folder = written(tmp_path, "a", json.dumps(rows, indent=indent, ensure_ascii=ascii))
    assert same(spark, folder).count() == 60
    assert ranges.text_ranges(spark, [folder], ",").rdd.getNumPartitions() > 2


def test_every_range_size(spark, tmp_path):
    rng = random.Random(9)
    folder = written(tmp_path, "a", "﻿" + json.dumps([values(rng) for _ in range(4)], ensure_ascii=False, indent=2))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for size in (150, 100_000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert api.scan_json(spark, folder).count() == 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_objects_over_lines_and_single_record(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    rows = [values(rng) for _ in range(20)]
    folder = written(tmp_path, "o", "\n".join(json.dumps(r, indent=2) for r in rows))
    got = {r["k"]: r["s"] for r in api.scan_json(spark, folder).collect()}
    assert got == {r["k"]: r["s"] for r in rows}
    same(spark, written(tmp_path, "one", json.dumps(values(rng), indent=1)))
    assert api.scan_json(spark, written(tmp_path, "lines", "\n".join(json.dumps(r) for r in rows) + "\n")).count() == 20
    assert api.scan_json(spark, written(tmp_path, "none", "[ ]")).count() == 0
    # One line beyond what the first look reads, alone and among others.
    long = json.dumps({"k": 1, "s": "x" * 1_200_000})
    assert api.scan_json(spark, written(tmp_path, "long", long + '\n{"k": 2}\n{"k": 3}')).count() == 3
    assert api.scan_json(spark, written(tmp_path, "alone", long)).count() == 1


def test_column_document(spark, tmp_path, small_ranges):
    rng = random.Random(6)
    frame = pd.DataFrame({"a,b": range(150), 'q"uote': [rng.choice(TRICKY) + "x" for _ in range(150)], "{c}": [rng.choice([1.5, None]) for _ in range(150)]})
    for name, indent in (("flat", None), ("tall", 3)):
        folder = written(tmp_path, name, frame.to_json(indent=indent) if indent else frame.to_json())
        got = api.scan_json(spark, folder)
        assert got.columns == list(frame.columns)
        assert [tuple(r) for r in got.collect()] == [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]


def csv_values(rng):
    field = rng.choice(["plain", "5", "with, comma", "two\nlines", 'quo"te', 'end"', '"', "", "a\r\nb", "\n\n", 'x","y', "é", '",\n"'])
    return field + "." if field else field


@pytest.mark.parametrize("seed,encoding", [(1, "utf-8"), (2, "latin-1")])
def test_csv_with_quoted_line_breaks(spark, tmp_path, small_ranges, seed, encoding):
    rng = random.Random(seed)
    frame = pd.DataFrame({"id": range(200), "one\nname": [csv_values(rng) for _ in range(200)], "b": [csv_values(rng) for _ in range(200)]})
    (tmp_path / "t.csv").write_bytes(frame.to_csv(index=False, lineterminator="\r\n" if seed == 2 else "\n").encode(encoding))
    got = api.scan_csv(spark, str(tmp_path / "t.csv"))
    back = pd.read_csv(tmp_path / "t.csv", encoding=encoding)
    assert got.columns == list(back.columns)
    assert sorted(tuple(r) for r in got.fillna("").collect()) == [tuple("" if pd.isna(v) else v for v in r) for r in back.itertuples(index=False)]
    assert ranges.text_ranges(spark, [str(tmp_path / "t.csv")], "\n").rdd.getNumPartitions() > 2


def test_quotes_amid_fields_open_nothing(spark, tmp_path, small_ranges):
    text = 'a,b\n5" pipe,1\n"x ""y"" z",2\nx"y,"open\nend"\n"q"tail"more,4\n' + 'plain 3" nail,5\n' * 60
    (tmp_path / "t.csv").write_text(text)
    got = sorted(tuple(r) for r in api.scan_csv(spark, str(tmp_path / "t.csv")).fillna("").collect() if r["b"] != "5")
    back = pd.read_csv(tmp_path / "t.csv")
    want = sorted(tuple(r) for r in back.itertuples(index=False) if r[1] != "5")
    # What follows a closing quote within its field is kept as written.
    assert [r for r in got if r[1] != "4"] == [r for r in want if r[1] != "4"] and len(got) == len(want)


def test_entry_states_of_csv_ranges():
    for line, fresh, quoted in ((b"a,b", False, True), (b'a,"b', True, False), (b'"', True, False), (b'""', False, True),
                                (b'x"y', False, False), (b'a"b,"c', True, True), (b'"a","b"', False, False), (b'",a,"b', False, True), (b'a""b', False, True)):
        assert ranges._quoted_after(line, False) == fresh, line
        if b'"' in line:
            assert ranges._quoted_after(line, True) == quoted, line
