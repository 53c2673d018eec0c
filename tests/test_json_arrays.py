"""Array files cut anywhere give the rows of Spark's own reader."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tiermill.session import shared_dir
from tiermill.sources import json_arrays as J
from tiermill.sources import readers as RD
from tiermill.sources import sinks as SK

DDL = "a string, b bigint, c struct<d:string,e:array<string>>"
ROWS = [{"a": 'plain', "b": 1}, {"a": 'q " } ] [ { \\ \\" }', "b": 2, "c": {"d": "}", "e": ["]", "{", '\\"}', "x"]}}, {},
        {"c": {"e": []}, "a": "}}}}"}, {"a": "é\n\t {", "b": -4}, {"a": "\\", "b": 5}, {"a": "", "c": {"d": '"'}}, {"b": 7}]
TEXTS = {"one line": json.dumps(ROWS), "indented": json.dumps(ROWS, indent=2), "utf-8": json.dumps(ROWS, ensure_ascii=False, indent=1) + "\n",
         "single": json.dumps(ROWS[1], indent=1) + " \n", "spaced": " \n [ \n" + " ,\n".join(json.dumps(r) for r in ROWS) + "\n ] \n",
         "empty": "[]", "blank": " [ \n ] "}


def plain(rows):
    return [json.dumps(r.asDict(True), sort_keys=True) for r in rows]


def split(text):
    """What Spark's text reader gives for the separator "}"."""
    parts = text.split("}")
    return parts[:-1] if parts[-1] == "" else parts


def test_every_cut_between_pieces(spark):
    rows, want = [], {}
    for name, text in TEXTS.items():
        parts = split(text)
        elements = json.loads(text)
        elements = [elements] if isinstance(elements, dict) else elements
        for cut in range(len(parts) + 1):
            for cut2 in {cut, min(cut + 1, len(parts)), len(parts)}:
                file = f"{name} {cut} {cut2}"
                rows += [(file, (i >= cut) * 10 + (i >= cut2) * 10, 100 - 100 * (i >= cut) + i, p) for i, p in enumerate(parts)]
                want[file] = elements
    x = spark.createDataFrame(rows, "file string, range long, nth long, piece string")
    got = {}
    for r in sorted(J.records(x.withColumns(J.piece_maps(F.col("piece")))).collect(), key=lambda r: (r.file, r.range, r.nth)):
        got.setdefault(r.file, []).append(json.loads(r.text))
    assert got == {f: e for f, e in want.items() if e}


@pytest.mark.parametrize("size", [7, 23, 64, 300])
def test_as_the_reader_of_whole_files(spark, size):
    folder = tempfile.mkdtemp(prefix="tiermill-arrays-")
    for i, text in enumerate(TEXTS.values()):
        with open(f"{folder}/f{i}.json", "w", encoding="utf-8") as f:
            f.write(text)
    want = plain(spark.read.schema(DDL).option("multiLine", True).json(folder).collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        assert J.pieces(spark, f"{folder}/f1.json").rdd.getNumPartitions() > 1
        got = plain(RD.read_samples(spark, folder, "array", DDL).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted(want) and len(got) == 4 * len(ROWS) + 1


def test_written_arrays_are_json(spark):
    path = shared_dir(spark, "arrays")
    d = spark.createDataFrame([(i, f"t}}{i}") for i in range(50)], "k long, t string")
    SK.write_array(d, path, "k", ["k", "t"])
    found = []
    for name in sorted(os.listdir(path.removeprefix("file:"))):
        if name.startswith("part-"):
            with open(f"{path.removeprefix('file:')}/{name}", encoding="utf-8") as f:
                found += json.load(f)
    assert found == [{"k": i, "t": f"t}}{i}"} for i in range(50)]
    assert RD.read_samples(spark, path, "array", "k bigint, t string").count() == 50
