"""Records that run across byte ranges: delimited files with line breaks in fields, and JSON lists, against plain parsers."""

import csv
import io
import json
import random

import pytest

from prismtally.sources import spanning
from prismtally.sources.readers import read_dataset


@pytest.fixture
def small_ranges(spark):
    """Ranges of some hundred bytes, so that every file is many of them."""
    wanted = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def field(rng):
    kind = rng.randrange(7)
    word = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 8)))
    return [word, f'{word}\n{word}', f'say "{word}", or', '"', '\n\n', f'5" {word}', "x" * rng.choice([1, 900])][kind]


def written(rng, value):
    if any(c in value for c in '\n,') or value.startswith('"') or rng.random() < 0.3:
        return '"' + value.replace('"', '""') + '"'
    return value  # quotes inside a plain field stay as they are


def test_quoted_line_breaks(spark, folder, small_ranges):
    rng = random.Random(1)
    for attempt in range(4):
        rows = [(str(i), field(rng), field(rng)) for i in range(120)]
        body = "".join(",".join(written(rng, v) for v in r) + "\n" for r in [("id", "left", "right"), *rows])
        path = f"{folder}/{attempt}.csv"
        with open(path, "w", newline="") as out:
            out.write(body)
        assert [tuple(r) for r in csv.reader(io.StringIO(body, newline=""))][1:] == rows
        cut = spanning.records(spark, path, spanning.Quoted(","))
        assert spanning.pieces_of(spark, path, "\n").rdd.getNumPartitions() > 8
        assert sorted(next(csv.reader(io.StringIO(r["record"].decode(), newline=""))) for r in cut.collect()) == sorted(map(list, rows))
        back = read_dataset(spark, path, infer=False)
        assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_one_large_file_is_many_tasks(spark, folder):
    path = f"{folder}/large.csv"
    with open(path, "w") as out:
        out.write("id,text\n")
        for i in range(150_000):
            out.write(f'{i},"line one of {i}\nline ""two"", and more text to fill the file {i * 7}"\n')
    df = read_dataset(spark, path)
    assert df.rdd.getNumPartitions() >= 3
    assert df.count() == 150_000 and df.where("text NOT LIKE 'line one of %'").count() == 0
    assert df.agg({"id": "sum"}).first()[0] == 150_000 * 149_999 // 2


def test_plain_quotes_keep_the_native_reader(spark, folder):
    path = f"{folder}/plain.csv"
    with open(path, "w") as out:
        out.write('id,text\n1,"a, b"\n2,5" pipe\n3," ""q"""\n')
    df = read_dataset(spark, path)
    assert "FileScan csv" in df._jdf.queryExecution().toString()
    assert {r["id"]: r["text"] for r in df.collect()} == {1: "a, b", 2: '5" pipe', 3: ' "q"'}


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return rng.randint(0, 99)
    if kind < 4:
        return rng.choice(['}', '{"', "a\\", '\\"', "]},{", "é", "x" * 700, "line\nbreak"])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: value(rng, depth + 1) for k in rng.sample("pqr", rng.randint(0, 3))}


def test_json_lists(spark, folder, small_ranges):
    rng = random.Random(2)
    for attempt, indent in enumerate((None, 2, None, 1)):
        records = [{"id": i, "v": value(rng)} for i in range(80)]
        path = f"{folder}/{attempt}.json"
        with open(path, "w") as out:
            json.dump(records, out, indent=indent, ensure_ascii=attempt % 2 == 0)
        cut = spanning.records(spark, path, spanning.Listed())
        found = sorted((json.loads(r["record"], strict=False) for r in cut.collect()), key=lambda r: r["id"])
        assert found == records


def test_json_list_is_read_by_many_tasks(spark, folder):
    path = f"{folder}/large.json"
    with open(path, "w") as out:
        out.write("[" + ",".join(json.dumps({"id": i, "a": {"b": f"}}{i}", "c": [i, {"d": i}]}}) for i in range(120_000)) + "]")
    df = read_dataset(spark, path)
    assert df.rdd.getNumPartitions() >= 2 and sorted(df.columns) == ["a.b", "a.c", "id"]
    assert df.count() == 120_000 and df.agg({"id": "sum"}).first()[0] == 120_000 * 119_999 // 2


def test_empty_lists_and_several_files(spark, folder):
    for name, records in (("a", [{"k": 1}]), ("b", []), ("c", [{"k": 2}, {"k": 3}])):
        with open(f"{folder}/{name}.json", "w") as out:
            json.dump(records, out)
    assert sorted(r["k"] for r in read_dataset(spark, folder, "json").collect()) == [1, 2, 3]
    with open(f"{folder}/mixed.json", "w") as out:
        out.write('[{"k": 1}, 5, {"k": 2}]')
    with pytest.raises(Exception, match="something else"):
        spanning.records(spark, f"{folder}/mixed.json", spanning.Listed()).collect()
