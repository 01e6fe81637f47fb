"""Records cut in parallel, against the reader that takes a whole file in one task."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.sources.pairs import read_tsv_pairs
from rankloom.sources.records import after, records

OPTIONS = {"sep": "\t", "header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key in keys:
        spark.conf.unset(key)


def made(seed, n, breaks, end="\n"):
    rng = random.Random(seed)

    def cell():
        body = "".join(rng.choice(["a", "é", " ", "word", "世", "'", "NA"]) for _ in range(rng.randrange(12)))
        if rng.random() < 0.4:
            extra = rng.choice(['""', "\n", "\t", "\n\n", '\n""\n', "\r\n"]) if breaks else rng.choice(['""', "\t"])
            at = rng.randrange(len(body) + 1)
            return f'"{body[:at]}{extra}{body[at:]}"'
        return rng.choice([body, body + ' 5" disk', body]) if body else '""'

    return "context\tresponse" + end + "".join(cell() + "\t" + cell() + end for _ in range(n))


@pytest.mark.parametrize("seed, breaks, end", [(1, True, "\n"), (2, True, "\n"), (3, False, "\n"), (4, False, "\r\n")])
def test_equal_to_the_whole_file_reader(spark, small_ranges, tmp_path, seed, breaks, end):
    path = tmp_path / "pairs.tsv"
    path.write_bytes(made(seed, 150, breaks, end).encode())
    url = f"file:{path}"
    whole = spark.read.options(**OPTIONS).schema("context string, response string").csv(url)
    got = read_tsv_pairs(spark, {"train": url})
    key = lambda r: (r.context or "", r.response or "", r.context is None, r.response is None)
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))
    assert records(spark, url).rdd.getNumPartitions() > 10


def test_a_field_over_many_ranges(spark, small_ranges, tmp_path):
    path = tmp_path / "long.tsv"
    long = "\n".join(f"line {k}" for k in range(300))
    path.write_text(f'context\tresponse\none\ttwo\n"{long}"\t"x\ny"\n\nthree\t"open to the end\nof it')
    rows = {r.context: r.response for r in read_tsv_pairs(spark, {"train": f"file:{path}"}).collect()}
    assert rows["one"] == "two" and rows[long] == "x\ny" and len(rows) == 3 and rows["three"].lstrip('"') == "open to the end\nof it"


def test_several_files_and_headers(spark, small_ranges, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.tsv").write_text(made(k, 20, True))
    found = records(spark, f"file:{tmp_path}")
    assert found.filter("first").count() == 3 and found.filter(~F.col("first")).count() == 60


def test_state_after_a_line():
    cases = [('a\t"b', False, True), ('a\t"b', True, False), ('a"\tb', True, False), ('x""y', True, True), ("plain", True, True)]
    cases += [('5" disk\tb', False, False), ('"a"\t"b""c"', False, False), ('"a"\t"', False, True), ('"', True, False)]
    for line, inside, want in cases:
        assert after(line, inside, "\t", '"') is want, (line, inside)
