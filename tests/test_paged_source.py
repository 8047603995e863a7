"""Landed pages as a data source: rows, pruned pages, odd lines, a stream that goes on after a restart."""

import os

from pyspark.sql import functions as F

from dossier.sources import paged_source
from dossier.streaming import flows as S


def land(folder, pages):
    for page, text in pages.items():
        os.makedirs(f"{folder}/page={page}")
        with open(f"{folder}/page={page}/part-0.txt", "w") as f:
            f.write(text)


def test_batch(spark, tmp_path):
    folder = f"{tmp_path}/in"
    land(folder, {0: '{"data":[{"id":1,"n":"é"},{"id":"x"},7,null]}\nnot json\n{"data":null}\n[1]\n{"data":[{"id":2}]}', 1: "", 2: '{"data": [{"id": 99999999999999999999}]}', 10: '{"data":[{"id":4}]}'})
    read = paged_source.registered(spark).read.format("landed_pages")
    rows = sorted(map(tuple, read.load(folder).collect()))
    assert [(r[0], r[1], r[3]) for r in rows] == [(0, 0, '{"id":1,"n":"é"}'), (0, 1, '{"id":"x"}'), (0, 2, "7"), (0, 3, "null"), (0, 4, '{"id":2}'), (2, 0, '{"id":99999999999999999999}'), (10, 0, '{"id":4}')]
    assert [r[2] for r in rows] == [1, None, None, None, 2, None, 4]
    with open(f"{folder}/page=0/part-0.txt", "wb") as f:
        f.write(b"\xff\xfe")
    os.chmod(f"{folder}/page=0/part-0.txt", 0o000)
    os.rename(f"{folder}/page=0", f"{folder}/page=0.gone")  # pages that cannot match are not opened
    assert [r["page"] for r in read.load(folder).where("page > 1 AND page <= 10 AND id IS NOT NULL").collect()] == [10]
    assert sorted(r["page"] for r in read.option("pages_per_task", "1").load(folder).where(F.col("page").isin(2, 10, 77)).collect()) == [2, 10]
    assert read.load(f"{tmp_path}/none").count() == 0


def test_pruned_pages(spark, tmp_path):
    reader = paged_source.PagesReader({"path": f"{tmp_path}/in", "pages_per_task": "2"})
    land(f"{tmp_path}/in", {i: "" for i in range(9)})
    from pyspark.sql import datasource as D

    left = list(reader.pushFilters([D.GreaterThanOrEqual(("page",), 3), D.EqualTo(("id",), 5), D.LessThan(("page",), 8)]))
    assert left == [D.EqualTo(("id",), 5)] and [p.of for p in reader.partitions()] == [[3, 4], [5, 6], [7]]


def test_stream_reads_each_page_once(spark, tmp_path):
    def run():
        calls = paged_source.registered(spark).readStream.format("landed_pages").load(f"{tmp_path}/in")
        S.drain(calls, f"{tmp_path}/out", "append", f"{tmp_path}/checkpoint")
        return sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out/n=*").collect())

    land(f"{tmp_path}/in", {i: '{"data":[{"id":%d}]}' % i for i in (0, 1, 2)})
    assert run() == [0, 1, 2]
    land(f"{tmp_path}/in", {i: '{"data":[{"id":%d},{"id":%d}]}' % (i, 10 + i) for i in (3, 5)})
    assert run() == [0, 1, 2, 3, 5, 13, 15] == run()
