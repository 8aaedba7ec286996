"""Event documents cut at element borders."""

import random

import pytest

from fleetlens.session import stage_path
from fleetlens.sources import documents as d


def write(spark, *texts):
    folder = stage_path(spark, "documents")
    for i, text in enumerate(texts):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(f"{folder}/server_name=s{i}")
    return folder


def read(spark, folder, **options):
    return sorted((r.server_name, r.document) for r in d.event_documents(spark, folder, **options).collect())


def test_elements_of_a_document(spark):
    text = (
        '<?xml version="1.0"?><Target name="event" total="3"><event name="a"><data name="eventful">1 &lt; 2\n</data></event>\n  <event name="b > c" x=\'/>\'/>'
        '<!-- <event name="no"> --><event/><events><event\n name="d"><![CDATA[<event>]]></event></events><eventual>x</eventual></Target>\n'
    )
    assert read(spark, write(spark, text, "", "no elements", "<event><data>cut off")) == sorted([
        ("s0", '<event name="a"><data name="eventful">1 &lt; 2\n</data></event>'), ("s0", '<event name="b > c" x=\'/>\'/>'), ("s0", "<event/>"),
        ("s0", '<event\n name="d"><![CDATA[<event>]]></event>'), ("s3", "<event><data>cut off\n</event>"),
    ])


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_a_document_larger_than_a_split_is_read_by_several_tasks(spark, small_splits):
    rng = random.Random(4)
    texts = ["<Target>" + "".join(f'<event name="e{i}"><data>{"é<x/>" * rng.randrange(90)}</data></event>' + rng.choice(["", "\n", "  "]) for i in range(n)) + "</Target>" for n in (700, 1, 40)]
    folder = write(spark, *texts)
    rows = d.event_documents(spark, folder)
    assert rows.rdd.getNumPartitions() > 20
    got = sorted(int(r.document.split('"')[1][1:]) for r in rows.collect() if r.server_name == "s0")
    assert got == list(range(700))
    assert rows.count() == 741
    names = [r.object_name for r in d.named_events(rows).where("server_name = 's2'").collect()]
    assert sorted(names) == sorted(f"e{i}" for i in range(40))


def test_the_same_as_a_stream(spark):
    from fleetlens.streaming.runs import run_to_parquet

    folder = write(spark, "<T><event a='1'/><event>x</event></T>", "<event>y</event>")
    stream = d.event_documents(spark, folder, stream=True, files_per_trigger=1)
    got = run_to_parquet(stream, "documents").collect()
    assert sorted((r.server_name, r.document) for r in got) == [("s0", "<event a='1'/>"), ("s0", "<event>x</event>"), ("s1", "<event>y</event>")]
