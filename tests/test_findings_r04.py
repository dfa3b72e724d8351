"""What earlier forms of a step shuffled or asked of state too often."""

from pathlib import Path

from chronofold.plans import evidence as plans
from chronofold.plans import live
from chronofold.plans.views import Tables
from chronofold.session import shared_dir


def shuffled_records(spark, run):
    """Rows written to shuffles by `run`."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for i, n in stages().items() if i not in before)


def test_a_version_is_shuffled_few_times(spark, directory):
    t = Tables(spark, directory)
    n = t.events.count()
    rows = shuffled_records(spark, lambda: plans.evidence_select(t).write.format("noop").mode("overwrite").save())
    print("rows shuffled an event", rows / n)
    assert rows < 40 * n


def test_joined_stream_keeps_one_store_a_partition(spark, directory):
    tables = Path(shared_dir(spark), "tables")
    before = set(tables.glob("stream-state-*"))
    live.stream_labels(Tables(spark, directory))
    (made,) = set(tables.glob("stream-state-*")) - before
    assert not {p.name for p in made.glob("state/0/0/*") if p.name.startswith(("left", "right"))}
