import pytest

from graphquarry.sources import generations


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def test_collection_leaves_what_readers_of_other_processes_hold(spark, tmp_path):
    clock = Clock()
    mine, other = (generations.Store(spark, f"file://{tmp_path}/s", clock) for _ in range(2))
    with pytest.raises(LookupError), mine.reading():
        pass
    assert mine.collect() == []
    table = spark.range(5)
    first, _ = mine.publish({"t": table}, "d1")
    with other.reading(seconds=60) as (name, tables):
        assert name == first
        second, _ = mine.publish({"t": table.limit(3)}, "d2")
        assert mine.collectable() == [] and mine.collect() == [] and tables["t"].count() == 5
        with mine.reading() as (now, _):
            assert now == second
    assert mine.collect() == [first] and mine.collect() == []  # given back, so it goes
    with other.reading(seconds=60):
        third, _ = mine.publish({"t": table.limit(2)}, "d3")
        clock.now += 61  # a reader that gave no word counts as gone
        assert mine.collectable({second}) == [first] or mine.collectable({second}) == []
        assert mine.collect() == [second]
    with mine.reading() as (now, tables):
        assert now == third and tables["t"].count() == 2


def test_a_retired_generation_takes_no_reader(spark, tmp_path):
    """A collection that came between the look at the pointer and the lease: the reader sees it and asks again."""
    store = generations.Store(spark, f"file://{tmp_path}/s")
    first, _ = store.publish({"t": spark.range(1)}, "d1")
    store._write(0, first, "retired", "", [])
    with pytest.raises(LookupError), store.reading():
        pass
    assert store.leased() == set()
    second, _ = store.publish({"t": spark.range(2)}, "d2")
    with store.reading() as (name, _):
        assert name == second and store.leased() == {second}
