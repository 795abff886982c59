import random

import pytest

from shoplens.sources import load_unique, read_unique, set_aside

SCHEMA = "product_id string, name string, at long"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def names(df):
    return sorted((r.product_id, r.name) for r in df.collect())


def test_two_loads_that_overlap(spark, tmp_path):
    path = str(tmp_path / "products")
    first = frame(spark, ("a", "a1", 2), ("a", "a0", 1), ("b", "b", 1), (None, "none", 1))
    assert load_unique(first, path, "product_id", "at") == (2, 1, 0, 1)
    second = frame(spark, ("b", "again", 1), ("b", "and again", 2), ("c", "c", 1), ("c", "c2", 2), (None, "none", 1))
    assert load_unique(second, path, "product_id", "at") == (1, 1, 2, 1)
    assert names(read_unique(spark, path)) == [("a", "a0"), ("b", "b"), ("c", "c")]
    aside = sorted((r.load, r.name, r.reason) for r in set_aside(spark, path).collect())
    assert aside == [
        (0, "a1", "repeated"),
        (0, "none", "without key"),
        (1, "again", "known"),
        (1, "and again", "known"),
        (1, "c2", "repeated"),
        (1, "none", "without key"),
    ]
    assert read_unique(spark, path).columns == ["product_id", "name", "at"]


def test_a_lost_load_is_done_over(spark, tmp_path):
    path = str(tmp_path / "products")
    load_unique(frame(spark, ("a", "a", 1)), path, "product_id")
    load_unique(frame(spark, ("b", "b", 1)), path, "product_id")
    # As if the second load had been lost before its keys were there.
    (tmp_path / "products" / "_keys" / "load=1" / "_SUCCESS").unlink()
    assert names(read_unique(spark, path)) == [("a", "a")]
    assert load_unique(frame(spark, ("b", "b", 1)), path, "product_id").taken == 1
    assert names(read_unique(spark, path)) == [("a", "a"), ("b", "b")]


def test_empty_loads(spark, tmp_path):
    path = str(tmp_path / "products")
    assert load_unique(frame(spark), path, "product_id") == (0, 0, 0, 0)
    assert load_unique(frame(spark, ("a", "a", 1)), path, "product_id").taken == 1
    assert load_unique(frame(spark), path, "product_id") == (0, 0, 0, 0)
    assert names(read_unique(spark, path)) == [("a", "a")]


@pytest.mark.parametrize("hot", [0, 500])
def test_against_a_loop(spark, tmp_path, hot):
    """A key on a third of all rows, over three loads."""
    dice, path, known, wanted = random.Random(hot), str(tmp_path / "p"), set(), []
    for _ in range(3):
        keys = [str(dice.randrange(400)) for _ in range(300)] + ["hot"] * hot
        dice.shuffle(keys)
        rows = [(key, f"{key}-{i}", i) for i, key in enumerate(keys)]
        taken = load_unique(frame(spark, *rows).repartition(5), path, "product_id", "at").taken
        before = len(known)
        for key, name, _ in rows:
            if key not in known:
                known.add(key)
                wanted.append((key, name))
        assert taken == len(known) - before
    assert names(read_unique(spark, path)) == sorted(wanted)
    assert read_unique(spark, path).count() + set_aside(spark, path).count() == 3 * (300 + hot)
