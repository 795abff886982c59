from shoplens import session

PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPLIT = "spark.sql.files.maxPartitionBytes"


def test_stages_are_sized_by_the_input(spark, folder, monkeypatch):
    def setting(name):
        return int(spark.conf.get(name))

    session.tune(spark, folder)
    own, own_split = setting("spark.sql.shuffle.partitions"), setting(SPLIT)
    assert setting(PARTITIONS) == own and own_split == 128 << 20
    size = session.stored_bytes(spark, folder)
    monkeypatch.setattr(session, "INPUT_PER_PARTITION", 10_000)
    monkeypatch.setattr(session, "MOST_PARTITIONS", 70)
    session.tune(spark, folder)
    assert setting(PARTITIONS) == min(size // 10_000, 70) > own
    # A hundred terabytes.
    session._size_stages(spark, 100 << 40)
    assert setting(SPLIT) == 1 << 30
    monkeypatch.undo()
    session._size_stages(spark, 100 << 40)
    assert setting(PARTITIONS) == 20_000
    session.tune(spark, folder)
    assert (setting(PARTITIONS), setting(SPLIT)) == (own, own_split)
