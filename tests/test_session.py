import os

from tessera import session


def there(path):
    return os.path.isdir(path.removeprefix("file://"))


def test_runs_release_their_own_tables_only(spark):
    outer = session.written(spark.range(3), "outer")
    listed = session._made[spark.sparkContext.applicationId]
    mine = listed[-1]
    with session.scratch(spark) as made:
        session.written(spark.range(4), "inner")
        with session.scratch(spark) as deeper:
            kept = session.written(spark.range(5), "kept")
        assert len(made) == 2 and deeper[0] == made[1]
        session.release(spark, made[:1])
        assert len(made) == 1 and there(made[0])
    assert outer.count() == 3 and kept.count() == 5 and listed[-2:] == [mine, made[0]]
    with session.scratch(spark) as made:
        session.written(spark.range(4), "gone")
        path = made[0]
        session.release(spark)
    assert not there(path) and there(mine) and path not in listed
    session.release(spark, listed[-2:])
    assert not there(mine)
