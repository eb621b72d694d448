import pyarrow as pa
import pyarrow.parquet as pq

from tessera.sources.files import footprint, list_files
from tessera.streaming import incremental as inc


def test_folder_walk(spark, tmp_path):
    for name, content in {"a.py": b"x = 1\n", "d/b.log": b"log", "d/c.bin": b"\x00\x01", "big.txt": b"y" * 3000, ".tessera/x": b"own"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.file_path for r in list_files(spark, f"file://{tmp_path}", 2000, ["*.log"]).collect()}
    assert got == {"a.py"}
    assert footprint(spark, f"file://{tmp_path}").first().files == 4  # hidden folders aren't listed


def test_stream_processes_each_row_once(spark, tmp_path):
    source, root = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    write = lambda name, ids: pq.write_table(pa.table({"id": ids}), source / name)
    write("1.parquet", [1, 2, 2, 3])

    def run():
        stream = spark.readStream.schema("id bigint").parquet(f"file://{source}")
        inc.process(stream, root, ["id"], lambda df: df.selectExpr("id", "id * 10 as x")).awaitTermination()

    run()
    write("2.parquet", [3, 4])
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3, 4]
    assert sorted(r.n for r in inc.completion_log(spark, root).collect()) == [1, 3]


def test_a_null_key_is_processed_once_and_targets_keep_their_first(spark):
    done = spark.createDataFrame([(1, "a"), (None, "b"), (9, None)], "k int, t string")
    batch = spark.createDataFrame([(1, "a", 0), (None, "b", 1), (9, None, 2), (2, None, 3), (2, None, 4), (None, None, 5)], "k int, t string, n int")
    assert sorted(map(str, (tuple(r)[:2] for r in inc.unseen(batch, done, ["k", "t"]).collect()))) == ["(2, None)", "(None, None)"]
    assert inc.unseen(batch.limit(0), done, ["k", "t"]).count() == 0 and inc.unseen(batch, done.limit(0), ["k", "t"]).count() == 5
    assert sorted(tuple(r) for r in inc.first_targets(batch.filter("k = 2"), ["k", "t"], "n").collect()) == [(2, None, 3)]
