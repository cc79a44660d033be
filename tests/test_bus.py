"""BUS files in binary: round trips over many splits, and files that are broken."""

import struct

import pytest
from pyspark.sql import functions as F

from strandloom.sources.bus import read_bus, write_bus


def test_known_bytes(spark, tmp_path):
    head = b"BUS\0" + struct.pack("<IIII", 1, 4, 3, 5) + b"hello"
    (tmp_path / "a.bus").write_bytes(head + struct.pack("<QQiIII", 0b00011011, 0b110000, 7, 2, 9, 0) + struct.pack("<QQiIII", 0b11100100, 1, -1, 2**32 - 1, 0, 0))
    got = [tuple(r) for r in read_bus(spark, str(tmp_path / "a.bus"), 1).collect()]
    assert sorted(got) == [("ACGT", "TAA", 7, 2, 9), ("TGCA", "AAC", -1, 2**32 - 1, 0)]


def test_round_trip_over_splits(spark, tmp_path):
    n = 200_000
    letter = lambda e: F.substring(F.lit("ACGT"), (e % 4 + 1).cast("int"), F.lit(1))
    text = lambda c, size: F.concat(*(letter(F.floor(c / 4**i)) for i in range(size)))
    rows = spark.range(0, n, 1, 5).select(
        text(F.col("id"), 16).alias("barcode"), text(F.col("id") * 7, 12).alias("umi"), (F.col("id") % 1000).cast("int").alias("ec"), (F.col("id") % 9).alias("count"), F.col("id").alias("read_index")
    )
    out = str(tmp_path / "bus")
    write_bus(rows, out)
    back = read_bus(spark, out, 7001)
    assert back.rdd.getNumPartitions() >= n // 7001 and back.count() == n
    assert back.exceptAll(rows).count() == 0
    with pytest.raises(FileExistsError):
        write_bus(rows, out)
    write_bus(rows.limit(3), out, "overwrite")
    assert read_bus(spark, out).count() == 3
    write_bus(rows.limit(2), out, "append")
    assert read_bus(spark, out).count() == 5
    write_bus(rows.limit(0), str(tmp_path / "none"))
    assert read_bus(spark, str(tmp_path / "none")).count() == 0
    assert not [f for f in (tmp_path / "bus").iterdir() if f.name.endswith(".part")]


@pytest.mark.parametrize(("content", "says"), [
    (b"BAM\1" + bytes(40), "no BUS file"), (b"BUS", "no BUS file"),
    (b"BUS\0" + struct.pack("<IIII", 1, 16, 12, 0) + bytes(33), "within a record"),
    (b"BUS\0" + struct.pack("<IIII", 1, 16, 12, 900) + bytes(3), "within a record"),
    (b"BUS\0" + struct.pack("<IIII", 2, 16, 12, 0), "version 2"),
])
def test_broken_files(spark, tmp_path, content, says):
    (tmp_path / "a.bus").write_bytes(content)
    with pytest.raises(Exception, match=says):
        read_bus(spark, str(tmp_path / "a.bus")).collect()


def test_rows_that_do_not_fit(spark, tmp_path):
    rows = spark.createDataFrame([("ACGT", "AC", 1, 1, 1), ("ACG", "AC", 1, 1, 1)], "barcode string, umi string, ec int, count long, read_index long").coalesce(1)
    with pytest.raises(Exception, match="must have 4 bases"):
        write_bus(rows, str(tmp_path / "a"))
    with pytest.raises(Exception, match="other letters"):
        write_bus(rows.limit(1).withColumn("umi", F.lit("NN")), str(tmp_path / "b"))
    assert not list((tmp_path / "a").glob("*")) or not [f for f in (tmp_path / "a").iterdir() if f.name.endswith(".bus")]
