"""What intermediate tables leave in the shared folder."""

import os
from pathlib import Path

import pytest
from kmerloom.llm.store import Scratch


def written(spark):
    table = Scratch(spark, "store").write(spark.range(0, 40_000, 1, 5))
    return table, Path(table._scratch_path.removeprefix("file:"))


def test_a_table_has_only_its_parts(spark):
    table, at = written(spark)
    names = os.listdir(at)
    assert len(names) == 5  # for any other a process would start, as Hadoop sets its mode
    assert all(x.startswith("part-") and x.endswith(".parquet") for x in names)
    assert table.agg({"id": "sum"}).first()[0] == 40_000 * 39_999 // 2


def test_a_broken_page_is_found(spark):
    table, at = written(spark)
    part = next(at.glob("*.parquet"))
    data = bytearray(part.read_bytes())
    data[len(data) // 3] ^= 1  # within the page
    part.write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        table.agg({"id": "sum"}).collect()
