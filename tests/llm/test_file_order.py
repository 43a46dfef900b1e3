"""Token files beyond five digits of part number."""

from loadstone.llm.token_files import file_order


def test_part_numbers_beyond_five_digits(spark):
    names = [f"part-{n:05d}-abc-c{c:03d}.parquet" for n in (0, 9, 10, 99_999, 100_000, 100_001, 1_000_000) for c in (0, 1)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "file string")
    assert [r.file for r in df.orderBy(*file_order("file")).collect()] == names
