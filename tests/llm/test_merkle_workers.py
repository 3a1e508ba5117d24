from tests.llm.test_merkle import SCHEMA, brute, rows
from tracefold.llm import merkle


def test_a_worker_with_other_blocks_changes_nothing(spark):
    def spoilt(batches):
        from tracefold.llm import merkle as there

        there.BLOCK_LEVELS, there.BLOCK = 2, 9
        yield from batches

    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows()], SCHEMA).repartition(5)
    spark.range(0, 16, 1, 16).mapInArrow(spoilt, "id long").count()  # Python workers are used again
    assert sorted((tuple(r) for r in merkle.verify_documents(df).collect()), key=repr) == brute(rows())
