"""Every query of the subpackage over the small tables, in the columns stated."""

from aroeira.llm import queries

COLUMNS = {
    "p4_found": ["cohort_id", "target_id"],
    "p5_found": ["rec_id", "group_id"],
    "p6_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "subject"],
}


def test_queries(spark, data):
    for name, q in queries.QUERIES.items():
        df = q(spark, data)
        assert df.columns == COLUMNS.get(name, df.columns), name
        assert df.count() > 0 or name.startswith("p4"), name
    documents = spark.read.parquet(f"{data}/documents.parquet").count()
    assert queries.p6_ids(spark, data).count() == documents
