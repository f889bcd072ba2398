"""The field labels documents that have no base span."""

from tessera.llm import pii


def test_mentions_that_no_pattern_matches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    own = [(-1, "tel (988) 555-2485 or by night tel (988) 555-2485"), (-2, "mail someone@localhost or contact someone@localhost"), (-3, "the year 1998 and page 4512, 30000 items")]
    rows = docs.unionByName(spark.createDataFrame(own, docs.schema))
    got = {r["id"]: r for r in pii.personal_data(rows).filter("id < 0").collect()}
    assert not any(r["base"] for r in got.values()) and not got[-3]["spans"]
    # each number is found; its area code need not be, as documents without base spans are learned as holding none
    assert [[s["start"] <= lo < hi <= s["end"] and pii.KINDS[s["kind"]] for s in got[-1]["spans"]] for lo, hi in ((10, 18), (41, 49))] == [["phone", False], [False, "phone"]]
    # where the texts are not part of the sample
    model = pii.train(docs.withColumnRenamed("doc_id", "id"))
    assert [[(s, pii.KINDS[k], e) for s, k, e in model.added(text, [])] for _, text in own] == [[(4, "phone", 18), (35, "phone", 49)], [(5, "email", 22), (34, "email", 51)], []]
