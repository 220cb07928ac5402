"""Postings are made in one pass, and scored from what is read once."""

from pyspark.sql import functions as F

from strata.operators import search

DOCS = [(1, "a", "The cat, the of"), (2, "b", None), (3, None, ""), (1, "a", "The cat, the of"), (None, "c", "of Thé of the of"), (4, "a", "-- !"), (5, "b", "the of")]
IDS = ("doc_id", "source")


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, source string, text string")


def key(row):
    return [(x is not None, x) for x in row]


def test_postings_of_odd_documents(spark):
    """Null and empty texts, null ids, ids that come twice, and words that come again."""
    got = sorted((tuple(map(lambda x: tuple(x) if isinstance(x, list) else x, r)) for r in search.postings(docs(spark), IDS).collect()), key=key)
    cat = [("cat", 1, "a", 4, (1,)), ("of", 1, "a", 4, (3,)), ("the", 1, "a", 4, (0, 2))]
    want = cat + cat + [("of", None, "c", 5, (0, 2, 4)), ("the", None, "c", 5, (1, 3)), ("the", 5, "b", 2, (0,)), ("of", 5, "b", 2, (1,))]
    assert got == sorted(want, key=key)


def test_postings_are_moved_once_and_not_written_before(spark, monkeypatch):
    """They were written, sampled for ranges of tokens, and read once more to be moved."""
    monkeypatch.setattr(search, "staged", lambda df, label: (_ for _ in ()).throw(AssertionError(label)))
    plan = search.postings(docs(spark), IDS)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange") == 1 and "rangepartitioning" not in plan.executedPlan().toString()


def test_a_hot_token_is_cut_in_sorted_parts(spark):
    """A token of every document is sorted by more than one task, each part in order."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
        rows = search.postings(spark.range(20_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("hot w"), F.col("id") % 50).alias("text")), IDS)
        parts = rows.select("token", "doc_id", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(parts) == 40_000 and len({r.p for r in parts if r.token == "hot"}) > 1
    for p in {r.p for r in parts}:
        held = [(r.token, r.doc_id) for r in parts if r.p == p]
        assert held == sorted(held)


def test_best_of_an_index_writes_postings_once(spark, tmp_path, monkeypatch):
    """An index wrote its postings, read them twice, and wrote them again in order."""
    from strata.plans import analogs

    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    for module in (search, analogs):
        monkeypatch.setattr(module, "staged", lambda df, label, held=module.staged: written.append(label) or held(df, label))
    rows = analogs.QUERIES["fts_best"](spark, str(tmp_path)).select("source", "doc_id").collect()
    assert written == ["postings", "stats"]
    # An id that comes twice is not found by a phrase of two words, as before.
    assert sorted(tuple(r) for r in rows) == [("b", 5), ("c", None)]
