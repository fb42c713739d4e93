"""The index of blocks by revision."""

from pyspark.sql import functions as F

from quillmill.operators.block_index import BlockIndex


def test_only_changed_records_are_written(spark, tmp_path):
    index = BlockIndex(spark, f"{tmp_path}/i")
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string")
    rows = [("a", "# One\nfox and hen\n# Two\nfox fox dog"), ("b", "# B\nhen\n# C\nnothing"), ("c", None), ("d", "# D\nfox")]
    assert index.best("fox").count() == 0
    assert index.update(frame([*rows, rows[0]])) == 0
    assert [(r.id, r.place) for r in index.best("fox").orderBy("id", "place").collect()] == [("a", 1), ("a", 2), ("d", 1)]
    first = index.best("fox").where("id = 'a' and place = 1").first()
    assert rows[0][1][first.start : first.end].startswith("# Two")
    assert index.update(frame([rows[0], ("b", "# B\nfox hen"), rows[3]])) == 1
    ids = lambda g: {r.id for r in spark.read.parquet(f"{tmp_path}/i/postings/generation={g}").select("id").distinct().collect()}
    assert ids(0) == {"a", "b", "d"} and ids(1) == {"b"}
    assert [(r.id, r.place) for r in index.best("fox hen").where("id = 'b'").collect()] == [("b", 1)]
    assert index.update(frame([rows[0]]), complete=True) == 2
    assert {r.id for r in index.best("fox").collect()} == {"a"} and {r.id for r in index.maps().collect()} == {"a"}
    assert index.best("fox", within=spark.createDataFrame([("d",)], "id string")).count() == 0 and index.best("the of").count() == 0
    again = index.compact(f"{tmp_path}/j")
    assert sorted(map(tuple, again.best("fox hen", 9).collect())) == sorted(map(tuple, index.best("fox hen", 9).collect()))
    assert again._read("postings", "id string, generation int").agg(F.max("generation")).first()[0] == 0


def test_a_row_has_the_postings_of_a_record_and_bucket(spark, tmp_path):
    """Not one row for each word of each block: what is sorted and written grows by records and buckets."""
    index = BlockIndex(spark, f"{tmp_path}/i")
    text = "\n".join(f"# Part {i}\n" + " ".join(f"w{j}" for j in range(200)) for i in range(20))
    index.update(spark.createDataFrame([("a", text), ("b", text + " fox fox"), ("b", text + " fox fox")], "id string, text string"))
    rows = spark.read.parquet(f"{tmp_path}/i/postings/generation=0")
    assert rows.count() == rows.select("id", "bucket").distinct().count() <= 128
    assert [(r.id, r.place) for r in index.best("fox").collect()] == [("b", 1)]
