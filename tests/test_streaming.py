"""Arriving files give the same documents as one batch over all of them."""

from foliomark.plans.convert import Options, convert
from foliomark.streaming.arrivals import arriving_files, convert_arrivals

from .test_convert import ROWS, bodies, tables  # noqa: F401

OPTIONS = Options(generated_at="2024-01-01")


def test_two_batches(spark, tables, tmp_path):  # noqa: F811
    names = [row[0] for row in ROWS["files"]]
    for half in (names[:4], names[4:]):
        rows = tables.files.where(tables.files.doc_id.isin(half))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = (
        spark.readStream.schema("doc_id long, path string")
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{tmp_path}/in")
    )
    query = convert_arrivals(
        files, lambda _: tables, f"{tmp_path}/out", f"{tmp_path}/progress", OPTIONS
    )
    query.awaitTermination(240)
    documents = spark.read.parquet(f"{tmp_path}/out/documents")
    assert documents.select("batch").distinct().count() == 2
    assert bodies(documents) == bodies(convert(tables, OPTIONS).documents)
    assert spark.read.parquet(f"{tmp_path}/out/report").count() == len(names)


def test_arriving_files(spark, tmp_path):
    for name in ("a.pdf", "b.txt", "c.png"):
        (tmp_path / name).write_text(name)
    stream = arriving_files(spark, str(tmp_path))
    query = (
        stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    paths = [row["path"].rpartition("/")[2] for row in spark.table("arrived").collect()]
    assert sorted(paths) == ["a.pdf", "c.png"]
