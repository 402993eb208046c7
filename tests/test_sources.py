"""Listing a folder of files."""

import pytest

from foliomark.session import shared_folder
from foliomark.sources.corpus import distinct_sorted_paths, list_files, read_corpus, scan_corpus, scan_one


@pytest.fixture
def folder(tmp_path):
    for name in ("a.pdf", "B.PDF", "c.pptx", "d.ppt", "e.webp", "f.txt", "sub/g.tif", "k=v/h.gif"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(name)
    return str(tmp_path)


def names(df):
    return sorted((row["file"], row["kind"]) for row in df.select("file", "kind").collect())


FLAT = [("a.pdf", "pdf"), ("c.pptx", "pptx"), ("d.ppt", "pptx"), ("e.webp", "image")]


def test_flat_listing(spark, folder):
    assert names(scan_corpus(spark, folder)) == FLAT


def test_recursive_listing(spark, folder):
    found = names(scan_corpus(spark, folder, recursive=True))
    assert found == sorted([*FLAT, ("g.tif", "image"), ("h.gif", "image")])


def test_empty_and_hidden_files_are_listed(spark, folder, tmp_path):
    (tmp_path / "empty.pdf").touch()
    (tmp_path / "sub" / "_none.tif").touch()
    (tmp_path / "sub" / ".hidden.pdf").write_text("x")
    (tmp_path / "folder.pdf").mkdir()
    assert names(scan_corpus(spark, folder)) == sorted([*FLAT, ("empty.pdf", "pdf")])
    found = scan_corpus(spark, folder, recursive=True)
    assert names(found) == sorted([*FLAT, ("g.tif", "image"), ("h.gif", "image"), ("empty.pdf", "pdf"), ("_none.tif", "image"), (".hidden.pdf", "pdf")])
    sizes = {r["file"]: r["length"] for r in found.collect()}
    assert sizes["empty.pdf"] == 0 and sizes["a.pdf"] == 5
    assert found.where("modificationTime > '2020-01-01'").count() == found.count()


@pytest.mark.parametrize("recursive, any_case", [(False, False), (True, False), (True, True)])
def test_listing_agrees_with_the_binary_source(spark, folder, recursive, any_case):
    """Same rows where nothing is empty or hidden; paths are written alike."""
    columns = ["path", "file", "kind", "length"]
    listed = scan_corpus(spark, folder, recursive, any_case).select(*columns).collect()
    read = read_corpus(spark, folder, recursive, any_case).select(*columns).collect()
    assert sorted(listed) == sorted(read) and listed


def test_deep_folders(spark, tmp_path):
    """More folders than one task lists; all levels are found."""
    wanted = []
    for i in range(70):
        place = tmp_path / f"f{i}" / "x y" / "z"
        place.mkdir(parents=True)
        (place / f"{i}.pdf").write_text("a")
        wanted.append(f"{i}.pdf")
    assert sorted(r["file"] for r in scan_corpus(spark, str(tmp_path), recursive=True).collect()) == sorted(wanted)
    assert list_files(spark, str(tmp_path)).count() == 0


def test_any_case(spark, folder):
    assert ("B.PDF", "pdf") in names(scan_corpus(spark, folder, any_case=True))


def test_single_file(spark, folder):
    assert names(scan_one(spark, f"{folder}/B.PDF")) == [("B.PDF", "pdf")]
    assert names(scan_one(spark, f"{folder}/f.txt")) == [("f.txt", None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_one(spark, f"{folder}/missing.pdf").count()


def test_empty_folder(spark, tmp_path):
    assert scan_corpus(spark, str(tmp_path)).count() == 0


def test_content_is_only_read_when_asked(spark, folder):
    df = read_corpus(spark, folder, recursive=True).select("file")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_paths_are_ordered_folder_by_folder(spark):
    given = ["a/b", "a.c", "a/a", "a/b", "a"]
    df = spark.createDataFrame([(p,) for p in given], "path string")
    assert [row["path"] for row in distinct_sorted_paths(df).collect()] == ["a", "a/a", "a/b", "a.c"]


class Cluster:
    """Stands for a session whose settings a test cannot change."""

    def __init__(self, folder, master="yarn"):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda _: None})()


def test_shared_folder_is_the_one_the_cluster_names():
    assert shared_folder(Cluster("hdfs://all/see/")) == "hdfs://all/see"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster(None))


def test_local_cluster_is_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Cluster(None, "local-cluster[2,1,1024]"))


def test_scratch_folders_go(spark):
    from foliomark.session import run_folder, scratch

    with scratch(spark):
        folder = run_folder(spark, "scratch-test")
        spark.range(3).write.parquet(folder)
        assert spark.read.parquet(folder).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_file_sink_refuses_shared_names(spark, tmp_path):
    from foliomark.sources.sinks import write_markdown_files

    rows = [("o/a.md", 0, "x"), ("o/a.md", 1, "y"), ("o/a.part1.md", 0, "z")]
    documents = spark.createDataFrame(rows, "output string, part_no long, markdown string")
    with pytest.raises(ValueError, match="a.part1.md"):
        write_markdown_files(documents, f"{tmp_path}/out")
    write_markdown_files(documents.where("markdown <> 'z'"), f"{tmp_path}/out").count()
    assert sorted(p.name for p in (tmp_path / "out").glob("*.md")) == ["a.md", "a.part1.md"]


def test_missing_folder(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_corpus(spark, f"{tmp_path}/missing")


def files_below(folder):
    return {str(p.relative_to(folder)): p.read_text(encoding="utf-8") for p in folder.rglob("*") if p.is_file()}


def test_file_sink_commits_as_a_whole(spark, tmp_path):
    """A task that fails leaves no file; the run after it gives the whole folder, also where files are there already."""
    from pyspark.sql import functions as F

    from foliomark.sources.sinks import write_files

    texts = spark.range(40, numPartitions=4).selectExpr("concat('d', id % 3, '/', id, '.md') AS file", "concat('ü', id) AS text")
    broken = texts.withColumn("text", F.when(F.col("file") == "d1/37.md", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        write_files(broken, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists() or files_below(tmp_path / "out") == {}
    wanted = {f"d{i % 3}/{i}.md": f"ü{i}" for i in range(40)}
    for _ in range(2):
        sizes = write_files(texts, f"{tmp_path}/out")
        assert files_below(tmp_path / "out") == wanted
    assert {r["file"]: r["bytes"] for r in sizes.collect()} == {f: len(t.encode()) for f, t in wanted.items()}
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")] == []


def test_file_sink_keeps_no_python_process_on_the_driver(spark, tmp_path):
    """Spark has one for each data source that it looks up, plans and commits; the source itself gives the same files."""
    from pyspark.sql import functions as F

    from foliomark.sources import files_sink
    from foliomark.sources.sinks import write_files

    texts = spark.range(30, numPartitions=3).select(F.concat(F.lit("d/"), "id", F.lit(".md")).alias("file"), F.col("id").cast("string").alias("text"))
    asked = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(spark.dataSource), "register", lambda *source: asked.append(source))
        write_files(texts, f"{tmp_path}/out").count()
    assert asked == []
    spark.dataSource.register(files_sink.TextFiles)
    texts.write.format(files_sink.TextFiles.name()).mode("append").save(f"{tmp_path}/source")
    assert files_below(tmp_path / "out") == files_below(tmp_path / "source") == {f"d/{i}.md": str(i) for i in range(30)}


def test_file_sink_clears_up_after_a_task_or_commit_that_fails(spark, tmp_path, monkeypatch):
    from foliomark.sources import files_sink
    from foliomark.sources.sinks import write_files

    # no folder can be made where a file has the name
    clash = spark.createDataFrame([("a", "x"), ("a/b.md", "y")], "file string, text string").coalesce(1)
    with pytest.raises(Exception, match="a/b.md|Cannot create directory|Not a directory"):
        write_files(clash, f"{tmp_path}/out")
    assert files_below(tmp_path / "out") == {} and list((tmp_path / "out").iterdir()) == []
    monkeypatch.setattr(files_sink.TextFilesWriter, "commit", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        write_files(clash.limit(1), f"{tmp_path}/out")
    assert files_below(tmp_path / "out") == {} and list((tmp_path / "out").iterdir()) == []


def test_file_sink_leaves_no_shuffle_of_the_texts(spark, tmp_path):
    import os
    import time

    from pyspark.sql import functions as F

    from foliomark.session import SHUFFLES_GO
    from foliomark.sources.sinks import write_files

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {at for at in files.split("\n") if "/shuffle_" in at}

    rows = spark.range(40).select(F.concat("id", F.lit(".md")).alias("file"), F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(3_000)), lambda i: F.sha2((F.col("id") * 10_000 + i).cast("string"), 256))).alias("text"))
    before, setting = shuffled(), spark.conf.get(SHUFFLES_GO, None)
    assert write_files(rows.repartition(3, "file"), f"{tmp_path}/out").agg(F.sum("bytes")).first()[0] == 40 * 3_001 * 64
    for _ in range(50):  # they go in the background
        left = sum(os.path.getsize(at) for at in shuffled() - before if os.path.exists(at))
        if left < 100_000:
            break
        time.sleep(0.2)
    assert left < 100_000
    assert spark.conf.get(SHUFFLES_GO, None) == setting


def test_file_sink_works_texts_out_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from foliomark.sources.sinks import write_files

    made = spark.sparkContext.accumulator(0)

    def name(i):
        made.add(1)
        return f"{i}.md"

    rows = spark.range(7).select(F.udf(name)("id").alias("file"), F.lit("text").alias("text"))
    sizes = write_files(rows, f"{tmp_path}/out")
    assert sorted(tuple(r) for r in sizes.collect()) == [(f"{i}.md", 4) for i in range(7)]
    assert sorted(p.name for p in (tmp_path / "out").glob("*.md")) == [f"{i}.md" for i in range(7)]
    assert made.value == 7


def test_commit_makes_a_folder_once(tmp_path, monkeypatch):
    from pyarrow import fs

    from foliomark.sources import files_sink

    asked = []

    class Watched:
        def __init__(self, target):
            self.target = target

        def __getattr__(self, name):
            return getattr(self.target, name)

        def create_dir(self, path, **how):
            asked.append(path)
            self.target.create_dir(path, **how)

    monkeypatch.setattr(files_sink, "opened", lambda folder: (Watched(fs.LocalFileSystem()), folder))
    writer = files_sink.TextFilesWriter(str(tmp_path))
    for i in range(20):
        place = tmp_path / writer.staging / "0-0" / f"d{i % 2}"
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{i}.md").write_text(str(i))
    writer.commit([files_sink.Staged(f"{writer.staging}/0-0")])
    assert files_below(tmp_path) == {f"d{i % 2}/{i}.md": str(i) for i in range(20)}
    assert sorted(asked) == [f"{tmp_path}/d0", f"{tmp_path}/d1"]


def test_commit_lists_a_bounded_number_of_files_at_once(tmp_path, monkeypatch):
    """However many files a task has written, the driver holds the list of one staging folder."""
    import pyarrow as pa
    from pyarrow import fs
    from pyspark import TaskContext

    from foliomark.sources import files_sink

    listed = []

    class Watched:
        def __init__(self, target):
            self.target = target

        def __getattr__(self, name):
            return getattr(self.target, name)

        def get_file_info(self, asked):
            found = self.target.get_file_info(asked)
            if isinstance(asked, fs.FileSelector):
                listed.append(sum(info.type == fs.FileType.File for info in found))
            return found

    class Task:
        partitionId, taskAttemptId = (lambda _: 3), (lambda _: 17)

    monkeypatch.setattr(files_sink, "opened", lambda folder: (Watched(fs.LocalFileSystem()), folder))
    monkeypatch.setattr(files_sink, "MOVED_AT_ONCE", 4)
    monkeypatch.setattr(TaskContext, "get", lambda: Task())
    wanted = {f"d{i % 2}/{i}.md": f"ü{i}" for i in range(22)}
    rows = pa.RecordBatch.from_pydict({"file": list(wanted), "text": list(wanted.values())})
    writer = files_sink.TextFilesWriter(str(tmp_path))
    writer.commit([writer.write(iter([rows.slice(0, 9), rows.slice(9)])), None])
    assert files_below(tmp_path) == wanted
    assert listed == [4, 4, 4, 4, 4, 2]


def test_texts_are_listed_and_read_by_tasks(spark, tmp_path):
    """Every file that the listing gives, the driver knowing none of them."""
    from foliomark.sources.corpus import read_texts

    wanted = {"a b+%41.md": "ü\n\r\n\n", "_hidden.md": "x", "empty.md": "", "long.md": "long " * 2_000_000}
    for name, text in (wanted | {"a.txt": "other", "sub/b.md": "below"}).items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    read = read_texts(spark, str(tmp_path), ".md")
    assert {r["file"]: r["text"] for r in read.collect()} == wanted
    assert {r["path"] for r in read.select("path").collect()} == {f"file:{tmp_path}/{name}" for name in wanted}
    assert not [at for at in read.inputFiles() if at.endswith(".md")]
    assert read_texts(spark, str(tmp_path), ".none").count() == 0


def test_documents_read_back_are_no_list_on_the_driver(spark):
    from foliomark.plans.catalog import queries

    documents = queries()["write_documents"](spark, "/root/testdata/sf0.001")
    assert not [at for at in documents.inputFiles() if at.endswith(".md")]
    assert documents.count() > 0


def test_large_folder_is_listed_piece_by_piece(tmp_path, monkeypatch):
    from pyarrow import fs

    from foliomark.sources import corpus

    for i in range(10):
        (tmp_path / f"{i}.md").write_text("x" * i)
    (tmp_path / "folder").mkdir()
    asked = []
    scandir = corpus.os.scandir

    class Entries:
        def __init__(self, folder):
            self.entries = scandir(folder)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.entries.close()

        def __iter__(self):
            return self

        def __next__(self):
            asked.append(1)
            return next(self.entries)

    monkeypatch.setattr(corpus, "LISTED_AT_ONCE", 3)
    monkeypatch.setattr(corpus.os, "scandir", Entries)
    found = corpus._found(fs.LocalFileSystem(), str(tmp_path))
    first = next(found)
    assert len(asked) == 3
    rows = [first, *found]
    assert {(path.rpartition("/")[2], length, is_folder) for path, length, _, is_folder in rows if not is_folder} == {(f"{i}.md", i, False) for i in range(10)}
    assert [path for path, _, _, is_folder in rows if is_folder] == [f"{tmp_path}/folder"]
    with pytest.raises(FileNotFoundError):
        next(corpus._found(fs.LocalFileSystem(), f"{tmp_path}/gone"))


def test_file_sink_of_nothing_and_nulls(spark, tmp_path):
    from foliomark.sources.sinks import write_files

    rows = spark.createDataFrame([("a.md", None), ("b.md", "")], "file string, text string")
    write_files(rows, f"{tmp_path}/out")
    assert files_below(tmp_path / "out") == {"a.md": "", "b.md": ""}
    write_files(rows.limit(0), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists() or files_below(tmp_path / "none") == {}


def test_machine_local_folders_are_refused_on_a_cluster(spark, tmp_path, monkeypatch):
    from foliomark.session import shared_folder as shared
    from foliomark.sources import sinks

    known = shared(spark)

    class Remote:
        _jvm, _jsc, conf = spark._jvm, spark._jsc, {"spark.checkpoint.dir": known}
        sparkContext = type("Context", (), {"master": "yarn", "getCheckpointDir": lambda _: known})()

    with pytest.raises(ValueError, match="shared file system"):
        sinks._shared(Remote(), f"{tmp_path}/out")
    assert sinks._shared(Remote(), f"{known}/out").endswith("/out")
