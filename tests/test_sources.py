import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedloom.session import Settings, settings
from deedloom.sources import cache, files
from deedloom.sources.tables import first_load
from deedloom.streaming.ingest import ingest


def test_document_key(spark):
    import hashlib

    df = spark.createDataFrame([(".PDF", b"\xff\x00")], "s string, c binary")
    got = df.select(cache.document_key(F.col("s"), F.col("c"))).first()[0]
    assert got == hashlib.sha256(b"v1.pdf\xff\x00").hexdigest()


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("cache_version", T.StringType())])


def test_parquet_cache(spark, tmp_path):
    store = cache.ParquetCache(spark, str(tmp_path / "c"), SCHEMA, ("k",), "v1")
    calls = []

    def compute(df):
        calls.append(sorted(r.k for r in df.collect()))
        return df.select("k", F.length("k").alias("v"), F.lit("v1").alias("cache_version"))

    want = spark.createDataFrame([("a",), ("bb",)], "k string")
    assert store.read().count() == 0
    assert {(r.k, r.v) for r in store.get_or_compute(want, compute).collect()} == {("a", 1), ("bb", 2)}
    more = spark.createDataFrame([("bb",), ("ccc",)], "k string")
    assert store.get_or_compute(more, compute).count() == 2
    store.get_or_compute(more, compute, force_refresh=True)
    assert calls == [["a", "bb"], ["ccc"], ["bb", "ccc"]]
    assert cache.ParquetCache(spark, str(tmp_path / "c"), SCHEMA, ("k",), "v2").read().count() == 0


def test_corrupt_cache_is_empty(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part.parquet").write_bytes(b"nonsense")
    assert cache.ParquetCache(spark, str(tmp_path / "c"), SCHEMA, ("k",), "v1").read().count() == 0


def test_corrupt_payload(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), (None,)], "p string")
    assert [r[0] and r[0].a for r in df.select(cache.parse_entries(F.col("p"), "a int")).collect()] == [1, None, None]


def test_files_and_parser(spark, tmp_path):
    for name, content in (("a.pdf", b"good"), ("b.PDF", b"bad"), ("c.docx", b"x"), ("empty.pdf", b"")):
        (tmp_path / name).write_bytes(content)
    found = files.files(spark, str(tmp_path), "application/pdf")
    assert sorted(r.filename for r in found.collect()) == ["a.pdf", "b.PDF"]
    upload = spark.createDataFrame([("z", "empty.pdf", ".pdf", b""), ("y", "null.pdf", ".pdf", None)], found.schema)
    good, empty = files.guard_empty(found.unionByName(upload))
    assert empty.count() == 2

    def make():
        def parse(content, name):
            if content == b"bad":
                raise ValueError("unreadable")
            spans = [{"text": content.decode(), "bbox": None, "font": None, "size": None, "flags": None}]
            return [{"page_index": 0, "width": 1.0, "height": 1.0, "raw_blocks": [{"i": 0, "type": 0, "bbox": None, "lines": [{"spans": spans}]}]}]

        return parse

    pages, errors = files.parse_files(good, make)
    from deedloom.operators.blocks import canonical_blocks

    assert [r.text for r in canonical_blocks(pages).collect()] == ["good"] and "unreadable" in errors.first().error


def test_temp_file_is_removed():
    import os

    seen = []

    def read(path):
        seen.append(path)
        raise ValueError

    try:
        files.with_temp_file(read)(b"x", "a.pdf")
    except ValueError:
        pass
    assert seen[0].endswith(".pdf") and not os.path.exists(seen[0])


def test_provenance_artefact(spark, tmp_path):
    chunk = {"chunk_id": 1, "text": "t", "item_geometry": [{"ref": "#/1", "page_no": 2, "bbox": [1, 2, 3, 4], "page_width": 9, "page_height": 8}]}
    (tmp_path / "p.json").write_text(json.dumps({"version": 1, "chunks": {"1": chunk}}))
    df = files.provenance_artefact(spark, str(tmp_path / "p.json"))
    g = files.geometry(df, "chunk_id").first()
    assert (g.chunk_id, g.ref, g.x1, g.page_height) == (1, "#/1", 3, 8)


def test_first_load(spark):
    rows = [(1, "a", 5), (1, "a", 3), (2, None, 1), (None, "z", 2), (4, "n", None)]
    df = spark.createDataFrame(rows, "k int, v string, loaded_at int")
    assert {tuple(r) for r in first_load(df, "k").collect()} == {(1, "a", 3), (2, None, 1), (None, "z", 2), (4, "n", None)}


def test_settings(monkeypatch, spark):
    monkeypatch.setenv("DEEDLOOM_ENVIRONMENT", "test")
    assert Settings.read().environment == "test" and settings() is settings()
    spark.conf.set("spark.deedloom.environment", "cluster")
    assert Settings.read(spark).environment == "cluster"
    spark.conf.unset("spark.deedloom.environment")


def test_stream_ingestion(spark, tmp_path):
    source, store = str(tmp_path / "in"), cache.ParquetCache(spark, str(tmp_path / "c"), SCHEMA, ("k",), "v1")
    compute = lambda df: df.select("k", F.length("k").alias("v"), F.lit("v1").alias("cache_version"))
    for batch in (["a", "bb"], ["bb", "ccc"]):
        spark.createDataFrame([(x,) for x in batch], "k string").write.mode("append").parquet(source)
        ingest(spark, source, "k string", store, compute, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.k, r.v) for r in store.read().collect()) == [("a", 1), ("bb", 2), ("ccc", 3)]


def test_blocks_have_whole_lines(spark, tmp_path):
    from deedloom.plans import catalog

    line = "Notices " * 40 + "end"
    spark.createDataFrame([(1, line)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert [r.text for r in run("derived_blocks")] == ["1. " + line]
    assert [r.title for r in run("section_match")] == [line] and run("is_section_heading") == []


def test_cache_refresh_renews_one_key(spark, tmp_path):
    store = cache.ParquetCache(spark, str(tmp_path / "c"), SCHEMA, ("k",), "v1")
    size = lambda n: lambda df: df.select("k", (F.length("k") * n).alias("v"), F.lit("v1").alias("cache_version"))
    want = spark.createDataFrame([("a",), ("bb",), ("ccc",), ("ccc",), (None,)], "k string")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(store.get_or_compute(want, size(1))) == [("a", 1), ("bb", 2), ("ccc", 3)]
    assert rows(store.get_or_compute(want.where("k = 'a'"), size(5), force_refresh=True)) == [("a", 5)]
    assert rows(store.read()) == [("a", 5), ("bb", 2), ("ccc", 3)]
    (tmp_path / "c" / "part-x.parquet").write_bytes(b"nonsense")
    assert rows(store.read()) == [("a", 5), ("bb", 2), ("ccc", 3)]


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    import pytest

    from deedloom import session

    class Context:
        master = "spark://x"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, k, d=None: d})()

    with pytest.raises(ValueError):
        session.shared_folder(Session())
