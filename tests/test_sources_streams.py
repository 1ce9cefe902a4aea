import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry import seams
from quarry.sources import readers as rd
from quarry.sources import sinks as sk
from quarry.streaming import streams as ss

DOCX = """<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body  text</w:t></w:r></w:p><w:p><w:r><w:t>1. item</w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in files.items():
            z.writestr(n.replace("__", "/"), d)
    return b.getvalue()


def test_docx():
    assert rd.docx_blocks(zipped(**{"word__document.xml": DOCX})) == [("TITLE", "Title"), ("PARA", "Body text"), ("LIST", "1. item"), ("TABLE", "a | b")]


def test_decode():
    assert rd.decode("\ufeffé".encode()) == "é" and rd.decode("电压".encode("gb18030")) == "电压"


def test_package():
    good = {"manifest.json": "{}", "full.md": "# x"}
    assert {n for n, _ in rd.package(zipped(**good))} == set(good)
    for bad in ({"manifest.json": "{}"}, good | {"..__evil": "x"}, good | {"bomb": "0" * 5_000_000}):
        with pytest.raises(ValueError):
            rd.package(zipped(**bad))


def test_files_with_errors(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(zipped(**{"word__document.xml": DOCX}))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.doc").write_bytes(b"old")
    files = rd.route(rd.files(spark, str(tmp_path), ("docx", "doc")))
    assert sorted((r.suffix, r.error) for r in files.collect()) == [("doc", "old .doc is not supported"), ("docx", None), ("docx", None)]
    rows = rd.docx_files(files.where("reader = 'docx'"))
    assert tuple(rd.batch_summary(rows).first()) == (2, 1, "PARTIAL_SUCCESS")


def test_ocr_routing(spark):
    pages = spark.createDataFrame([("a", 0, "x" * 300, 0, 0.9), ("a", 1, "", 1, 0.0)], "path string, no int, text string, images int, ratio double")
    out = rd.ocr_routed(pages, lambda df: df.select("path", "no", F.lit("").alias("ocr_text")), lambda df: df.select("path", "no", F.lit("read").alias("ocr_text")))
    assert [r.text for r in out.orderBy("no").collect()] == ["x" * 300, "read"]


def test_sinks(spark, tmp_path):
    t = spark.range(1).select(sk.markdown_table(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1|2")))).alias("t")).first().t
    assert t == "| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    ids = spark.createDataFrame([("d", "c"), ("d", "c"), ("d", "e")], "a string, b string").select(sk.point_id(F.col("a"), F.col("b")).alias("i")).collect()
    assert ids[0] == ids[1] != ids[2]
    old, new = spark.createDataFrame([(1, "a", 1)], "k int, v string, n int"), spark.createDataFrame([(1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    assert sorted((r.k, r.v) for r in sk.upserted(old, new, "k", "n").collect()) == [(1, "b"), (2, "c")]
    sk.write_csv(old, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 1


def test_staging(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    staged = rd.stage(df, str(tmp_path / "s"))
    rd.promote(spark, staged, df.where("k = 2"), str(tmp_path / "t"), "k")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [(2, "b")]


def test_seams(spark):
    r = spark.createDataFrame([(["First one. x；y", "", "Second；z"],)], "s array<string>").select(seams.mock_generate(F.col("s")).alias("g")).first().g
    assert r == "First one. x\nSecond"
    log = []
    assert seams.run_steps({"a": lambda: log.append(1), "b": lambda: 1 / 0, "c": lambda: log.append(3)}, {"a": "success"})["b"].startswith("failed") and log == []
    e = seams.embed(spark.createDataFrame([(1, "a b a")], "k int, t string"), "k", "t", 16).first().embedding
    assert len(e) == 16 and abs(sum(x * x for x in e) - 1) < 1e-9


def test_streaming_state_equals_batch(spark, tmp_path):
    from quarry.operators.state import routing_stats
    from quarry.plans.streams import finish

    data = [(f"m{i % 3}", i, i % 4 != 0, float(i * 13 % 50)) for i in range(60)]
    schema = "model string, i int, ok boolean, latency double"
    for n in range(3):
        spark.createDataFrame(data[n * 20 : n * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        for f in (tmp_path / f"b{n}").glob("part*"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = finish(ss.routing_stats(stream, "model", "i", "ok", "latency"), "update")
    last = {r.model: (r.attempts, r.successes, r.latency) for r in out.orderBy("attempts").collect()}
    want = {r.model: (r.attempts, r.successes, r.latency) for r in routing_stats(spark.createDataFrame(data, schema), ["model"], ["i"], "ok", "latency").collect()}
    assert last == want
