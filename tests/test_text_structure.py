import datetime

from pyspark.sql import functions as F

from quarry import lexicon as lx
from quarry.functions import text as tx
from quarry.operators import chunking as ch
from quarry.operators import structure as sx


def one(spark, c, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in names)).select(c).first()[0]


def test_tokens_and_slices(spark):
    assert one(spark, tx.words("t"), t="变电站 110kV, it's") == ["变电站", "110kV", "it", "s"]
    assert one(spark, tx.word_count("t"), t=None) == 0
    # the last slice may lie within the one before
    assert one(spark, tx.slices("t", 3, 1), t="a b c d e") == ["a b c", "c d e", "e"]
    assert one(spark, tx.slices("t", 3), t="") == []


def test_tables_and_lists(spark):
    assert one(spark, tx.looks_like_table("t"), t="| a | b |\n| 1 | 2 |") is True
    assert one(spark, tx.looks_like_table("t"), t="a\tb\nc\td") is True
    assert one(spark, tx.looks_like_table("t"), t="a  b  c\nd  e  f") is True
    assert one(spark, tx.looks_like_table("t"), t="plain text") is False
    assert one(spark, tx.is_markdown_table("t"), t="a | b\n--- | ---\n1 | 2") is True
    assert one(spark, tx.is_markdown_table("t"), t="a | b") is False
    assert one(spark, tx.paragraph_type("t"), t="1. first") == "LIST"
    assert one(spark, tx.paragraph_type("t", F.lit("Heading 1")), t="x") == "TITLE"
    assert one(spark, tx.table_rows("t"), t="| a | b |\n\nc\td\nx  y") == [["a", "b"], ["c", "d"], ["x", "y"]]


def test_keywords(spark):
    assert one(spark, tx.ordered_keywords("t"), t="变电 施工 变电 ab abc") == ["变电", "施工", "abc"]
    assert one(spark, tx.ordered_keywords("t", pad="k"), t="ab") == ["k1", "k2", "k3"]
    assert one(spark, tx.numbering("t"), t="第三章 总则") == "第三章"
    assert one(spark, tx.bigrams(tx.cjk("t")), t="电x压高") == ["电压", "压高"]
    assert one(spark, tx.split_paragraphs("t"), t="a\n\nb") == ["a", "b"]


def test_blocks_and_anchor(spark):
    df = spark.createDataFrame([(1, "第一章 总则\nx\n\nbody\n\n第二章 资质\n\ny")], "doc_id int, text string")
    b = sx.carry_anchor(sx.paragraph_blocks(df, ["doc_id"]), ["doc_id"], ["block_no"])
    got = [(r.block_no, r.char_start, r.anchor) for r in b.orderBy("block_no").collect()]
    assert got == [(0, 0, "第一章 总则"), (1, 9, "第一章 总则"), (2, 14, "第二章 资质"), (3, 21, "第二章 资质")]
    s = sx.sections(b, ["doc_id"]).orderBy("block_no").collect()
    assert [r.section_id for r in s] == ["S001", "S001", "S002", "S002"]
    assert [r.block_id for r in s] == ["B001", "B002", "B003", "B004"]


def test_sectionize(spark):
    df = spark.createDataFrame([(1, "intro\n# Title\nx\n### deep\ny\n1.1 Part\nz"), (2, "plain"), (3, "")], "id int, text string")
    got = [(r.id, r.section_no, r.title, r.content) for r in sx.sectionize(df, "id").orderBy("id", "section_no").collect()]
    assert got == [(1, 0, "preamble", "intro"), (1, 1, "Title", "# Title\nx\n### deep\ny"), (1, 2, "1.1 Part", "1.1 Part\nz"), (2, 0, "preamble", "plain")]


def test_labels_and_review(spark):
    df = spark.createDataFrame([("s1", "技术", "必须满足，否则废标"), ("s2", "进度", "评分标准"), ("s3", "其他", "本项目")], "id string, title string, text string")
    got = {r.id: r for r in sx.labels(df, "title", "text").collect()}
    assert got["s1"].risk_level == "high" and got["s2"].risk_level == "low" and got["s3"].reusability == "low"
    assert got["s2"].section_type == "进度计划" and got["s1"].contains_compliance_items
    reviewed = sx.risk_review(sx.labels(df, "title", "text").withColumn("confidence", F.lit(0.7)), "text").collect()
    assert {r.id: (r.quotes, r.review_confidence) for r in reviewed} == {"s1": (["必须满足，否则废标"], 0.78), "s2": (["评分标准"], 0.78)}


def test_metadata_and_standards(spark):
    df = spark.createDataFrame([("河北省 15kV 110kV 改造 GIS 变压器", ), ("12kV 新疆", ), (None, )], "text string")
    r = sx.metadata(df).collect()
    assert (r[0].voltage_level_kv, r[0].project_type, r[0].core_equipment, r[0].region) == (110, "改造", ["变压器", "GIS"], "河北")
    assert (r[1].voltage_level_kv, r[1].region, r[2].region) == (12, "新疆", None)
    s = sx.standards(spark.createDataFrame([("见 GB 50150-2016 标准",), ("GB50150",), ("none",)], "text string")).collect()
    assert [(x.standard_code, x.version_year) for x in s] == [("GB50150", 2016), ("GB50150", None), (None, None)]


def test_supersede_and_lifecycle(spark):
    df = spark.createDataFrame([("A", 2010, "active"), ("A", 2016, "active"), ("B", 2001, "active")], "code string, year int, status string")
    assert sorted(tuple(r) for r in sx.supersede(df, "code", "year").select("code", "year", "status").collect()) == [("A", 2010, "deprecated"), ("A", 2016, "active"), ("B", 2001, "active")]
    d = datetime.date
    e = spark.createDataFrame([(d(2024, 1, 1), None), (None, d(2023, 1, 1)), (None, None)], "a date, b date")
    assert [r[0] for r in e.select(sx.lifecycle_valid(F.col("a"), F.col("b"), "2023-06-01")).collect()] == [True, False, True]


def greedy(blocks, least, most, overlap=0):
    """The same by a loop."""
    import re

    word = re.compile(r"[\w一-鿿]+")
    done, parts, pages, n = [], [], [], 0

    def flush():
        nonlocal parts, pages, n
        if parts:
            done.append(("\n\n".join(parts), min(pages), max(pages)))
        parts, pages, n = [], [], 0

    for page, text in blocks:
        text = (text or "").strip()
        own = word.findall(text)
        if not text:
            continue
        if len(own) > most:
            flush()
            done.extend((" ".join(own[i : i + most]), page, page) for i in range(0, len(own), most - overlap))
            continue
        if n and n + len(own) > most:
            flush()
        parts.append(text)
        pages.append(page)
        n += len(own)
        if n >= least:
            flush()
    flush()
    return done


def test_greedy_chunks_like_a_loop(spark):
    import random

    rnd = random.Random(3)
    data = [(d, i, i // 3 + 1, " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.choice([0, 1, 3, 8, 30])))) for d in range(20) for i in range(12)]
    df = spark.createDataFrame(data, "d int, i int, page int, text string")
    got = {}
    for r in ch.greedy_chunks(df, ["d"], "i", F.col("page"), "text", 8, 12, 2).orderBy("d", "chunk_no").collect():
        got.setdefault(r.d, []).append((r.text, r.page_marker))
    for d in range(20):
        want = greedy([(p, t) for x, _, p, t in data if x == d], 8, 12, 2)
        assert got.get(d, []) == [(t, str(a) if a == b else f"{a}-{b}") for t, a, b in want]


def test_table_chunks(spark):
    t = "| 参数 | 值 |\n| --- | --- |\n" + "\n".join(f"| p{i} | {i} |" for i in range(5))
    parts = one(spark, ch.split_table("t", 6), t=t)
    assert len(parts) == 3 and all(p.startswith("| 参数 | 值 |\n| --- | --- |\n") for p in parts)
    assert one(spark, ch.split_table("t", 6), t="no table") == ["no table"]
    assert one(spark, ch.is_parameter_table("t"), t=t) is True
    assert one(spark, ch.table_header("t"), t=t) == ["参数", "值"]


def test_table_summary_and_islands(spark):
    df = spark.createDataFrame([(1, "x\n| 姓名 | 职务 |\n| a | b |\ny\n| one |\nz")], "id int, text string")
    r = sx.table_summary(sx.table_islands(df, "id")).collect()
    assert [(x.first_line, x.rows, x.table_type, x.key_columns, x.row_estimate) for x in r] == [(1, 2, "人员简历", ["姓名", "职务"], 1)]


def test_exceptions(spark):
    df = spark.createDataFrame([("s1", 0.5, 1, 30, ["T1"]), ("s2", 0.9, 1, 1, None)], "id string, confidence double, page_start int, page_end int, empty_tables array<string>")
    assert sorted(tuple(r)[:3] for r in sx.exceptions(df, ["id"]).collect()) == [("s1", "LOW_CONFIDENCE", "confidence=0.50"), ("s1", "SECTION_TOO_LONG", "pages=30"), ("s1", "TABLE_EMPTY", "table_id=T1")]


def test_lexicon(spark):
    assert one(spark, lx.first_match(F.col("t"), lx.SECTION_TYPES, "其他"), t="施工方案和质量") == "质量保证"
    assert one(spark, lx.all_hits(F.col("t"), ("b", "a")), t="a b") == ["b", "a"]


def test_split_table_on_odd_tables(spark):
    import random
    import re

    rnd = random.Random(5)

    def want(text, most):
        lines = text.strip(" \t\n\x0b\f\r").split("\n")
        at = next((i for i, x in enumerate(lines) if i and re.fullmatch(r"\|[-:| ]+\|\r?", x.strip(" "))), None)
        rows = [x.strip(" ") for x in lines[at + 1 :] if x.strip(" ")] if at is not None else []
        head, out, held = "\n".join(lines[: (at or 0) + 1]), [], []
        n = lambda x: len(re.findall(r"\w+", x))
        for r in rows:
            if held and n("\n".join(held)) + n(r) > max(1, most - n(head)):
                out.append("\n".join([head, *held]))
                held = []
            held.append(r)
        return [*out, "\n".join([head, *held])] if rows else [text]

    cells = ["", "a", "a_b c", "Größe", "容量 型号", "½ 5", "!!", "—", "𝒳y", "e\u0301f", "  x "]
    data = [(i, "\n".join(["", "| a 参数 | b |", rnd.choice(["| --- | :-: |", "|---|\r", "no rule"]), *["  " * rnd.randrange(2) + "| " + " | ".join(rnd.choice(cells) for _ in range(rnd.randrange(4))) + " |" * rnd.randrange(2) for _ in range(rnd.randrange(12))], rnd.choice(["", "| |", " \t"])])) for i in range(150)]
    data += [(200, ""), (201, "| a |\n| --- |"), (202, "| a |\n| --- |\n" + "w " * 50 + "\n\n|\n|\nx")]
    got = {r.i: r.c for r in spark.createDataFrame([*data, (203, None)], "i int, t string").select("i", ch.split_table("t", 7).alias("c")).collect()}
    assert got == {i: want(t, 7) for i, t in data} | {203: [""]} and max(map(len, got.values())) > 5


def test_table_chunks_looks_at_a_table_once(spark):
    from quarry.plans import documents

    plan = documents.table_chunks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # printed from the top: the look at the header is below the generator, so it is taken for a table, not for each of its chunks
    assert plan.index("Generate") < plan.index("AS parameters") and plan.count("ArrowEvalPython") == 1
