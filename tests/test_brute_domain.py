"""Queries and rules without SQL, against plain Python over the same tables; every entry of every rule list is met once."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from quarry import lexicon as lx
from quarry.operators import extract as ex
from quarry.plans import documents, scoring, tenders
from tests.test_fuzzy import search

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"\w+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def md5(t):
    import hashlib

    return hashlib.md5(t.encode()).hexdigest()


def words(t):
    return len(WORD.findall(t))


def greedy(blocks, least, most, overlap):
    """(text, first, last page) of (page, text) blocks: the rule as a loop."""
    done, held, n = [], [], 0

    def flush():
        nonlocal held, n
        if held:
            done.append(("\n\n".join(t for _, t in held), min(p for p, _ in held), max(p for p, _ in held)))
        held, n = [], 0

    for page, t in blocks:
        k = words(t)
        if k > most:
            flush()
            own = WORD.findall(t)
            done.extend((" ".join(own[i : i + most]), page, page) for i in range(0, len(own), most - overlap))
            continue
        if n and n + k > most:
            flush()
        held.append((page, t))
        n += k
        if n >= least:
            flush()
    flush()
    return done


def test_greedy_chunks(spark, docs):
    want = []
    for doc, text in docs.items():
        blocks = [(i, t) for i, t in enumerate(t for t in (x.strip() for x in text.split("\n")) if t)]
        for i, (t, a, b) in enumerate(greedy(blocks, 80, 120, 10)):
            want.append((doc, i, md5(t), str(a) if a == b else f"{a}-{b}", words(t)))
    got = [(r.doc_id, r.chunk_no, r.digest, r.page_marker, r.tokens) for r in documents.greedy_chunks(spark, SF).collect()]
    assert sorted(got) == sorted(want) and any("-" in w[3] for w in want)


def test_table_chunks(spark, docs):
    want = []
    head = "| name | value |\n| --- | --- |"
    for doc, text in docs.items():
        rows = [f"| {w} | x |" for w in WORD.findall(text)]
        if not rows:
            continue
        budget, held, n, out = max(1, 30 - words(head)), [], 0, []
        for r in rows:
            if held and n + words(r) > budget:
                out.append(held)
                held, n = [], 0
            held, n = [*held, r], n + words(r)
        out.append(held)
        want += [(doc, i, md5(head + "\n" + "\n".join(h)), False) for i, h in enumerate(out)]
    got = [(r.doc_id, r.chunk_no, r.digest, r.parameters) for r in documents.table_chunks(spark, SF).collect() if docs[r.doc_id] and WORD.search(docs[r.doc_id])]
    assert sorted(got) == sorted(want) and len(want) > 1000


def tender(r):
    lines = [f"第{r.p_size % 9 + 1}章 投标要求"]
    lines += ["投标人必须具备承装修试资质，详见第三章"] if r.p_partkey % 2 == 0 else ["建议优先考虑类似工程业绩"]
    lines += [f"技术评分分值{r.p_size}分"]
    lines += ["未按要求密封的按废标处理"] if r.p_partkey % 3 == 0 else []
    lines += [f"项目经理须具备一级建造师资格，社保{r.p_size % 12 + 1}个月，{r.p_size}年以上工作经验", f"工期：{r.p_size}天", f"电压等级{15 if r.p_partkey % 5 == 0 else 110}kV的变电站施工业绩要求"]
    return [x for x in lines if len(x) >= 6]


@pytest.fixture(scope="module")
def parts(spark):
    return spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size").collect()


def test_technical_requirements(spark, parts):
    """Number, kind, voltage and how deviations are treated, sentence by sentence."""
    want = []
    for r in parts:
        n = 0
        for s in tender(r):
            must = "要求" in s
            if len(s) >= 10 and (any(k in s for k in ex.TECHNICAL) or re.search(ex.POWER, s) and must):
                n += 1
                kind = next((name for name, p in ex.TECH_KINDS if re.search(p, s)), "general")
                volts = re.search(r"(\d+(?:\.\d+)?)\s*[kK][vV]", s)
                want.append((r.p_partkey, f"TECH-{n:03d}", kind, f"{volts[1]}kV" if volts else None))
    got = [(r.p_partkey, r.req_id, r.category, r.voltage_level) for r in tenders.technical_requirements(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({w[3] for w in want}) >= 2


def test_format_signature(spark, parts):
    """D13 over the tenders: envelopes in order of first appearance, and format clauses."""
    clauses = ("格式要求", "编排要求", "字体", "字号", "页码", "目录", "页眉", "页脚", "纸张", "A4", "A3", "份数", "装订", "密封")
    want = []
    for r in parts:
        said = tender(r)
        covers = list(dict.fromkeys(m for s in said for m in re.findall("密封|封装|信封|外包装|标[书]?袋", s)))
        want.append((r.p_partkey, None, ",".join(covers), min(20, sum(any(c in s for c in clauses) for s in said))))
    got = [(r.p_partkey, r.paper_copies, r.envelopes, r.clauses) for r in tenders.format_signature(spark, SF).collect()]
    assert sorted(got) == sorted(want) and {w[2] for w in want} == {"", "密封"}


def test_format_signature_by_hand(spark):
    text = ["正本 1 份，副本 4 份", "正本2份", "电子版3套，U盘5个", "须胶装并加盖公章", "法定代表人签字，骑缝章", "投标函与授权委托书", "装入信封后密封"]
    said = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "k long, pos int, content string")
    r = ex.format_signature(said, "k").first()
    assert (r.paper_copies, r.electronic_copies, r.binding_method) == (1, 3, "胶装") and r.signature_pages == ["投标函", "授权委托书"] and r.envelope_requirements == ["信封", "密封"]
    assert r.format_clauses == [text[6]] and "骑缝章" in r.seal_requirements


def test_condition_coverage(spark, parts):
    """One condition where the tender has it, covered by its own text."""
    got = {r.p_partkey: (r.rate, r.missing, r.fatal_missing) for r in tenders.condition_coverage(spark, SF).collect()}
    want = {}
    for r in parts:
        said = tender(r)
        found = [s for s in said if any(k in s for k in ex.DISQUALIFY)]
        if found:
            text = "\n".join(said)
            ok = "密封" in text or ("格式" in text and "签章" in text)
            hard = [bool(re.search("废标|否决投标|取消投标资格|取消中标资格|无效投标|投标无效", s)) for s in found]
            want[r.p_partkey] = (1.0 if ok else 0.0, 0 if ok else len(found), 0 if ok else sum(hard))
    assert got == want and len(set(want.values())) == 2 - all(v[0] == 1 for v in want.values())


def test_team_match(spark):
    """Each project's team is that of the whole search."""
    pool, want = collections.defaultdict(list), {}
    for r in spark.read.parquet(f"{SF}/supplier.parquet").collect():
        pool[r.s_nationkey].append(r)
    for project, people in pool.items():
        options = {}
        for slot, (step, least, free) in enumerate(((2, 3, True), (3, 0, False), (5, 0, False))):
            own = [(r.s_acctbal / 100, r.s_suppkey) for r in people if r.s_suppkey % step == 0 and r.s_suppkey % 12 >= least and not (free and r.s_suppkey % 4 > 0)]
            options[slot] = sorted(own, key=lambda x: (-x[0], x[1]))
        team = search([0, 1, 2], options)
        want |= {(project, slot): team.get(slot, (None, 0.0)) for slot in range(3)}
    got = {(r.project_id, r.slot): (r.asset_id, r.score) for r in scoring.team_match(spark, SF).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_enhanced_markdown(spark):
    """The length of front matter, headings, metadata and texts in order."""
    sections = collections.defaultdict(list)
    for r in documents.sx.sectionize(documents.docs(spark, SF), "doc_id").collect():
        sections[r.doc_id].append((r.section_no, f"## {r.title}\n- anchor: {r.anchor}\n\n{r.content}"))
    want = {doc: len(f"---\ndoc: {doc}\n---\n\n" + "\n\n".join(t for _, t in sorted(own))) for doc, own in sections.items()}
    assert {r.doc_id: r.n for r in tenders.enhanced_markdown(spark, SF).collect()} == want


def lists():
    """Rule lists (name, pattern) and keyword lists of both modules."""
    rules, keywords = {}, {}
    for module in (lx, ex):
        for name, value in vars(module).items():
            if name.isupper() and isinstance(value, tuple) and value:
                if all(isinstance(x, tuple) and len(x) == 2 and all(isinstance(y, str) for y in x) for x in value):
                    rules[name] = value
                elif all(isinstance(x, str) for x in value):
                    keywords[name] = value
    return rules, keywords


def test_every_rule_and_keyword_is_met(spark):
    """A text for each plain alternative of each rule, and for each keyword, alone and with another; names and hits as plain Python has them."""
    rules, keywords = lists()
    plain = [w for own in rules.values() for _, p in own for w in p.split("|") if not re.search(r"[\\\[\](){}?*+.^$]", w)]
    entries = list(dict.fromkeys([*plain, *(w for own in keywords.values() for w in own)]))
    texts = [(i, f"前文{w}后文{entries[(i * 7 + 3) % len(entries)] if i % 2 else ''}结束") for i, w in enumerate(entries)]
    df = spark.createDataFrame(texts, "i int, t string")
    columns = [lx.first_match(F.col("t"), own, None).alias(f"r_{n}") for n, own in rules.items()]
    columns += [lx.any_of(F.col("t"), own).alias(f"a_{n}") for n, own in keywords.items()] + [lx.all_hits(F.col("t"), own).alias(f"h_{n}") for n, own in keywords.items()]
    met = collections.Counter()
    for r in df.select("t", *columns).collect():
        for n, own in rules.items():
            want = next((name for name, p in own if re.search(p, r.t)), None)
            assert r[f"r_{n}"] == want, (n, r.t)
            met[n] += want is not None
        for n, own in keywords.items():
            want = [k for k in own if k in r.t]
            assert (r[f"a_{n}"], list(r[f"h_{n}"])) == (bool(want), want), (n, r.t)
            met[n] += bool(want)
    assert len(entries) > 200 and all(met[n] for n in keywords) and sum(met[n] > 0 for n in rules) >= 0.8 * len(rules)
