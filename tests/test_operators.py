"""Operators on small tables with planted faults."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import attest, chunk, evaluate, locate, merge, report, review, rules
from tessera.plans import queries
from tessera.sources import exchange, ingest, sinks

ANCHOR = "struct<source_id:string,source_type:string,page:int,article:string,paragraph_index:int,quote:string>"
FINDING = (
    f"finding_id string, claim_type string, category string, statement string, source_anchors array<{ANCHOR}>, "
    "inference_parents array<string>"
)
UNIT = "source_id string, source_type string, page int, article string, paragraph_index int, text string"


def anchor(quote, source="R", kind="regulatory_text", page=1, article="第一条", paragraph=0):
    return (source, kind, page, article, paragraph, quote)


LINE = "第一条 银行应当于2026年1月1日前缴纳10万元。"
OFFICIAL = "本办法旨在规范。"
WRAPPED = rules.OFFICIAL_FORM % ("监管意图", OFFICIAL)


def engine(spark, findings):
    units = [("R", "regulatory_text", 1, "第一条", 0, LINE), ("O", "official_interpretation", None, None, 0, OFFICIAL)]
    sources = [("R", "regulatory_text", LINE), ("O", "official_interpretation", OFFICIAL)]
    found = rules.validate_findings(
        spark.createDataFrame(findings, FINDING),
        spark.createDataFrame(sources, "source_id string, source_type string, content string"),
        spark.createDataFrame(units, UNIT),
        spark.createDataFrame([("O", ["R"])], "official_source_id string, primary_source_ids array<string>"),
    ).collect()
    out = {}
    for r in found:
        out.setdefault(r.finding_id, set())
        if r.status != "passed":
            out[r.finding_id].add(r.rule)
    assert len(found) == len(rules.RULES) * len(findings)
    return out


def test_validate_findings(spark):
    fact = ("regulatory_fact", "key_matter:core_requirement")
    official = ("official_explanation", "official_context:regulatory_intent")
    o = anchor(OFFICIAL, "O", "official_interpretation", None, None)
    got = engine(
        spark,
        [
            ("good", *fact, LINE, [anchor(LINE)], []),
            ("none", *fact, "x", [], []),
            ("source", *fact, LINE, [anchor(LINE, "Z")], []),
            ("page", *fact, LINE, [anchor(LINE, page=2)], []),
            ("paragraph", *fact, LINE, [anchor(LINE, paragraph=5)], []),
            ("article", *fact, LINE, [anchor(LINE, article="第二条")], []),
            ("quote", *fact, "银行", [anchor("没有")], []),
            ("modal", *fact, LINE.replace("应当", "可以"), [anchor(LINE)], []),
            ("date", *fact, LINE.replace("2026", "2027"), [anchor(LINE)], []),
            ("number", *fact, LINE.replace("10万", "11万"), [anchor(LINE)], []),
            ("inferred", "ai_inference", "institution_impact:data", "影响", [anchor(LINE)], ["good"]),
            ("orphan", "ai_inference", "institution_impact:data", "影响", [anchor(LINE)], ["gone"]),
            ("beyond", "ai_inference", "institution_impact:data", "影响", [anchor("银行")], ["good"]),
            ("official", *official, WRAPPED, [o], ["good"]),
            ("unpaired", *official, WRAPPED, [o], []),
            ("mixed", "official_explanation", "x", WRAPPED, [anchor(LINE)], ["good"]),
        ],
    )
    everything = {"source_id", "source_type", "locator_page", "locator_paragraph", "locator_article", "quote_match"}
    assert got["good"] == set() and got["inferred"] == set() and got["official"] == set()
    assert got["none"] >= everything
    assert got["source"] == everything
    assert got["page"] == {"locator_page", "locator_paragraph", "locator_article", "quote_match"}
    assert got["paragraph"] == {"locator_paragraph", "locator_article", "quote_match"}
    assert got["article"] == {"locator_article", "quote_match"}
    assert "quote_match" in got["quote"] and "locator_article" not in got["quote"]
    assert got["modal"] == {"modal_strength", "dates", "numbers"}
    assert got["date"] == {"modal_strength", "dates", "numbers"} and got["number"] == {"modal_strength", "dates", "numbers"}
    assert got["orphan"] == {"inference_parent"} and got["beyond"] == {"inference_parent"}
    assert got["unpaired"] == {"inference_parent"}
    assert {"source_type", "modal_strength", "inference_parent"} <= got["mixed"]


def test_finding_rules(spark):
    schema = FINDING + ", review_status string, revision_records array<struct<change_summary:string>>"
    rows = [("a", "regulatory_fact", "c", "s", [anchor("q")], [], "pending", []), ("b", "ai_inference", "c", " ", [], [], "deleted", [])]
    bad = rules.finding_rules(spark.createDataFrame(rows, schema)).where("not ok").collect()
    assert {(r.finding_id, r.rule) for r in bad} == {("b", "inference_has_parents"), ("b", "deleted_has_revision"), ("b", "not_blank")}


def test_tilings(spark):
    r = random.Random(2)
    fields, texts, want = [], [], {}
    for i in range(60):
        parts = ["".join(r.choice("ab") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4))]
        text = "".join(r.sample(parts, len(parts))) if r.random() < 0.7 else "ab" * r.randint(1, 4)
        fields += [(i, k, p) for k, p in enumerate(parts)]
        texts.append((i, text))
        want[i] = sum("".join(parts[k] for k in order) == text for order in itertools.permutations(range(len(parts))))
    got = rules.tilings(spark.createDataFrame(fields, "req_id long, field int, value string"), spark.createDataFrame(texts, "req_id long, text string"))
    assert {x.req_id: x.n_tilings for x in got.collect()} == want


def test_resolutions(spark):
    v = spark.createDataFrame([(f, "r", s) for f, s in (("a", "passed"), ("b", "manual_review_required"), ("c", "manual_review_required"), ("d", "failed"), ("e", "passed"), ("f", "manual_review_required"))], "finding_id string, rule string, status string")
    a = spark.createDataFrame([("b", "r", "confirmed", "s", "f", None), ("d", "r", "confirmed", "s", "f", "x"), ("e", "r", "rejected", "s", "f", None), ("f", "r", "confirmed", "s", "f", None), ("f", "r", "rejected", "s", "f", None)], "finding_id string, rule string, decision string, source_evidence_hash string, finding_hash string, atomic_requirement_hash string")
    b = spark.createDataFrame([(x, "s", "f", None) for x in "abcdef"], "finding_id string, source_evidence_hash string, finding_hash string, atomic_requirement_hash string")
    got = {(r.finding_id, r.rule): r.resolution for r in attest.resolve(v, a, b).collect()}
    assert got == {
        ("a", "r"): "automatic_passed",
        ("b", "r"): "manual_confirmed",
        ("c", "r"): "manual_review_pending",
        ("d", "r"): "failed",
        ("d", "attestation_integrity"): "attestation_integrity_failed",
        ("e", "r"): "manual_rejected",
        ("f", "r"): "attestation_integrity_failed",
    }


def test_merge_requirements_and_variants(spark):
    cols = "requirement_id string, finding_id string, " + ", ".join(f"{c} string" for c in merge.STRUCTURE) + ", source_anchors array<string>, confidence double, manual_verification_required boolean, ord long"
    row = lambda i, f, s, c, n: (i, f, s, *[None] * 9, [i], c, False, n)
    x = spark.createDataFrame([row("r1", "f", "s", 0.9, 1), row("r2", "g", "s", 0.5, 2), row("r3", "f", "t", 0.7, 3)], cols)
    alias = spark.createDataFrame([("g", "f"), ("f", "f")], "finding_id string, canonical_id string")
    (m,) = merge.merge_requirements(x, alias).collect()
    assert (m.finding_id, m.requirement_id, m.confidence, m.source_anchors, m.conflict) == ("f", "r1", 0.5, ["r1", "r2", "r3"], True)
    got = {r.requirement_id: (r.finding_id, r.needs_review) for r in merge.expand_conflicts(x).collect()}
    assert got == {"r1": ("f", False), "r2": ("g", False), "r3": ("f~atomic-2", True)}


def test_release_gate(spark):
    names = [f"{m}_{k}" for k in [*evaluate.CRITICAL, "atomic"] for m in ("precision", "recall")]
    tail = "citation_rate double, n_unmarked long, n_omissions long, ocr_accuracy double, ocr_coverage boolean, n_pending long"
    schema = ", ".join(f"{n} double" for n in names) + ", " + tail
    good = [1.0] * 10 + [1.0, 0, 0, 1.0, True, 0]
    bad = [1.0] * 6 + [1.0, 0.0] + [0.0, 0.0] + [0.8, 1, 1, 0.98039, True, 1]
    empty = [None] * 10 + [None, 0, 0, None, False, 0]
    rows = [(*x,) for x in (good, bad, empty)]
    got = [r.failures for r in evaluate.gate(spark.createDataFrame(rows, schema)).collect()]
    assert [] in got
    assert ["critical_recall_below_95:transition_period", "atomic_precision_below_90", "atomic_recall_below_85", "citation_validity_below_100", "unmarked_ai_inference", "critical_omissions", "ocr_accuracy_below_99", "ocr_manual_review_pending"] in got
    assert [*(f"critical_category_not_evaluable:{k}" for k in evaluate.CRITICAL), "atomic_not_evaluable", "citation_not_evaluable", "ocr_not_evaluable", "ocr_page_coverage_mismatch"] in got


def chunk_brute(sizes, most, overlap):
    out, start = [], 0
    while start < len(sizes):
        end, n = start, 0
        while end < len(sizes) and n + sizes[end] <= most:
            n += sizes[end]
            end += 1
        out.append(list(range(start, end)))
        if end == len(sizes):
            break
        start = max(start + 1, end - overlap)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chunks(spark, seed):
    r = random.Random(seed)
    groups = {g: [r.randint(0, 10) for _ in range(r.randint(1, 40))] for g in "abc"} | {"five": [8] * 5}
    rows = [(g, g, k, k, 0, n) for g, sizes in groups.items() for k, n in enumerate(sizes)]
    segs = spark.createDataFrame(rows, "kind string, source_id string, segment_index long, ord long, start long, end long")
    got = {}
    for x in chunk.chunks(segs, "kind", 30, 2).collect():
        got.setdefault(x.kind, {}).setdefault(x.chunk_index, []).append(x.segment_index)
    for g, sizes in groups.items():
        assert [sorted(got[g][k]) for k in sorted(got[g])] == chunk_brute(sizes, 30, 2)
    assert [sorted(v) for v in got["five"].values()] == [[0, 1, 2], [1, 2, 3], [2, 3, 4]]


def test_logs(spark):
    log = spark.createDataFrame([("a", 1, "h0", "h1", "t1"), ("a", 2, "h1", "h2", "t2"), ("b", 1, "x", "y", "t1"), ("b", 2, "z", "w", "t0")], "finding_id string, seq long, before_hash string, after_hash string, reviewed_at string")
    base = spark.createDataFrame([("a", "h0"), ("b", "x"), ("c", "k")], "finding_id string, hash string")
    got = {r.finding_id: (r.hash, r.chain_ok) for r in review.replay(base, log, base.limit(0)).collect()}
    assert got == {"a": ("h2", True), "b": ("w", False), "c": ("k", True)}
    audits = [("a", 1, "h0", "h1", 5), ("a", 2, "h1", "h2", 5), ("b", 1, "x", "x", 1), ("c", 1, "k", "l", 3), ("c", 2, "l", "m", 2), ("d", 1, "o", "p", 1)]
    log = spark.createDataFrame(audits, "finding_id string, seq long, before_hash string, after_hash string, reviewed_at long")
    base = spark.createDataFrame([("a", "h0"), ("b", "x"), ("c", "k"), ("d", "other")], "finding_id string, hash string")
    got = {r.finding_id: r.chain_ok for r in review.replay(base, log, base.limit(0)).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}  # equal times are in order; no change, a falling time, another start are not
    commands = spark.createDataFrame([("a", "modify", "n", "me", "why", "2026-01-01T00:00:00Z"), ("z", "confirm", None, "me", "why", "2026-01-01T00:00:00Z"), ("a", "modify", "h0", "me", "why", "2026-01-01T00:00:00Z"), ("a", "confirm", None, " ", "why", "2026-01-01T00:00:00Z")], "finding_id string, action string, new_hash string, reviewer string, reason string, acted_at string")
    rows, rejects = review.apply_commands(commands, base.withColumn("review_status", F.lit("pending")))
    assert [tuple(r)[:4] for r in rows.collect()] == [("a", "modify", "h0", "n")]
    assert sorted(r.why for r in rejects.collect()) == ["nothing changed", "reviewer and reason are needed", "unknown finding"]


def test_closure_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "parent long, child long")
    seeds = spark.createDataFrame([(1,)], "node long")
    for compact in (8, 1):
        got = {r.node: r.depth for r in review.closure(edges, seeds, compact=compact).collect()}
        assert got == {1: 0, 2: 1, 3: 2, 4: 3}


def test_reanalysis(spark):
    schema = "finding_id string, category string, claim_type string, hash string"
    now = spark.createDataFrame([("a", "c", "t", "1"), ("b", "c", "t", "2"), ("d", "c", "t", "3")], schema)
    gone = spark.createDataFrame([("a", True), ("b", False)], "finding_id string, is_target boolean")
    new = spark.createDataFrame([("a", "c", "t", "9")], schema)
    got = {r.finding_id: (r.hash, r.violation) for r in review.apply_reanalysis(now, gone, new).collect()}
    assert got == {"a": ("9", None), "d": ("3", None)}
    wrong = spark.createDataFrame([("a", "x", "t", "9"), ("e", "c", "t", "8")], schema)
    got = {r.finding_id: r.violation for r in review.apply_reanalysis(now, gone, wrong).collect()}
    assert got == {"a": "kind changed", "d": None, "e": "not a target"}


def test_admission_and_decoding(spark):
    rows = [("a.pdf", b"%PDF /Encrypt 1"), ("b.pdf", b"%PDF-"), ("c.docx", b"\xd0\xcf\x11\xe0.."), ("d.txt", b""), ("e.exe", b"x"), ("f.TXT", "é".encode())]
    files = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length long, content binary")
    got = {r.path: (r.kind, r.refused) for r in ingest.admit(files).collect()}
    assert got == {"a.pdf": ("pdf", "encrypted PDF"), "b.pdf": ("pdf", None), "c.docx": ("docx", "encrypted DOCX"), "d.txt": ("txt", "empty file"), "e.exe": (None, "kind is not supported"), "f.TXT": ("txt", None)}
    texts = ["﻿héé".encode(), b"\xff\xfe" + "hé".encode("utf-16-le"), b"\xfe\xff" + "hé".encode("utf-16-be"), "hé".encode(), b"\xff"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, content binary")
    assert [r.t for r in df.select("i", ingest.decoded(F.col("content")).alias("t")).orderBy("i").collect()] == ["héé", "hé", "hé", "hé", None]


def test_lines_of_items(spark):
    items = [("s", 1, 0, "Hello", 0.0, 100.0, 30.0, 10.0), ("s", 1, 1, "world", 40.0, 101.0, 30.0, 10.0), ("s", 1, 2, "条", 71.0, 99.0, 5.0, 10.0), ("s", 1, 3, "next", 0.0, 80.0, 20.0, 10.0)]
    got = ingest.lines_of_items(spark.createDataFrame(items, "source_id string, page int, idx int, str string, x double, y double, width double, height double")).orderBy("line").collect()
    assert [r.text for r in got] == ["Hello world条", "next"]
    assert (got[0].x, got[0].y, got[0].width, got[0].height) == (0.0, 99.0, 76.0, 12.0)


def test_lines_of_pages_cut_by_batches(spark):
    """Pages go through one function batch by batch; the heights of a page hold over the cuts."""
    items = [(f"s{p}", 1, k, f"w{k}", float(k % 3) * 10, 100.0 - (k // 3) * 5, 5.0, 8.0) for p in range(7) for k in range(9)]
    df = spark.createDataFrame(items, "source_id string, page int, idx int, str string, x double, y double, width double, height double")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        lines = ingest.lines_of_items(df)
        assert "MapInArrow" in lines._jdf.queryExecution().executedPlan().toString()
        got = {(r.source_id, r.line): r.text for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == {(f"s{p}", k): f"w{3 * k} w{3 * k + 1} w{3 * k + 2}" for p in range(7) for k in range(3)}


def test_pages(spark):
    units = spark.createDataFrame([("s", 1, 0, "text"), ("s", 2, 0, "bad")], "source_id string, page int, paragraph_index int, text string")
    ocr = spark.createDataFrame([("s", 2, "seen", False), ("s", 3, "", True)], "source_id string, page int, text string, failed boolean")
    kept, failed = ingest.override_with_ocr(units, ocr)
    assert {(r.page, r.text) for r in kept.collect()} == {(1, "text"), (2, "seen")}
    fallback = spark.createDataFrame([("s", 3, " a \n\nb")], "source_id string, page int, text string")
    more, still = ingest.recover_pages(kept, failed, fallback)
    assert {(r.page, r.text) for r in more.collect()} == {(1, "text"), (2, "seen"), (3, "a"), (3, "b")} and still.count() == 0


def test_imports_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([("p1", "x", "secret"), ("p2", "y", "secret")], "project_id string, v string, token string")
    sinks.export(df, f"{tmp_path}/out", ["project_id", "v"])
    rows, rejects = sinks.import_new(spark, f"{tmp_path}/out", "project_id string, v string", df.where("project_id = 'p1'"))
    assert [tuple(r) for r in rows.collect()] == [("p2", "y")] and [tuple(r) for r in rejects.collect()] == [("p1", "known id")]
    m = spark.createDataFrame([(0.5, None)], "a double, b double")
    assert sinks.text_summary(m, ["a", "b"]).first().value == "a: 50.00%\nb: not_evaluable"


def test_sections_and_queue(spark):
    f = spark.createDataFrame([("p", k, "key_matter:prohibition", "regulatory_fact") for k in range(6)], "project_id string, ord long, category string, claim_type string")
    got = {}
    for r in report.route(f, report.QUICK).collect():
        got.setdefault(r.section, []).append(r.ord)
    assert {k: sorted(v) for k, v in got.items()} == {"one_line": [0], "top_changes": [0, 1, 2, 3, 4], "red_lines": [0, 1, 2]}


def test_blocks_and_lines(spark):
    s = spark.createDataFrame([("s", "a\r\n b \r\n\r\n　\nc")], "source_id string, content string")
    assert [r.text for r in locate.line_units(s).collect()] == ["a", "b", "c"]
    assert [r.text for r in locate.block_units(s).collect()] == ["a\n b", "c"]


@pytest.mark.parametrize("name", ["ocr_accuracy", "claim_tokens", "normalized_texts"])
def test_queries_without_sql(spark, name):
    from tessera.functions import text as T

    d = "/root/testdata/sf0.001"
    rows = queries.QUERIES[name](spark, d).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    if name == "ocr_accuracy":
        turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{d}/conversations.parquet").collect()}

        def distance(a, b):
            last = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row = [i]
                for j, y in enumerate(b, 1):
                    row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
                last = row
            return last[-1]

        assert len(rows) == len(turns)
        for r in rows[:25]:
            a, b = turns[r.conv_id, r.turn], turns.get((r.conv_id, r.turn + 1))
            assert (r.errors, r.n_chars) == (len(a) if b is None else distance(a, b), len(a))
    elif name == "claim_tokens":
        for r in rows:
            assert r.numbers == ",".join(t for _, _, t in T.number_spans(docs[r.doc_id])) and r.digest == T.fnv1a64(docs[r.doc_id])
    else:
        import hashlib

        for r in rows:
            assert r.squeezed == hashlib.sha256(T.squeezed(docs[r.doc_id]).encode()).hexdigest()


def test_passages_anywhere(spark):
    """Items of all lengths are found within words too, wherever they stand."""
    r = random.Random(4)
    texts = ["".join(r.choice("ab c") for _ in range(r.randint(0, 120))) for _ in range(60)] + [None, "", "tomcat sat here", "foobar x", "cat sat"]
    texts += [texts[3], "é" * 50 + "x" + "é" * 50]
    items = ["cat sat", " ", "foo", "", None, "é" * 23, "é" * 30 + "x" + "é" * 9]
    for t in [t for t in texts if t]:
        for _ in range(3):
            a = r.randint(0, len(t))
            items.append(t[a : a + r.choice([1, 5, 16, 22, 23, 24, 31, 60])])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted(tuple(x) for x in locate.passages(table, docs).collect())
    assert got == sorted((i, d) for i, a in enumerate(items) if a for d, t in enumerate(texts) if t and a in t)


def test_full_width_forms_are_equal(spark):
    units = spark.createDataFrame([("s", "t", 1, None, 0, "ABC12 text")], UNIT)
    sources = spark.createDataFrame([("s", "t", "x ＡＢＣ12 text")], "source_id string, source_type string, content string")
    anchors = spark.createDataFrame([("f", 0, "s", 1, None, 0, "ＡＢＣ１２")], "finding_id string, anchor_ord int, source_id string, page int, article string, paragraph_index int, quote string")
    valid = locate.authorized_units(units, sources)
    assert valid.count() == 1 and locate.locate_quotes(anchors, valid).first().quote_ok
    x = spark.createDataFrame([("a", "t", "ＡＢＣ", "s 1", 1), ("b", "t", "ABC", " s　1", 2)], "finding_id string, claim_type string, category string, statement string, ord long")
    assert {(r.finding_id, r.canonical_id) for r in merge.aliases(x).collect()} == {("a", "a"), ("b", "a")}


def test_tilings_in_order(spark):
    fields = [(1, k, v) for k, v in enumerate(["ab", "cd", "ef", "gh", "xy"])] + [(2, k, v) for k, v in enumerate(["ab", "cd", "ef", "gh"])] + [(3, 0, "ab"), (3, 2, "ef"), (3, 3, "gh")]
    texts = [(1, "xyabcdefgh"), (2, "abefcdgh"), (3, "abefgh")]
    got = rules.tilings(spark.createDataFrame(fields, "req_id long, field int, value string"), spark.createDataFrame(texts, "req_id long, text string"), in_order=4)
    assert {r.req_id: r.n_tilings for r in got.collect()} == {1: 1, 2: 0, 3: 0}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\n b".encode())
    (tmp_path / "b.exe").write_bytes(b"x")
    files = ingest.admit(ingest.read_files(spark, str(tmp_path)))
    assert {r.path.rsplit("/", 1)[1]: r.refused for r in files.collect()} == {"a.txt": None, "b.exe": "kind is not supported"}


def test_extracted_claims_equal_the_functions(spark):
    from tessera.functions import text as T
    from tessera.operators import produce

    text = "银行应当于2026年1月1日前缴纳10万元。不得逾期；3 items"
    got = sorted((r.kind, r.value) for r in produce.extract(spark.createDataFrame([("n", text), ("m", None)], "node_id string, text string")).collect())
    want = [(k, v) for s in T.sentences(text) for k, vs in (("modal", T.modals_in(s)), ("date", [t for _, _, t in T.date_spans(s)]), ("number", [t for _, _, t in T.number_spans(s)])) for v in vs]
    assert got == sorted(want) and ("modal", "应当") in got

    def mine(frames):
        for f in frames:
            yield f[["node_id"]].assign(kind="k", value="v", quote=f["text"])

    assert produce.extract(spark.createDataFrame([("n", text)], "node_id string, text string"), mine).first().quote == text


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from tessera.sources import shared

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_replay_of_snapshots(spark):
    snap = "struct<finding_id:string,claim_type:string,statement:string,review_status:string,source_anchors:array<string>,revision_records:array<struct<by:string,at:string,why:string>>>"
    at = lambda n: f"2026-01-{10 + n}T00:00:00Z"

    def s(i, said, status, revisions, claim="fact"):
        return (i, claim, said, status, ["a"], [(f"r{k}", t, f"w{k}") for k, t in revisions])

    def audit(i, seq, before, after, time):
        return (i, seq, before, after, f"r{seq}", f"w{seq}", time)

    base, audits, actions = [], [], []
    for i in ("good", "gap", "fell", "forged", "still", "undecided", "twice", "sneaky"):
        base.append((i, s(i, "s0", "pending", [])))
    one, two = [(1, at(1))], [(1, at(1)), (2, at(1))]

    def regular(i):
        """A change of the statement, then a confirmation at the same time."""
        first, second = s(i, "s1", "modified", one), s(i, "s1", "confirmed", two)
        audits.extend([audit(i, 1, s(i, "s0", "pending", []), first, at(1)), audit(i, 2, first, second, at(1))])
        actions.append((f"{i}-d", "confirm", i, first, second, "r2", "w2", at(1)))

    for i in ("good", "twice", "gap", "undecided", "unknown"):
        regular(i)
    actions.append(actions[1])
    actions[:] = [a for a in actions if a[2] != "undecided"]
    audits.append(audit("gap", 3, s("gap", "other", "confirmed", two), s("gap", "s3", "modified", [*two, (3, at(3))]), at(3)))
    fell = [s("fell", "s1", "modified", one), s("fell", "s2", "modified", [(1, at(1)), (2, at(0))])]
    audits += [audit("fell", 1, s("fell", "s0", "pending", []), fell[0], at(1)), audit("fell", 2, fell[0], fell[1], at(0))]
    audits.append(audit("forged", 1, s("forged", "s0", "pending", []), s("forged", "s1", "modified", []), at(1)))
    audits.append(audit("still", 1, s("still", "s0", "pending", []), s("still", "s0", "pending", []), at(1)))
    audits.append(audit("sneaky", 1, s("sneaky", "s0", "pending", []), s("sneaky", "s1", "modified", one, "human_judgment"), at(1)))
    added = s("human", "said", "confirmed", [(9, at(2))], "human_judgment")
    actions.append(("human-a", "add_human", "human", None, added, "r9", "w9", at(2)))
    lone = s("good", "s1", "deleted", two)
    actions.append(("lone", "soft_delete", "good", s("good", "s1", "modified", one), lone, "r2", "w2", at(4)))
    b = spark.createDataFrame(base, f"finding_id string, snapshot {snap}")
    hashed = {"before_hash": review.snapshot_hash(F.col("before_snapshot")), "after_hash": review.snapshot_hash(F.col("after_snapshot"))}
    hashed["before_hash"] = F.when(F.col("before_snapshot").isNotNull(), hashed["before_hash"])
    log = spark.createDataFrame(audits, f"finding_id string, seq long, before_snapshot {snap}, after_snapshot {snap}, reviewer string, reason string, reviewed_at string").withColumns(hashed)
    acts = spark.createDataFrame(actions, f"action_id string, action string, finding_id string, before_snapshot {snap}, after_snapshot {snap}, reviewer string, reason string, acted_at string").withColumns(hashed)
    acts = review.action_ids(acts.withColumn("purpose", F.when(F.col("action") == "add_human", "human_review")))
    states, audited, acted = review.replay_snapshots(b, log, acts)
    got = {(r.finding_id, r.seq): r.refused for r in audited.collect() if r.refused}
    assert got == {
        ("unknown", 1): ["known_finding", "continues"],
        ("gap", 3): ["continues"],
        ("fell", 2): ["time_not_fallen"],
        ("forged", 1): ["change_allowed"],
        ("still", 1): ["something_changed", "change_allowed"],
        ("sneaky", 1): ["change_allowed"],
        ("undecided", 2): ["decided_once"],
        ("twice", 2): ["decided_once"],
    }
    wrong = sorted((r.finding_id, tuple(r.refused)) for r in acted.collect() if r.refused)
    assert wrong == [("good", ("bound_to_audit",)), ("twice", ("id_unique",)), ("twice", ("id_unique",))]
    last = {r.finding_id: r.snapshot.statement for r in states.collect()}
    assert last["good"] == "s1" and last["human"] == "said" and last["fell"] == "s2" and len(last) == 10
    tampered = acts.withColumn("reason", F.when(F.col("finding_id") == "human", "else").otherwise(F.col("reason"))).withColumn("after_hash", F.when(F.col("finding_id") == "good", "x").otherwise(F.col("after_hash")))
    wrong = {r.finding_id: r.refused for r in review.replay_snapshots(b, log, tampered)[2].where("finding_id in ('human', 'good')").collect()}
    assert wrong["human"] == ["added_properly"] and {"hashes_recomputed", "id_recomputed", "bound_to_audit"} <= set(wrong["good"])


def test_audits_without_a_decision_spread_over_tasks(spark):
    """Audits that change the statement have no decision to meet, and must not all be dealt to the task of the null key."""
    snap = "struct<finding_id:string,claim_type:string,statement:string,review_status:string,source_anchors:array<string>,revision_records:array<struct<by:string,at:string,why:string>>>"
    state = lambda said: F.struct(F.col("id").cast("string"), F.lit("fact"), F.lit(said), F.lit("modified"), F.array(F.lit("a")), F.array()).cast(snap)
    rows = spark.range(2000).select("id", state("s0").alias("before_snapshot"), state("s1").alias("after_snapshot"))
    log = rows.select(F.col("id").cast("string").alias("finding_id"), F.lit(1).cast("long").alias("seq"), "before_snapshot", "after_snapshot", F.lit("r").alias("reviewer"), F.lit("w").alias("reason"), F.lit("2026-01-01T00:00:00Z").alias("reviewed_at"), F.lit("x").alias("before_hash"), F.lit("y").alias("after_hash"))
    acts = log.where("finding_id = '7'").withColumnRenamed("reviewed_at", "acted_at").withColumns({"action_id": F.lit(""), "action": F.lit("confirm"), "purpose": F.lit("")})
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        audited = review.replay_snapshots(rows.select(F.col("id").cast("string").alias("finding_id"), F.col("before_snapshot").alias("snapshot")), log, acts)[1]
        sizes = [r["n"] for r in audited.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.size("refused"))).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 2000 and max(sizes) < 1000


def test_lines_of_many_items(spark):
    import random

    r = random.Random(8)
    items = [("s", r.choice([1, 2]), k, "w", float(r.randint(0, 500)), r.choice([r.uniform(0, 300), float(r.randint(0, 100))]), 5.0, 8.0) for k in range(2000)]
    df = spark.createDataFrame(items, "source_id string, page int, idx int, str string, x double, y double, width double, height double").repartition(3)
    want = {}
    for page in (1, 2):
        lines = []
        for i in sorted((i for i in items if i[1] == page), key=lambda i: i[2]):
            home = next((line for line in lines if abs(line[0] - i[5]) <= 2), None)
            if home is None:
                lines.append(home := [i[5], 0, i[5]])
            home[1], home[2] = home[1] + 1, min(home[2], i[5])
        for k, line in enumerate(sorted(lines, key=lambda x: -x[0])):
            want[page, k] = (line[1], line[2])
    got = {(r.page, r.line): (len(r.text.replace(" ", "")), r.y) for r in ingest.lines_of_items(df).collect()}
    assert got == want
    import time

    many = spark.range(100_000).selectExpr("'s' as source_id", "1 as page", "cast(id as int) as idx", "'w' as str", "cast(id % 7 as double) as x", "cast(hash(id) % 1000000 as double) as y", "1d as width", "1d as height")
    start = time.time()
    assert ingest.lines_of_items(many).count() > 10_000 and time.time() - start < 30


def test_merged_findings_unite_lists_in_order(spark):
    a = "array<struct<source_id:string,quote:string>>"
    rows = [
        ("f2", "fact", "c", "Said", 2, [("s", "b"), ("s", "a")], ["p2"], False, ["r2"]),
        ("f1", "fact", "c", " Said ", 1, [("s", "a"), (None, "n"), ("s", "a")], ["p1", "p2"], False, ["r1", "r1"]),
        ("f3", "fact", "c", "Ｓaid", 3, [], [], True, []),
        ("f4", "fact", "c", "else", 4, [], [], False, []),
        ("f5", None, "c", "else", 5, [("t", "q")], [], False, []),
    ]
    df = spark.createDataFrame(rows, f"finding_id string, claim_type string, category string, statement string, ord int, source_anchors {a}, inference_parents array<string>, required_review boolean, revision_records array<string>").repartition(3)
    out = merge.merge_findings(df)
    assert out.columns == df.columns
    got = {r.finding_id: r for r in out.collect()}
    assert set(got) == {"f1", "f4", "f5"}
    assert [tuple(x) for x in got["f1"].source_anchors] == [("s", "a"), (None, "n"), ("s", "b")]
    assert got["f1"].inference_parents == ["p1", "p2"] and got["f1"].required_review and got["f1"].revision_records == ["r1", "r1", "r2"]
    assert got["f4"].source_anchors == [] == got["f4"].revision_records and [tuple(x) for x in got["f5"].source_anchors] == [("t", "q")]
    assert merge.merge_findings(df.limit(0)).count() == 0


def test_strict_imports(spark):
    from pyspark.sql.types import ArrayType, StructType

    item = StructType().add("a", "long").add("b", ArrayType(StructType().add("c", "double")))
    kind = StructType().add("id", "string").add("items", ArrayType(item)).add("note", "string")
    held = [("p1", [(1, [(1.0, "x"), (2.5, "x")], "x")], None, "x"), ("p2", [], "n", "x"), ("p3", None, "n", "x")]
    rows = spark.createDataFrame(held, "id string, items array<struct<a:long,b:array<struct<c:double,token:string>>,token:string>>, note string, token string")
    told = [r.value for r in exchange.envelopes(rows, kind, name="session-backup").collect()]
    assert not [t for t in told if "token" in t or "x" in t]
    lines = [
        *told, "", "[1]", '"x"', told[0].replace('"version":1', '"version":2'), told[0].replace('"version":1,', ""), told[0].replace("session-backup", "other"),
        told[0].replace('"kind"', '"more":1,"kind"'), told[0].replace('"c":1.0', '"c":1.0,"d":2'), told[0].replace('"note":null', '"note":null,"n":1'), told[0].replace(',"note":null', ""),
        told[0].replace('"a":1', '"a":"one"'), told[0].replace('"p1"', "null"), told[1], told[0].replace("p1", "old"), told[1].replace("p2", "p4").replace(",", " , "),
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, value string").repartition(3)
    old = spark.createDataFrame([("old",)], "id string")
    good, bad = exchange.admit(df, kind, old, "id", name="session-backup")
    assert {r.ord: r.id for r in good.collect()} == {0: "p1", 1: "p2", 2: "p3", len(lines) - 1: "p4"}
    assert [r.why for r in bad.orderBy("ord").collect()] == ["not JSON", "not an object", "not an object", "another version", "another version", "another envelope", "another envelope", "another payload", "another payload", "another payload", "another payload", "another payload", "known id", "known id"]
    got = good.where("ord = 0").first()
    assert [tuple(x.b[1]) for x in got["items"]] == [(2.5,)] and good.where("ord = 2").first()["items"] is None


def test_lists_bear_with_broken_payloads(spark):
    payloads = ['{"project":{"projectName":"n","workflowStep":"s","findings":[1,2]}}', "{", "null", "{}", '{"project":[]}', '{"project":{"findings":"x","projectName":null}}', None, '{"project":{}}']
    rows = [(f"p{k}", 2, f"t{k}", p) for k, p in enumerate(payloads)] + [("p0", 1, "t99", "{"), ("p7", 3, "t0", "{")]
    got = exchange.listed(spark.createDataFrame(rows, "project_id string, revision int, updated_at string, payload string")).collect()
    assert [tuple(r) for r in got] == [("p5", "p5", "unknown", 2, "t5", 0), ("p0", "n", "s", 2, "t0", 2)]


def test_claims_are_kept_without_joining_findings_that_name_no_parent(spark):
    anchor = "struct<source_id:bigint,source_type:string,page:bigint,article:string,paragraph_index:bigint,quote:string>"
    cite = lambda *quotes: [(1, "regulatory_text", 0, None, 0, q) for q in quotes]
    rows = [
        ("a", "regulatory_fact", "x", "plain é", cite("plain é"), None),
        ("b", "regulatory_fact", "x", "不得逾期3日", cite("其一", "银行不得逾期３日。"), []),
        ("c", "regulatory_fact", "x", "不得逾期4日", cite("银行不得逾期3日。"), []),
        ("d", "human_judgment", "x", "2026-01-02", None, []),
        ("e", "ai_inference", "x", "逾期3日", cite("no"), ["b", "gone"]),
        ("f", "regulatory_fact", "x", "机构应报告", cite("机构应 报告"), []),
        ("g", "regulatory_fact", "x", None, cite("q"), []),
    ]
    f = spark.createDataFrame(rows, f"finding_id string, claim_type string, category string, statement string, source_anchors array<{anchor}>, inference_parents array<string>")
    got = {r.finding_id: (r.modal_ok, r.dates_ok, r.numbers_ok, r.alone_ok) for r in rules.claim_rules(f).collect()}
    assert got["a"] == got["b"] == got["f"] == (True, True, True, True)
    assert got["c"] == (False, False, False, True) and got["d"] == (True, True, True, True)
    assert got["e"] == (True, False, False, False) and got["g"] == (False, None, None, True)
    assert {r.finding_id: r.evidence for r in rules.evidence_texts(f).collect()}["e"] == "no\n不得逾期3日\n其一\n银行不得逾期３日。"
    sizes = [r.parent_id for r in rules.parents_of(f).where("p is not null").collect()]
    assert sizes == ["b"]


def test_pieces_and_grams_are_cut_without_counting_from_the_start(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab😀é\n") for _ in range(n)) for n in (1, 5, 63, 64, 65, 66, 70, 127, 128, 129, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{locate.BLOCK}}})"), 1)
    for n in (1, 2, 7, 22):
        got = {r.doc_id: r.p for r in df.select("doc_id", locate.pieces_of(blocks, n).alias("p")).collect()}
        assert [got[k] for k in range(len(texts))] == [[t[i : i + n] for i in range(len(t) - n + 1)] for t in texts]
    items = [(k, t[i : i + n]) for k, (t, i, n) in enumerate((rng.choice(texts[5:]), rng.randint(0, 40), rng.choice((3, 22, 23, 24, 31, 60))) for _ in range(80))]
    found = locate.passages(spark.createDataFrame(items, "item_id long, text string"), df)
    assert sorted(map(tuple, found.collect())) == sorted((k, d) for k, x in items if x for d, t in enumerate(texts) if x in t)
