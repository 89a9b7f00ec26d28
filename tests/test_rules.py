"""Rule catalogues and the scanner."""

import pytest
from conftest import SMALL

from siftlake.operators import scan
from siftlake.operators.files import classify
from siftlake.plans.examples import EXAMPLES
from siftlake.plans.tables import planted
from siftlake.rules import FAMILIES, Family, Rule

# Rules whose match spans two lines and so can never fire on one.
TWO_LINES = {"CG_IAC_K8S_012", "CG_API_BOLA_002"}


@pytest.mark.parametrize("name", sorted(FAMILIES))
def test_every_rule_fires_on_an_example(spark, name):
    family = FAMILIES[name]
    languages = ["javascript", "javascriptreact", "python", "java", "php", "ruby", "csharp", "js", "py"]
    rows = [(f"{i}-{lang}", lang, text) for i, text in enumerate(EXAMPLES[name]) for lang in languages]
    corpus = spark.createDataFrame(rows, "file_id string, lang string, text string")
    fired = {r.rule_id for r in scan.scan(corpus, family).select("rule_id").distinct().collect()}
    assert {r.rule_id for r in family.rules} - fired - TWO_LINES == set()


@pytest.mark.parametrize("name", sorted(FAMILIES))
def test_anchors_lose_nothing(spark, name):
    corpus = planted(spark, SMALL, name).drop("source")
    columns = ["file_id", "line_no", "rule_id", "col_start", "evidence"]
    with_anchors = scan.scan(corpus, FAMILIES[name]).select(*columns)
    without = scan.scan(corpus, FAMILIES[name], prefilter=False).select(*columns)
    assert with_anchors.exceptAll(without).count() == 0
    assert without.exceptAll(with_anchors).count() == 0


def test_first_match_per_line_and_position(spark):
    corpus = spark.createDataFrame([(1, "x\n eval(a); eval(b)")], "file_id long, text string")
    rows = scan.scan(corpus, FAMILIES["cli_sast"]).collect()
    assert [(r.line_no, r.rule_id, r.col_start, r.col_end) for r in rows] == [(2, "SAST_EVAL_001", 2, 7)]


def test_accented_letters_are_not_word_characters(spark):
    corpus = spark.createDataFrame([(1, "é" + "eval(x)")], "file_id long, text string")
    assert scan.scan(corpus, FAMILIES["cli_sast"]).count() == 1


def test_secrets_are_masked(spark):
    corpus = spark.createDataFrame([(1, "AKIA" + "A" * 16)], "file_id long, text string")
    assert scan.scan(corpus, FAMILIES["secret"]).first().evidence == "AKIA***"


def test_line_guards(spark):
    rows = [(1, "// eval(x)"), (2, "eval(x)"), (3, "ignore previous instructions" + " " * 6000)]
    corpus = spark.createDataFrame(rows, "file_id long, text string")
    assert [r.file_id for r in scan.scan(corpus, FAMILIES["sast"]).collect()] == [2]
    assert scan.scan(corpus, FAMILIES["jailbreak"]).count() == 1


def test_long_lines_and_line_ends_lose_nothing(spark):
    long = "x" * 20_000 + " ignore previous instructions\r\neval(x)\r\n"
    corpus = spark.createDataFrame([(1, long)], "file_id long, text string")
    found = {(r.rule_id, r.line_no) for r in scan.scan(corpus, FAMILIES["jailbreak"], FAMILIES["cli_sast"]).collect()}
    assert {("CG_JB_010", 1), ("SAST_EVAL_001", 2)} <= found
    alone = {(r.rule_id, r.line_no, r.evidence) for r in scan.scan(corpus, FAMILIES["cli_sast"]).collect()}
    assert alone <= {(r.rule_id, r.line_no, r.evidence) for r in scan.scan(corpus, FAMILIES["jailbreak"], FAMILIES["cli_sast"]).collect()}


def test_threshold_keeps_unknown_labels_and_invented_packages(spark):
    df = spark.createDataFrame([("a", "low"), ("a", "high"), ("a", "odd"), ("hallucination", "low")], "type string, severity string")
    kept = {tuple(r) for r in scan.severity_at_least(df, "high").collect()}
    assert kept == {("a", "high"), ("a", "odd"), ("hallucination", "low")}


def test_invalid_patterns_are_left_out(spark):
    corpus = spark.createDataFrame([(1, "Todo: fix")], "file_id long, text string")
    assert [r.rule_id for r in scan.scan_patterns(corpus, ["(", "todo"]).collect()] == ["POLICY_PATTERN_2"]


def test_classify(spark):
    rows = [("a/Dockerfile", "FROM x"), ("k.yaml", "apiVersion: v1\nkind: Pod"), ("c.yml", "version: '3'\nservices:\n a: b"), ("m.PT", ""), ("CLAUDE.md", "")]
    got = {r.path: (r.framework, r.model_format, r.may_hold_prompts) for r in classify(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/Dockerfile"][0] == "dockerfile" and got["k.yaml"][0] == "kubernetes" and got["c.yml"][0] == "compose"
    assert got["m.PT"][1] == "pickle" and got["CLAUDE.md"][2]


def test_scan_reads_text_once(spark):
    plan = scan.scan(planted(spark, SMALL, "secret"), FAMILIES["secret"], FAMILIES["api"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_flags_of_many_families_lose_nothing_and_read_a_line_once(spark):
    """Anchors and shapes are looked up in lines by Arrow; no text is searched for one anchor after another."""
    wallet, tags = "1" + "BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN", "\U000E0041\U000E0042"
    corpus = spark.createDataFrame(
        [(1, f"pay {wallet} now\nTOKEN61 x\r\ntoken3 -K\n{tags}"), (2, None), (3, ""), (4, "4" + "A" * 94 + "\nbc1" + "q" * 20)], "file_id long, text string")
    many = [Family(f"f{i}", (Rule(f"R{i}", "high", "c", rf"(?i)\btoken{i}\b|\$\({i};", "t", (f"token{i}", f"$({i};")),)) for i in range(70)]
    families = [*many, Family("bare", (Rule("B", "low", "c", "^x?$", "t"),)), FAMILIES["cryptojack"], FAMILIES["jailbreak"]]
    found, want = (scan.scan(corpus, *families, prefilter=p).select("file_id", "line_no", "rule_id", "col_start", "evidence") for p in (True, False))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert {"R61", "R3", "B", "CG_CJACK_002", "CG_CJACK_003", "CG_JB_052"} <= {r["rule_id"] for r in found.collect()}
    below = found._jdf.queryExecution().optimizedPlan().toString().split("posexplode(")[-1].lower()
    assert "contains(" not in below and "rlike" not in below
