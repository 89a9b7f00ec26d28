"""Tables of rules, time lines of advisories and blocks of lines against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftlake.operators import advisories, attribution
from siftlake.operators.rule_table import compile_rules, indexed_literals, line_length, rejected_rules, required_literals, scan_rules

PATTERNS = [
    "pass(?:word|phrase)\\s*=", "api[_-]?key", "(?:token|secret){1,2}:", "\\bfrom\\b", "([", None, "x?y*", "colou?rs? of", "(?<name>abc)def", "a{3,}bcd", "(?i)HELLO", "end$", "^start",
    "[ab]cde|fgh", "[ab]cde|f", "\\Qa.b\\E", "ab\\.cd", "(?=look)ahead", "one(?:two)?three", "a+?bcd", "", "*",
]


def test_required_literals():
    want = {"pass(?:word|phrase)\\s*=": ["pass"], "(?:token|secret){1,2}:": ["secret", "token"], "x?y*": [], "[ab]cde|fgh": ["cde", "fgh"], "[ab]cde|f": [], "(?<name>abc)def": ["abcdef"], "(?i)HELLO": ["hello"],
            "ab\\.cd": ["ab.cd"], "\\Qa.b\\E": [], "one(?:two)?three": ["three"], "[x[yz]]abc": [], "(?x) a b c": [], "[\\]x[y]]abc": []}
    assert {p: required_literals(p) for p in want} == want


def test_scan_rules_equals_every_pattern_on_every_line(spark):
    r = random.Random(3)
    words = ["password =", "Passphrase=", "api_key", "APIKEY", "token:", "secrettoken:", "from", "colors of", "abcdef", "aaabcd", "hello", "the end", "start", "bcde", "fgh", "f", "a.b", "ab.cd", "lookahead", "onethree", "abcd", "é", "yy"]
    corpus = [(i, "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 6)))) for i in range(60)] + [(99, None), (100, "")]
    rules = [(f"r{i}", p, i) for i, p in enumerate(PATTERNS)] + [("twice", "api[_-]?key", 7), ("twice", "api[_-]?key", 7)]
    docs = spark.createDataFrame(corpus, "file_id long, text string")
    table = spark.createDataFrame(rules, "rule_id string, pattern string, weight int")
    broken = {x[0] for x in rules if x[1] in ("([", None, "*")}
    assert {x["rule_id"] for x in rejected_rules(table).collect()} == broken
    want = []
    for rule, p, weight in rules:
        if rule not in broken:
            # Two things that the JVM writes differently.
            own = re.compile(re.sub(r"\\Q(.*)\\E", lambda m: re.escape(m[1]), p).replace("(?<name>", "(?P<name>"), re.I | re.A)
            want += [(i, n + 1, rule, weight, m.start() + 1, m.end() + 1) for i, t in corpus if t is not None for n, line in enumerate(t.split("\n")) if (m := own.search(line))]
    for rows in (200_000, 0):
        got = scan_rules(docs, table, index_rows=rows).select("file_id", "line_no", "rule_id", "weight", "col_start", "col_end").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_literals_over_separators_and_lengths_of_lines(spark):
    want = {"the\\s+end": ["the end"], "\\bthe[ ,.]+(?:and\\s+)?end\\b": ["the and end", "the end"], "(?:the|andx)\\sof": ["andx of", "the of"], "the(?: of)+\\W": ["the of"], "the\\Wend": ["end", "the"],
            "the[^a]end": ["the"], "the[ é]end": ["the"], "pass\\s*=": ["pass "], "x(?:a|b|c){2}\\s(?=the)": []}
    assert {p: indexed_literals(p) for p in want} == {**want, "the\\Wend": ["the"]}
    assert [line_length(p) for p in ("^a[a-z]?b$", "^ab", "^a|b$", "(?m)^ab$", "^ab?c+$", "[x[yz]]abc")] == [(2, 5), (2, None), (1, None), (2, None), (2, None), (0, None)]
    r = random.Random(5)
    words, marks = ["The", "end", "and", "of", "andx", "pass", "İs", "é", "x_", "12"], [" ", "  ", ", ", "\t", ".", "=", "-", "", "\x0b", "\u00a0"]
    corpus = [(i, "\n".join("".join(r.choice(words) + r.choice(marks) for _ in range(r.randint(0, 6))) for _ in range(5))) for i in range(80)]
    patterns = [*want, "^[a-z]{2,3} .?$", "^[a-z]{2,3} .?$", "of.?$", "end[.=]?\\s?of"]
    docs = spark.createDataFrame(corpus, "file_id long, text string")
    table = spark.createDataFrame(list(enumerate(patterns)), "rule_id long, pattern string")
    truth = [(i, n + 1, k) for k, p in enumerate(patterns) for i, t in corpus for n, line in enumerate(t.split("\n")) if re.search(p, line, re.I | re.A)]
    assert sorted(map(tuple, scan_rules(docs, table).select("file_id", "line_no", "rule_id").collect())) == sorted(truth) and len({x[2] for x in truth}) > 8


def test_plan_does_not_grow_with_the_rules(spark):
    docs = spark.createDataFrame([(1, "word17 x word9999 y\nnothing")], "file_id long, text string")

    def run(n):
        found = scan_rules(docs, spark.range(n).selectExpr("id", "concat('word', id, '\\\\s[xy]') AS pattern"))
        return found, len(found._jdf.queryExecution().optimizedPlan().toString())

    (small, a), (large, b) = run(20), run(10_000)
    assert [r["id"] for r in small.collect()] == [17] and sorted(r["id"] for r in large.collect()) == [17, 9999] and abs(a - b) < 200
    assert compile_rules(spark.createDataFrame([("(",)], "pattern string")).collect()[0]["jvm"] is None
    assert scan_rules(docs, spark.createDataFrame([], "id long, pattern string")).collect() == []


def test_literals_are_told_from_the_bytes_of_many_lines(spark, monkeypatch):
    import pyarrow as pa

    from siftlake.operators import rule_table

    monkeypatch.setattr(rule_table, "_STRETCH", 5)
    r = random.Random(11)
    literals = ["the", "the end", "end", "he end of", "a.b", "xy z", "thethe", "of the end", "  x"]
    pairs = [(r.choice([x[i:i + n] for i in range(len(x) - n + 1)]), x) for x in literals for n in [3 if len(x) < 6 else 6]]
    pieces = ["the", "end", " ", "  ", "of", "a.b", "é", "\t", ",", "xy", "z", "_", "i̇", "\x00", "x"]
    lines = ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(300)] + ["", "th", "e end", "the"]
    want = [{x for x in literals if x in line or x in re.sub(r"[\x00-\x2f\x3a-\x5e\x60\x7b-\x7f]+", " ", line)} for line in lines]
    whole = rule_table._Literals(pairs).of(pa.array(["before", *lines]).slice(1))
    assert [set(x) for x in whole.to_pylist()] == want and all(len(x) == len(set(x)) for x in whole.to_pylist()) and len(set(map(frozenset, want))) > 12
    assert rule_table._in_parts(pa.array(lines), rule_table._Literals(pairs).of).to_pylist() == whole.to_pylist()
    assert rule_table._in_parts(pa.array([], pa.string()), rule_table._Literals(pairs).of).to_pylist() == []
    assert rule_table._Literals(pairs).of(pa.array([], pa.string())).to_pylist() == [] and rule_table._Literals([]).of(pa.array(["the"])).to_pylist() == [[]]
    index = spark.createDataFrame(pairs, "gram string, literal string")
    grams = rule_table._grams_of(pa.array(lines), rule_table._slot_bitmap(index)).to_pylist()
    assert all({g for g, _ in pairs if g in line} <= set(x) <= {line[i:i + n] for n in (3, 6) for i in range(len(line))} | {None} for line, x in zip(lines, grams, strict=True))
    # Lines are not multiplied by all their grams.
    docs, rules = spark.createDataFrame([(1, "the end of it")], "file_id long, text string"), spark.createDataFrame([("the end",)], "pattern string")
    for rows in (200_000, 0):
        plan = rule_table.scan_rules(docs, rules, index_rows=rows)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"regexp_extract_all\((?!literal)", plan) and plan.count("ArrowEvalPython") == 1


def test_events_decide_by_the_last_one_before_a_version(spark):
    def key(v):
        return tuple(int(x) for x in v.split(".")) + (0,) * (4 - len(v.split(".")))

    r, osv, truth = random.Random(4), [], []
    versions = [f"{a}.{b}.0" for a in range(6) for b in range(4)]
    for n in range(60):
        ranges = [[(r.choice(["introduced", "fixed", "last_affected"]), r.choice([*versions, "0"])) for _ in range(r.randint(0, 6))] for _ in range(r.randint(0, 3))]
        listed = r.sample(versions, r.randint(0, 2))
        osv.append((f"V{n}", "", None, [], ("HIGH",), [(("npm", f"P{n % 7}"), listed, [("SEMVER", [tuple(v if k == kind else None for k in ("introduced", "fixed", "last_affected")) for kind, v in x]) for x in ranges])]))
        for v in versions:
            hit = v in listed
            for x in ranges:
                before = sorted((key(w), k == "introduced", k == "last_affected", k) for k, w in x if key(w) <= key(v))
                if before and (before[-1][3] == "introduced" or before[-1][3] == "last_affected" and before[-1][0] == key(v) and _open(x, key, key(v))):
                    hit = True
            if hit:
                truth.append((f"p{n % 7}", v, f"V{n}"))
    frame = spark.createDataFrame(osv, advisories.OSV_SCHEMA)
    refs = spark.createDataFrame([("npm", f"p{k}", v) for k in range(7) for v in versions] + [("npm", "p1", None)], "ecosystem string, name string, version string")
    found = advisories.affected_references(refs, advisories.affected_ranges(frame))
    assert sorted((x["name"], x["version"], x["vuln_id"]) for x in found.collect()) == sorted(truth)


def _open(events, key, at):
    """Whether a stretch is open up to a last affected version: the event before it, other versions' or its own, opens."""
    order = sorted((key(w), {"fixed": 0, "last_affected": 1, "introduced": 2}[k]) for k, w in events)
    first = order.index((at, 1))
    return first > 0 and order[first - 1][1] == 2


def test_advisories_with_one_and_two_ranges(spark):
    text = '{"id":"A","affected":[{"package":{"ecosystem":"npm","name":"x"},"ranges":[{"events":[{"introduced":"1.0.0"},{"fixed":"1.2.0"},{"introduced":"2.0.0"},{"fixed":"2.3.0"}]},{"events":[{"introduced":"4.0.0"},{"last_affected":"4.1.0"}]}]}]}'
    osv = spark.range(1).selectExpr(f"from_json('{text}', '{advisories.OSV_SCHEMA}') AS j").select("j.*")
    refs = spark.createDataFrame([("npm", "x", v) for v in ("0.9.0", "1.0.0", "1.1.0", "1.2.0", "2.1.0", "2.3.0", "4.1.0", "4.1.1")], "ecosystem string, name string, version string")
    found = advisories.affected_references(refs, advisories.affected_ranges(osv)).collect()
    assert {r["version"]: r["fixed_version"] for r in found} == {"1.0.0": "1.2.0", "1.1.0": "1.2.0", "2.1.0": "2.3.0", "4.1.0": None}


@pytest.mark.parametrize("seed", range(2))
def test_lines_meet_the_first_region_that_covers_them(spark, seed):
    r = random.Random(seed)
    regions = [(i % 5, a := r.randint(1, 60), a + r.randint(-2, 70), r.choice(["ai", "human"]), float(i)) for i in range(60)] + [(9, 1, 10_000_000, "ai", 0.5)]
    findings = [(f, n, f"r{n}") for f in range(6) for n in range(1, 140)] + [(9, 9_999_999, "last"), (9, 10_000_001, "past"), (9, None, "none")]
    df = spark.createDataFrame(regions, "file_id long, start_line int, end_line int, source string, confidence double")
    got = attribution.attribute_findings(spark.createDataFrame(findings, "file_id long, line_no int, rule string"), df).collect()
    want = []
    for f, n, rule in findings:
        hit = min(((s, e, who, c) for g, s, e, who, c in regions if n is not None and g == f and s <= n <= e), default=(0, 0, "unknown", 0.0))
        want.append((f, n, rule, hit[2], hit[3]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_region_of_ten_million_lines_is_a_few_blocks(spark):
    blocks = attribution.covering_blocks("a", "b", 25)
    df = spark.createDataFrame([(2, 10_000_000), (1, 1), (7, 6), (5, 8)], "a long, b long").select("a", "b", blocks.alias("x"))
    for a, b, x in df.collect():
        held = sorted((y["block"] << y["level"], (y["block"] + 1 << y["level"]) - 1) for y in x)
        assert len(x) < 50 and (held[0][0], held[-1][1]) == (a, b) if b >= a else not x
        assert all(p[1] + 1 == q[0] for p, q in zip(held, held[1:], strict=False))
    assert df.select(F.max(F.size("x"))).first()[0] > 10
