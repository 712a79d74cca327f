import pytest

from corpusaudit.operators import leakage, literals
from corpusaudit.operators.leakage import LeakRule, TermRule
from tests.conftest import rows

RULES = [
    LeakRule("num", r"\d{4}", "HIGH", "digits", allow_in=("ok/",)),
    LeakRule("word", r"secret\w*", "MEDIUM"),
    LeakRule("only", "x", "CRITICAL", only_in=("one.md",)),
]


def test_scan(files):
    df = files(
        ("c", "a.md", "1234 5678 secretive\nnothing x\n" + "secret" + "y" * 80),
        ("c", "ok/a.md", "1234"),
        ("c", "one.md", "x"),
        ("c", "docs/a.md", "1234"),
        ("c", "a.png", "1234"),
    )
    got = rows(leakage.scan(df, RULES), "path", "line_no", "rule", "matched")
    assert got == [
        ("a.md", 1, "num", "1234"),
        ("a.md", 1, "word", "secretive"),
        ("a.md", 3, "word", "secret" + "y" * 80),
        ("one.md", 1, "only", "x"),
    ]
    found = leakage.scan(df, RULES)
    assert rows(leakage.gate(found)) == [("c", 1, 1, 2, 4, True)]
    assert sum(r.findings for r in leakage.severity_counts(found).collect()) == found.count()


def test_many_rules_in_one_pass(files):
    df = files(("c", "a", "k1 k3 k500"))
    rules = [LeakRule(f"r{i}", rf"k{i}\b", "LOW") for i in range(600)]
    assert rows(leakage.scan(df, rules), "rule") == [("r1",), ("r3",), ("r500",)]
    assert leakage.scan(df, []).collect() == [] and leakage.wrong_terms(df, []).collect() == []


def test_groups_of_rules_do_not_mix(files):
    rules = [LeakRule("a", "(x)(?<q>y)", "LOW"), LeakRule("b", r"(ab)\1", "LOW"), LeakRule("c", r"(?<q>c)\k<q>", "LOW")]
    got = rows(leakage.scan(files(("c", "p", "abab\ncc\nxy")), rules), "line_no", "rule", "matched")
    assert got == [(1, "b", "abab"), (2, "c", "cc"), (3, "a", "xy")]


def test_name_findings(spark, files):
    df = files(("r", "src/a.py", "first\nThe Billing-App of CRM"), ("r", "docs/x.md", "crm"), ("r", ".gitignore", "crm"))
    names = spark.createDataFrame([("billing-app",), ("CRM",)], "name STRING")
    assert rows(leakage.name_findings(df, names), "path", "line_no", "rule", "matched", "severity") == [
        ("src/a.py", 2, "project-name:billing-app", "billing-app", "CRITICAL"), ("src/a.py", 2, "project-name:crm", "crm", "CRITICAL"),
    ]


def test_terms(files):
    df = files(
        ("c", "a.md", "good\nrecieve and recieve Seting\n```\nrecieve\n```\nRecieve\n```\nSeting"), ("c", "b.md", "info here")
    )
    rules = [*leakage.TERM_RULES, TermRule("info", "note", in_code=True)]
    found = leakage.wrong_terms(df, rules)
    assert rows(found, "path", "line_no", "matched", "severity") == [
        ("a.md", 2, "Seting", "error"), ("a.md", 2, "recieve", "error"), ("b.md", 1, "info", "info"),
    ]
    assert rows(leakage.term_gate(found)) == [("c", 2, 1, True)]


def test_project_names(files):
    df = files(
        ("r", ".cache/facts-billing.yaml", ""), ("r", "docs/manual/crm/01.md", ""), ("r", "docs/architecture/shop.md", ""),
        ("r", "docs/architecture/index.md", ""), ("r", "docs/manual/stylesheets/a.css", ""), ("r", "docs/architecture/demo.md", ""),
        ("r", ".cache/facts-ab.yaml", ""),
    )
    assert rows(leakage.project_names(df)) == [("billing",), ("crm",), ("shop",)]


@pytest.mark.parametrize("size", [2 << 20, 20])
def test_literals_match_brute_force(spark, size):
    texts = ["alpha beta gamma delta epsilon zeta", "xxbetagammaxx", "a\nb, the quick brown fox jumps", "", "ab", "ééé ooo uuu iii aaa"]
    needles = ["beta gamma delta epsilon", "tagam", "the quick brown fox", "b", "a", "zz", "ha bet", "uick brown fox jum", "éé ooo uuu iii", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, content STRING")
    nd = spark.createDataFrame([(n,) for n in needles + needles], "needle STRING")
    got = {tuple(r) for r in literals.find_literals(df, nd, ["id"], part_bytes=size).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in needles if n in t}
    assert literals.find_literals(df, nd, ["id"], part_bytes=size).count() == len(got)


def test_many_literals_take_one_pass(spark):
    """Literals of many parts: hashes find what the automaton finds, and the texts are read once."""
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé😀 _") for _ in range(n))
    texts = [word(rng.randint(0, 300)) for _ in range(60)] + ["", None, "x" * 300_000 + "abé" + "y" * 300_000, "z" * 262_140 + "needle across" + "z" * 9]
    needles = {word(rng.randint(1, 6)) for _ in range(300)} | {t[5 : 5 + n] for t in texts[:9] if t for n in (8, 9, 20, 32, 33, 60)} | {"xabéy", "needle across"} - {""}
    df = spark.createDataFrame([("c" if i % 2 else None, i, t) for i, t in enumerate(texts)], "corpus STRING, id INT, content STRING")
    nd = spark.createDataFrame([(c, n, k) for n in needles if n for c, k in (("c", 1), (None, 2), ("c", 3))], "corpus STRING, needle STRING, k INT")
    for more in ({}, {"words": True}, {"within": ["corpus"]}):
        few, many = (literals.find_literals(df, nd, ["corpus", "id"], carry=["k"], part_bytes=size, **more) for size in (2 << 20, 3000))
        assert rows(many) == rows(few) and few.count() > 100
    short = nd.where("length(needle) <= 32")
    assert literals.find_literals(df, short, ["id"], part_bytes=3000)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_name_leaks(spark):
    df = spark.createDataFrame([(1, "The Billing-App and crmx"), (2, "none")], "id INT, content STRING")
    names = spark.createDataFrame([("billing-app",), ("CRM",)], "name STRING")
    assert rows(literals.name_leaks(df, names, ["id"]), "id", "rule") == [(1, "project-name:billing-app"), (1, "project-name:crm")]


def test_within_and_words(spark):
    texts = spark.createDataFrame([("a", "p", "the pay module"), ("b", "p", "payments")], "corpus STRING, path STRING, content STRING")
    nd = spark.createDataFrame([("a", "pay"), ("b", "pay"), ("b", "module")], "corpus STRING, needle STRING")
    keys = ["corpus", "path"]
    assert rows(literals.find_literals(texts, nd, keys, within=["corpus"])) == [("a", "p", "pay"), ("b", "p", "pay")]
    assert rows(literals.find_literals(texts, nd, keys, within=["corpus"], words=True)) == [("a", "p", "pay")]



def test_many_terms(files):
    df = files(("c", "a.md", "w3 x\nw17.y\nnone"), ("c", "b.md", "nothing"))
    rules = [TermRule(f"w{i}." if i == 17 else f"w{i} ", "z") for i in range(40)]
    assert rows(leakage.wrong_terms(df, rules), "line_no", "matched") == [(1, "w3 "), (2, "w17.")]


def test_whole_words(spark):
    texts = ["pay", "payer pay", "a.pay_", "Üpay pay.", "x pay,", "", "pay2 2pay", "(.net) x.net"]
    needles = ["pay", ".net", "pay,"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "id INT, content STRING")
    nd = spark.createDataFrame([(n,) for n in [*needles, None, ""]], "needle STRING")
    import re

    got = {tuple(r) for r in literals.find_literals(df, nd, ["id"], words=True).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in needles if re.search(rf"\b{re.escape(n)}\b", t)}


def test_one_literal_in_every_text(spark):
    """A literal that all texts contain moves nothing: the plan has no exchange of texts or keys."""
    df = spark.range(3000).selectExpr("id", "concat('the w', id % 50, ' the') AS content")
    nd = spark.createDataFrame([("the",), ("w7",), ("w",), ("none",)], "needle STRING")
    found = literals.find_literals(df, nd, ["id"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found.groupBy("needle").count()) == [("the", 3000), ("w", 3000), ("w7", 60)]


def test_time_does_not_follow_the_number_of_terms(files):
    import time

    df = files(*[("c", f"{i}.md", "\n".join(f"word{i} and more x{j}" for j in range(100))) for i in range(300)]).cache()
    spent = {}
    for n in (100, 100, 50_000):
        rules = df.sparkSession.range(n).selectExpr("concat('word', id * 7, ' ') AS wrong", "'w' AS correct", "'c' AS context", "false AS in_code")
        start = time.time()
        assert leakage.wrong_terms_of(df, rules).count() == 100 * len(range(0, min(300, 7 * n), 7))
        spent[n] = time.time() - start
    assert spent[50_000] < 5 * spent[100] + 5


@pytest.mark.parametrize("size", [2 << 20, 20])
def test_rules_of_a_table_in_parts(files, monkeypatch, size):
    """Lines that come twice, and rules with and without a regex, however the literals are looked for."""
    monkeypatch.setattr(literals, "PART_BYTES", size)
    monkeypatch.setattr(literals.find_literals, "__defaults__", (*literals.find_literals.__defaults__[:-1], size))
    df = files(("c", "a.md", "key-1 key-x\nkey-1 key-x"), ("c", "a.md", "key-1 key-x"), (None, "b.md", "key-x"))
    schema = "name STRING, literal STRING, regex STRING, severity STRING, description STRING"
    rules = df.sparkSession.createDataFrame([("num", "key-", r"key-\d+", "HIGH", "n"), ("plain", "key-x", None, "LOW", None)], schema)
    got = rows(leakage.scan_many(df, rules), "corpus", "path", "line_no", "rule", "matched")
    each = [("c", "a.md", n, *r) for n in (1, 1, 2) for r in (("num", "key-1"), ("plain", "key-x"))]
    assert got == sorted([*each, (None, "b.md", 1, "plain", "key-x")], key=str)


def test_many_rules_move_no_line(spark, files, monkeypatch):
    """Lines and what is found in them stay where they are, with more literals than one automaton has; the order of rules does not matter."""
    monkeypatch.setattr(literals.find_literals, "__defaults__", (*literals.find_literals.__defaults__[:-1], 20))
    df = files(("c", "a.md", "alpha beta\nbeta gamma-1 gamma-2"), ("c", "b.md", "Ünï beta😀" + "x" * 600_000 + "alpha"))
    schema = "name STRING, literal STRING, regex STRING, severity STRING, description STRING"
    words = ["alpha", "beta", "gamma-", "delta", "a", "😀", "x" * 32, "x" * 33]
    rules = spark.createDataFrame([(f"{w[:6]}{len(w)}-{k}", w, r, "LOW", None) for w in words for k, r in enumerate((None, r"gamma-\d|beta.?"))], schema)
    found = leakage.scan_many(df, rules)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for size in (20, 1 << 26):
        monkeypatch.setattr(literals, "HASHED_BYTES", size)
        got = leakage.scan_many(df, rules)
        first = {("a.md", 1): "beta", ("a.md", 2): "beta ", ("b.md", 1): "beta😀"}
        lines = {("a.md", 1): "alpha beta", ("a.md", 2): "beta gamma-1 gamma-2", ("b.md", 1): "beta😀" + "x" * 40 + "alpha"}
        want = [(*at, f"{w[:6]}{len(w)}-{k}", first[at] if k else w) for at, line in lines.items() for w in words if w in line for k in (0, 1)]
        assert rows(got, "path", "line_no", "rule", "matched") == sorted(want, key=str)


def test_rules_of_a_table(spark, files):
    df = files(("c", "a.md", "key-1 key-x\nnone\nKEY-2 key-33"), ("c", "docs/a.md", "key-4"), ("c", "b.md", "```\nkey-5 recieve\n```\nrecieve"))
    schema = "name STRING, literal STRING, regex STRING, severity STRING, description STRING"
    rules = spark.createDataFrame([("num", "key-", r"key-\d+", "HIGH", "n"), ("plain", "key-x", None, "LOW", None), ("two", "key-", "-x", "LOW", "x"), ("no", None, "k", "LOW", "x")], schema)
    assert rows(leakage.scan_many(df, rules), "path", "line_no", "rule", "matched") == [
        ("a.md", 1, "num", "key-1"), ("a.md", 1, "plain", "key-x"), ("a.md", 1, "two", "-x"), ("a.md", 3, "num", "key-33"), ("b.md", 2, "num", "key-5"),
    ]
    terms = spark.createDataFrame([("recieve", "receive", "typo", False), ("key-5", "k", "c", True)], "wrong STRING, correct STRING, context STRING, in_code BOOLEAN")
    assert rows(leakage.wrong_terms_of(df, terms), "path", "line_no", "matched", "expected", "severity") == [("b.md", 4, "recieve", "receive", "error")]
