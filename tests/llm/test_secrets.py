import hashlib
import re

import pytest

from tidewatch.llm import secrets

SCHEMA = "doc_id bigint, text string, findings string, redacted string"
KEY = hashlib.sha1(b"k").hexdigest()


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.fit(secrets.labelled_findings(spark))


def scanned(spark, forest, texts):
    rows = [(i, t, "old", "old") for i, t in enumerate(texts)]
    got = secrets.scan(spark.createDataFrame(rows, SCHEMA), forest).collect()
    return [(r.findings, r.redacted) for r in sorted(got, key=lambda r: r.doc_id)]


def candidates(text):
    """The candidates by a pattern of another make: runs of token characters, then their tails."""
    found = []
    for run in re.finditer(r"[A-Za-z0-9+/_-]+", text):
        if len(run[0]) >= 16 and any(c.isdigit() for c in run[0]):
            found.append(run[0] + re.match("={0,2}", text[run.end() :])[0])
    return found


def walk(tree, features):
    """The vote of a tree by reading its description line by line."""
    at = 0
    while not tree[at].startswith("Predict"):
        column, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", tree[at]).groups()
        if features[int(column)] <= float(bound):
            at += 1
            continue
        depth, at = 1, at + 1
        while depth:
            depth += tree[at].startswith("If")
            depth -= tree[at].startswith("Else")
            at += 1
    return float(tree[at].split(":")[1])


def test_candidates_and_votes_same_as_model(spark, forest):
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(r.text,) for r in secrets.labelled_findings(spark, 300, 5).collect()], "text string")
    measured = secrets._measured(texts).withColumn("s", F.expr(f"transform(_measured, one -> {forest.score('one.features')})"))
    for row in measured.collect():
        if "PRIVATE KEY" not in row.text:
            assert row._values == candidates(row.text)
        assert "".join(p + v for p, v in zip(row._pieces, [*row._values, ""])) == row.text
        for one, score in zip(row._measured, row.s):
            assert score == pytest.approx(sum(walk(t, one.features) for t in forest.trees) / len(forest.trees))


def test_held_out_findings(spark, forest):
    rows = secrets.scan(secrets.labelled_findings(spark, 2000, seed=77), forest).collect()
    judged = [(r.label, r.findings[0].secret) for r in rows if r.findings]
    assert len(judged) > 1900
    assert sum(bool(a) == b for a, b in judged) / len(judged) > 0.98


def test_texts(spark, forest):
    texts = [
        None, "", "nothing here", f'erti token = "{KEY}" thhantou', f'TOKEN = "{KEY.upper()}"!!', f"commit {KEY} was good",
        "call 9807915762804490 now", f'a token = "{KEY}" b password: "{KEY[:32]}" c', f"/static/{KEY}.png",
        "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY-----", f'x token = "{KEY}"' * 3 + "w " * 60_000,
    ]
    got = scanned(spark, forest, texts)
    assert got[0] == ([], None) and got[1] == ([], "") and got[2] == ([], "nothing here")
    assert got[3][1] == 'erti token = "[secret]" thhantou' and got[4][1] == 'TOKEN = "[secret]"!!'
    assert got[5][1] == texts[5] and got[6][1] == texts[6] and got[8][1] == texts[8]
    assert got[7][1] == 'a token = "[secret]" b password: "[secret]" c'
    assert got[9][1] == "[secret]"
    assert got[10][1] == 'x token = "[secret]"' * 3 + "w " * 60_000
    assert scanned(spark, forest, []) == []


def test_no_python_in_the_plan(spark, forest):
    from tests.test_plans import plan

    df = spark.createDataFrame([(1, "x", "", "")], SCHEMA)
    text = plan(secrets.scan(df, forest))
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


@pytest.fixture(scope="module")
def wide(spark):
    return secrets.fit(secrets.findings_by_rule(spark))


def test_secrets_of_every_length_and_sign(spark, wide):
    block = "-----BEGIN RSA PRIVATE KEY-----{}-----END RSA PRIVATE KEY-----"
    texts = {
        'password = "hunter2!Xy" and': 'password = "[secret]" and',
        'token = "QwErTyUiOpAsDfGhJkLz"': 'token = "[secret]"',
        "postgres://svc:Tr0ub4dor@db": "postgres://svc:[secret]@db",
        f"OAUTH2_CLIENT_SECRET={KEY}": "OAUTH2_CLIENT_SECRET=[secret]",
        block.format("\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F1E\n\nMIIabc+/=\n"): "[secret]",
        '{"private_key": "' + block.format("\\nMIIabc+/=\\n") + '\\n"}': '{"private_key": "[secret]\\n"}',
        "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2\n\nlQOYBF\n=abcd\n-----END PGP PRIVATE KEY BLOCK-----": "[secret]",
        'password = "' + "ab1!" * 50_000 + '"': 'password = "[secret]"',
    }
    harmless = [
        "the password is required and responsibilities", 'password = os.environ["DB_PASSWORD"]', 'password: "changeme"',
        "getUserAccountByOrderNumber", "http://host:8080/path/user@example.com", "thanonontioniner", 'password = ""',
    ]
    got = scanned(spark, wide, [*texts, *harmless])
    assert [redacted for _, redacted in got] == [*texts.values(), *harmless]


def test_before_is_the_text_in_front_of_the_match(spark, wide):
    [(found, _)] = scanned(spark, wide, [f"FIRST_CLIENT_ID_12345 OAUTH2_CLIENT_SECRET={KEY}=="])
    assert [f.value for f in found] == ["FIRST_CLIENT_ID_12345", KEY + "=="]
    assert found[1].before == "FIRST_CLIENT_ID_12345 OAUTH2_CLIENT_SECRET="


def test_held_out_assigned_findings(spark, wide):
    rows = secrets.scan(secrets.assigned_findings(spark, 2000, seed=77), wide).collect()
    judged = [(r.label, bool(r.findings) and r.findings[0].secret) for r in rows]
    assert all(r.findings for r in rows if r.label)
    assert sum(bool(a) == b for a, b in judged) / len(judged) > 0.95


@pytest.mark.parametrize("unit,size", [
    ("://a:b", 300_000), ("://user:pa/ss?w", 300_000), ("password=", 300_000), ("://a:b@c", 40_000), ("-----BEGIN RSA PRIVATE KEY-----", 100_000),
])
def test_hostile_texts_take_linear_time(spark, wide, unit, size):
    """The time of a quadratic pattern would be many times the limit."""
    import time

    start = time.perf_counter()
    [(_, redacted)] = scanned(spark, wide, [unit * (size // len(unit))])
    assert redacted and time.perf_counter() - start < 15


def test_passwords_with_slashes(spark, wide):
    texts = ["postgres://svc:Tr0/ub4?dor@db", "see http://a:80/x and postgres://svc:Tr0ub4:dor@db"]
    assert [r for _, r in scanned(spark, wide, texts)] == ["postgres://svc:[secret]@db", "see http://a:80/x and postgres://svc:[secret]@db"]
