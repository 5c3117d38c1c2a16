import random
import re

import pytest
from pyspark.sql import functions as F

from atticwork.llm import secrets_forest


def made():
    turn = random.Random(2)
    mixed = lambda n: "".join(turn.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    digest = lambda: "".join(turn.choice("0123456789abcdef") for _ in range(40))
    word = lambda: turn.choice(["letter", "garden", "station", "window", "river", "paper"])
    rows, truth = [], {}
    for i in range(400):
        kind = turn.choice(["secret", "digest", "link", "words", "sample", "none"])
        value = {"secret": mixed(32), "digest": digest(), "link": mixed(24), "words": "-".join(word() for _ in range(5)), "sample": "your" + mixed(20), "none": ""}[kind]
        text = {"secret": f'api_key = "{value}"', "digest": f"commit {value}", "link": f"see https://host/{value}", "words": f"the {value} file", "sample": f"token = '{value}'", "none": "plain"}[kind]
        lead = " ".join(word() for _ in range(turn.randint(0, 8)))
        rows.append((i, f"{lead} {text} {word()}", f"src/{kind}.py" if i % 2 else None))
        truth[i] = kind
    odd = [(900, None, "p"), (901, "", "p"), (902, "ünï " * 3 + 'token = "' + "Ab3" * 12 + '" é', "p"), (903, "x" * 120_000 + " secret: " + mixed(30), "p"), (1, rows[1][1], rows[1][2])]
    return rows + odd, truth


@pytest.fixture(scope="module")
def found(spark):
    rows, truth = made()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, score int")
    return rows, truth, secrets_forest.query(docs).collect()


def test_places(found):
    rows, _, out = found
    text = {r[0]: r[1] for r in rows}
    assert out
    for r in out:
        assert text[r.doc_id][r.start : r.start + len(r.value)] == r.value
        assert 0 <= r.score <= 1 and r.is_secret == (r.score >= 0.5)


def test_all_candidates_are_found(found):
    rows, _, out = found
    got = {(r.doc_id, r.start) for r in out}
    for doc, text, _ in rows:
        for m in re.finditer(r"[A-Za-z0-9_+/=-]{20,}", text or ""):
            assert any(d == doc and m.start() <= s < m.end() for d, s in got), (doc, m.group()[:40])


def test_false_positives_go(found):
    _, truth, out = found
    judged = [r for r in out if r.doc_id in truth and r.held_out and truth[r.doc_id] in ("secret", "digest", "link", "words")]
    right = sum(r.is_secret == (truth[r.doc_id] == "secret") for r in judged)
    assert right / len(judged) > 0.95


def test_reviewed_findings_can_be_given(spark):
    rows, truth = made()
    docs = spark.createDataFrame([r for r in rows if r[0] < 400], "doc_id long, text string, source string")
    names = spark.createDataFrame([(i, float(k == "secret")) for i, k in truth.items()], "doc_id long, label double")
    ready = secrets_forest.features(secrets_forest.candidates(docs), secrets_forest.dictionary(docs))
    out = secrets_forest.scan(docs, ready.join(names, "doc_id").where("doc_id % 2 = 0")).collect()
    odd = [r for r in out if r.doc_id % 2]
    assert sum(r.is_secret == (truth[r.doc_id] == "secret") for r in odd) / len(odd) > 0.95


def test_no_python_on_the_executors(spark):
    docs = spark.createDataFrame(made()[0], "doc_id long, text string, source string")
    plan = secrets_forest.query(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_and_without_findings(spark):
    docs = spark.createDataFrame(made()[0], "doc_id long, text string, source string")
    assert secrets_forest.query(docs.where(F.lit(False))).collect() == []
    assert secrets_forest.scan(docs.where("text LIKE 'plain%'").select("doc_id", "text"), path_col=None).collect() == []


def test_whole_values_are_found(spark):
    texts = {
        'password = "Pa$$w0rd!23" # end': ("Pa$$w0rd!23", "assigned"),
        "pwd: 'a b\"c%d'": ('a b"c%d', "assigned"),
        "postgres://app:s3cr!t@db/x": ("s3cr!t", "url"),
        "redis://:p:w@h": ("p:w", "url"),
        "secret=ab1": ("ab1", "assigned"),
        "(token=x%41&y);": ("x%41&y", "assigned"),
        'token = "never closed': ("never", "assigned"),
        'auth: "Ab\\"c" z': ('Ab\\"c', "assigned"),
        "password = " + "Ab3" * 9: ("Ab3" * 9, "assigned"),
        "see " + "Ab3" * 9: ("Ab3" * 9, "long"),
        "password: ": None,
        "https://host:80/path": None,
    }
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {}
    for r in secrets_forest.candidates(docs).collect():
        got.setdefault(r.doc_id, []).append((r.value, r.rule))
        assert list(texts)[r.doc_id][r.start :].startswith(r.value)
    for i, wanted in enumerate(texts.values()):
        assert got.get(i, []) == ([wanted] if wanted else []), (i, got.get(i))


@pytest.mark.parametrize("unit", ["a", "\\\\", "a)", ")", "\\x", "é"])
def test_values_of_a_million_signs(spark, unit):
    long = unit * 1_000_000
    texts = [f'password = "{long}" x', f"token: {long} y", f"secret='{long}", f"http://u:{long}@h", f'pwd="{long}']
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.value for r in secrets_forest.candidates(docs, path_col=None).where("start < 20").collect()}
    assert got[0] == long
    assert got[1] == (long.rstrip(")") or ")") if unit != "\\\\" else long
    assert len(secrets_forest.scan(docs, path_col=None).collect()) >= 3


def test_repeated_rows_change_nothing(spark):
    rows = [(1, 'key: token = "station1window2river"', "p"), (2, "letter garden station window river paper " * 5, "p")]
    features = lambda docs: {
        (r.doc_id, r.value): r.coverage
        for r in secrets_forest.features(secrets_forest.candidates(docs), secrets_forest.dictionary(docs)).collect()
    }
    once = spark.createDataFrame(rows, "doc_id long, text string, source string")
    thrice = spark.createDataFrame(rows * 3, "doc_id long, text string, source string")
    assert features(once) == features(thrice) == {(1, "station1window2river"): 18 / 20}


def test_features_against_brute_force(spark):
    rows, _ = made()
    rows = [(i, (t or "")[:2000], s) for i, t, s in rows if i < 200]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    common = {}
    for _, text, _ in rows:
        for w in re.split("[ \t-\r]+", text.lower()):
            if re.fullmatch(r"[^\W\d_]{4,}[.,;:!?]?", w):
                w = w.rstrip(".,;:!?")
                common[w] = common.get(w, 0) + 1
    common = {w for w, n in common.items() if n >= sum(common.values()) * secrets_forest.DICTIONARY_SHARE}
    kinds = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]"}
    found = secrets_forest.features(secrets_forest.candidates(docs), secrets_forest.dictionary(docs)).collect()
    assert len(found) > 100
    for r in found:
        v, n = r.value, len(r.value)
        wanted = {
            "chars": n, "coverage": sum(len(w) for w in re.findall("[a-z]{4,}", v.lower()) if w in common) / n,
            "distinct": len(set(v)) / n, "run": max(len(m.group()) for m in re.finditer(r"(.)\1*", v)) / n,
            "hex": bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", v)), "vowels": len(re.findall("[aeiouAEIOU]", v)) / n,
            "path_depth": (r.path or "").count("/"), "assigned": r.rule != "long", "quoted": r.before[-1:] in ("'", '"') and r.after[:1] in ("'", '"'),
        }
        wanted |= {f"share_{k}": len(re.findall(p, v)) / n for k, p in kinds.items()}
        wanted |= {f"{a}_{b}": len(re.findall(f"(?<={p})(?={q})", v)) / n for a, p in kinds.items() for b, q in kinds.items()}
        for name, value in wanted.items():
            assert r[name] == pytest.approx(float(value)), (name, v)
