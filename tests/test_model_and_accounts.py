"""Model hook, baseline and account hygiene."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocspark.operators import accounts as acc
from vocspark.operators import evaluate as ev
from vocspark.operators import score as sco
from vocspark.sources import fixture as fx
from tests.conftest import SF_SMALL


def test_model_hook_equals_rule_scorer(spark):
    fb = fx.feedback(spark, SF_SMALL).select("id", "text")
    a = sco.score_rules(fb).select("id", "sentiment", "confidence").collect()
    b = sco.score_with_model(fb, sco.rule_model_loader).select("id", "sentiment", "confidence").collect()
    assert sorted(a) == sorted(b)


def test_model_sees_each_text_once_and_nothing_else(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def loader(folder=str(calls)):
        import uuid

        def predict(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [{"positive": 0.75, "negative": 0.25} for _ in texts]
        return predict

    rows = [(i, ["same text", "same  text", "other", None, f"own {i}"][i % 5], "secret") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, note string")
    for salts in (1, 4):
        out = sco.score_with_model(df, loader, salts=salts)
        got = out.collect()
        assert sorted((r.id, r.text, r.note) for r in got) == sorted(rows)
        assert all(r.sentiment == "Positive" and r.confidence == 0.75 for r in got)
        seen = sorted(x for f in calls.iterdir() for x in f.read_text().splitlines())
        assert len(seen) == len(set(seen)) == 23 and "secret" not in "".join(seen)
        for f in calls.iterdir():
            f.unlink()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas run(_digest" in plan and "note" not in plan.split("MapInPandas run(")[1].split(")")[0]


def test_model_hook_keeps_rows_without_known_labels(spark):
    def loader():
        return lambda texts: [{"weird": 1.0} for _ in texts]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    out = sco.score_with_model(df, loader).collect()
    assert len(out) == 2 and all(r.sentiment is None and r.scores is None for r in out)


def test_label_map_and_argmax_ties(spark):
    def loader():
        return lambda texts: [{"LABEL_0": 0.4, "label_2": 0.4, "neutral": 0.2} for _ in texts]
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    r = sco.score_with_model(df, loader).first()
    assert r.sentiment == "Negative" and r.confidence == 0.4
    assert r.scores == {"Negative": 0.4, "Neutral": 0.2, "Positive": 0.4}


def test_baseline_trains_and_predicts(spark):
    from vocspark.functions import labels as lb
    d = fx.feedback(spark, SF_SMALL).select("id", "text", lb.class_index("sentiment").alias("label"))
    model = ev.train_baseline(d, max_iter=20)
    pred = ev.predict_baseline(model, d)
    acc_row = ev.classification_report(pred).where(F.col("cls") == "accuracy").first()
    assert acc_row.precision > 0.9  # 24 distinct texts: the baseline separates them


def _osa(a: str, b: str) -> int:
    """Reference-style restricted edit distance, for checking only."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        d[i][0] = i
    for j in range(len(b) + 1):
        d[0][j] = j
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)][len(b)]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.text("abcm.", min_size=1, max_size=7), st.text("abcm.", min_size=1, max_size=7)),
                min_size=200, max_size=200))
def test_one_edit_apart_matches_restricted_distance(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", acc.one_edit_apart(F.col("a"), F.col("b")).alias("x")).collect()
    for r in got:
        assert r.x == (_osa(r.a, r.b) == 1), (r.a, r.b)


def test_typo_suggestions(spark):
    df = spark.createDataFrame([(1, "a@gmial.com"), (2, "a@hotmial.com"), (3, "a@mail.com"),
                                (4, " B@GMAIL.com "), (5, "not-an-email"), (6, "a@company.org")],
                               "id long, email string")
    got = {r.id: (r.suggestion, r.reason) for r in acc.check_emails(df).collect()}
    assert got[1] == ("gmail.com", "domain typo")
    assert got[2] == ("hotmail.com", "domain typo")
    assert got[3] == (None, None)          # genuine look-alike provider
    assert got[4] == (None, None)
    assert got[5] == (None, "invalid format")
    assert got[6] == (None, None)


def test_unique_accounts_keeps_earliest(spark):
    df = spark.createDataFrame([(1, "A@x.com", "2024-01-02"), (2, "a@x.com ", "2024-01-01"),
                                (3, "b@x.com", "2024-01-03")], "id long, email string, created_at string")
    got = sorted(r.id for r in acc.unique_accounts(df).collect())
    assert got == [2, 3]
