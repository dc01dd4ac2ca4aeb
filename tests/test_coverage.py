import json

from lodestack.operators import coverage

SCHEMA = "index int, input string, answers array<string>, pred array<string>, facts array<string>"
ROWS = [
    (0, "q", ["Cats purr. Dogs bark."], ["they say cats purr. and more", "dogs bark. cats purr."], None),
    (1, "q", ["unused"], ["one"], ["one", " ", None, "two"]),
    (2, None, [""], ["x"], []),
    (3, "q", None, ["x"], None),
    (4, "q", ["a"], [], None),
]


def test_run_and_recall(spark):
    done = coverage.coverage_run(spark.createDataFrame(ROWS, SCHEMA))
    got = {r["index"]: r.ref_facts_metrics[0] for r in done.collect()}
    assert got[0].ref_facts == ["Cats purr.", "Dogs bark."] and got[0].facts_recall == [0.5, 1.0]
    assert [[(c.statement, c.attributed) for c in reply] for reply in got[0].ref_facts_cov[1]] == [[("Cats purr.", 1), ("Dogs bark.", 1)]]
    assert got[1].ref_facts == ["one", "two"] and got[1].facts_recall == [0.5] and got[2].ref_facts == [] and got[2].facts_recall == got[3].facts_recall == [1.0] and got[4].facts_recall is None
    total = coverage.coverage_recall(done).first()
    assert abs(total.recall - 100 * (0.75 * 2 + 0.5 * 2) / 4) < 1e-6 and abs(total.spread - 0.125) < 1e-9


def test_rows_with_metrics_stay(spark):
    done = coverage.coverage_run(spark.createDataFrame(ROWS, SCHEMA))

    def never():
        raise AssertionError

    again = coverage.coverage_run(done, never, never)
    assert sorted(map(str, again.select(*done.columns).collect())) == sorted(map(str, done.collect()))


def test_replies_that_cannot_be_read_are_asked_for_again(spark):
    def load():
        calls = [0]

        def answer(prompts):
            calls[0] += 1
            return ["no json" if calls[0] < 3 or "never" in p else "<think>{}</think> " + json.dumps({"facts": ["f", ""]}) for p in prompts]

        return answer

    rows = spark.createDataFrame([(0, "q", "r"), (1, "never", "r")], "index int, input string, reference string").selectExpr("*", "cast(null as array<string>) as facts").coalesce(1)
    assert {r["index"]: r.ref_facts for r in coverage.extract_facts(rows, load=load).collect()} == {0: ["f"], 1: None}
