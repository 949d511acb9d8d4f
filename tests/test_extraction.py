"""Models of one's own, played by functions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cellweave.plans import extraction
from cellweave.sources import cache, records, sinks


def counting():
    """Counts the digits of a part, and adds up what parts say."""
    def make():

        def call(system, prompt):
            body = prompt.split("TEXT:\n", 1)
            if len(body) == 2:
                if "boom" in body[1]:
                    raise RuntimeError("service down")
                return json.dumps({"Country": sum(c.isdigit() for c in body[1])})
            told = json.loads(prompt.split("ANSWERS:\n", 1)[1])
            assert len(told) <= 2 or len(prompt) < 2000
            return "```json\n" + json.dumps({"Country": sum(json.loads(x)["Country"] for x in told)}) + "\n```"

        return call

    return make


@pytest.mark.parametrize("most", [10, 60, 100_000])
def test_chunks_are_put_together_level_by_level(spark, most):
    texts = {"a": "1x" * 700, "b": "2", "c": "no", "d": "7" * 1001, "e": "ok " * 50 + "boom", "f": " ", "g": None}
    df = spark.createDataFrame(list(texts.items()), "key string, text string")
    got = {r.key: r for r in extraction.synthesised(df, counting(), "s", "m", size=50, most_characters=most).collect()}
    assert set(got) == set("abcde") and "service down" in got["e"].error and got["e"].answer is None
    for k in "abcd":
        assert json.loads(got[k].answer) == {"Country": sum(c.isdigit() for c in texts[k])} and got[k].error is None


def seeing():
    def make():
        seen = {}

        def call(system, instruction, images):
            key = json.loads(instruction.split("\n", 1)[1])["k"]
            seen[key] = seen.get(key, 0) + 1
            if sum(map(len, images)) > 100:
                raise RuntimeError("This model's maximum context length is exceeded")
            if key == "broken":
                raise RuntimeError("no network")
            if key == "late" and seen[key] < 3:
                return "not json"
            return json.dumps({"Age": {"verdict": " Supported ", "quote": "q"}, "Country": {"verdict": "maybe"}, "Gender": "x"})

        return call

    return make


def test_pages_are_checked_rung_by_rung(spark):
    pages = {"small": 1, "half": 10, "low": 20, "many": 500, "huge": 5000, "none": 0, "broken": 1, "late": 1}
    docs = spark.createDataFrame([(k, json.dumps({"k": k}), n) for k, n in pages.items()], "key string, record string, n int")
    asked = []

    def render(df, dpi, most):
        asked.append((dpi, most, sorted(r.key for r in df.select("key").collect())))
        size = F.lit(max(1, dpi // 15)) if dpi > 72 else F.lit(2 if most else 5)
        n = F.least("n", F.lit(most)) if most else F.col("n")
        return df.where("n > 0").select("key", F.when(F.col("key") == "huge", F.array(F.repeat(F.lit("x"), 101))).otherwise(F.array_repeat(F.repeat(F.lit("x"), size), n)).alias("images"))

    got = {r.key: r for r in extraction.verified(docs, render, seeing(), dpi=150, tries=3).collect()}
    assert [(d, m) for d, m, _ in asked] == [(150, None), (75, None), (72, None), (72, 40)] == extraction.rungs(150)
    assert asked[1][2] == ["huge", "low", "many"] and asked[3][2] == ["huge", "many"]
    assert {k: (r.state, r.rung) for k, r in got.items()} == {
        "small": ("verified", 0), "half": ("verified", 0), "low": ("verified", 1), "many": ("verified", 3), "huge": ("too_long", 3), "none": ("no_pages", 0), "broken": ("failed", 0), "late": ("verified", 0),
    }
    told = json.loads(got["late"].verdicts)
    assert told["Age"] == {"verdict": "supported", "quote": "q"} and told["Country"]["verdict"] == told["Gender"]["verdict"] == "not_in_text" and len(told) == 24
    assert extraction.rungs(72, 10) == [(72, 10), (72, 10)] and extraction.rungs(300, 99) == [(300, 99), (150, 99), (72, 99), (72, 40)]


@pytest.mark.parametrize("whole", [True, False])
def test_images_are_never_broadcast(spark, monkeypatch, whole):
    """Images may be small when compressed, or taken to be small; documents that a render leaves out have no pages."""
    plans, kept = [], extraction.cut
    monkeypatch.setattr(extraction, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    docs = spark.createDataFrame([(k, json.dumps({"k": k}), n) for k, n in (("small", 1), ("low", 20), ("none", 0))], "key string, record string, n int")

    def render(df, dpi, most):
        images = F.array_repeat(F.repeat(F.lit("x"), dpi // 15), F.col("n")).alias("images")
        return df.where("n > 0").select("key", *(["record"] if whole else []), images)

    got = {r.key: (r.state, r.rung) for r in extraction.verified(docs, render, seeing()).collect()}
    assert got == {"small": ("verified", 0), "low": ("verified", 1), "none": ("no_pages", 0)}
    assert len(plans) == 4 and "Broadcast" not in plans[0] and ("Join" in plans[0]) != whole


def test_a_second_run_does_no_work(spark, tmp_path):
    pages = spark.createDataFrame([("s1", "<p>a</p><p>b</p>"), ("s2", "no paragraph"), ("s1", "<p>a</p><p>b</p>")], "sha256 string, html string")
    blocks = lambda df: records.html_blocks(df, "sha256")
    path = str(tmp_path / "cache")
    first, made = cache.through_cache(pages, path, blocks)
    assert made == 2 and sorted((r.sha256, r.ord, r.text) for r in first.collect()) == [("s1", 0, "a"), ("s1", 1, "b")]
    more = pages.union(spark.createDataFrame([("s3", "<p>c</p>")], "sha256 string, html string"))
    again, made = cache.through_cache(more, path, blocks)
    assert made == 1 and again.count() == 3
    assert cache.through_cache(more.where("sha256 = 's2'"), path, blocks)[1] == 0
    # rows of a run that ended before its keys were written are nobody's
    spark.createDataFrame([("s1", 9, "stray", "run", "s1")], "sha256 string, ord int, text string, run string, bucket string").write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")
    assert cache.through_cache(more, path, blocks)[0].count() == 3


def test_answers_are_kept_and_failures_asked_again(spark, tmp_path):
    asked = tmp_path / "asked"

    def make():
        def call(system, prompt):
            with open(asked, "a") as f:
                f.write(prompt + "\n")
            if prompt == "bad" and asked.read_text().count("bad") == 1:
                raise RuntimeError("down")
            return '{"Country": "x"}'

        return call

    prompts = spark.createDataFrame([("good",), ("bad",), ("good",)], "prompt string")
    run = lambda: extraction.cached_answers(prompts, str(tmp_path / "c"), make, "s", "m")
    first, n = run()
    assert n == 2 and sorted((r.answer, r.error) for r in first.collect() if r.answer) == [('{"Country": "x"}', None)] and first.where("error IS NOT NULL").count() == 1
    second, n = run()
    assert n == 1 and second.where("answer IS NOT NULL").count() == 2
    third, n = run()
    assert n == 0 and third.count() == 2 and sorted(asked.read_text().split()) == ["bad", "bad", "good"]


def test_setups_and_modes(spark):
    def make():
        def call(system, prompt):
            if len(prompt) > 3000:
                raise RuntimeError("context length exceeded")
            few = "Example" in system
            return json.dumps({"Country": "few" if few else "zero", "Age": len(re.sub("^.*TEXT:\n", "", prompt, flags=re.S))})

        return call

    texts = spark.createDataFrame([("a", "x" * 100), ("b", "y" * 4000), ("c", "")], "key string, text string")
    both = extraction.run_setups("both", texts, make, "m", examples=[{"Country": "e"}], most_characters=60)
    assert set(both) == {"zero_shot", "few_shot"}
    got = {r.key: json.loads(r.record) for r in both["few_shot"].collect()}
    assert got["a"]["Country"] == got["b"]["Country"] == "few" and got["a"]["Age"] == got["b"]["Age"] == 60 and len(got) == 2
    whole = extraction.run_setups("zero", texts, make, "m", mode="whole", size=1000, fallback=True)["zero_shot"].collect()
    assert {r.key: (r.error, json.loads(r.record)["Country"]) for r in whole} == {"a": (None, "zero"), "b": (None, "zero")}
    alone = {r.key: r.error for r in extraction.run_setups("zero", texts, make, "m", mode="whole")["zero_shot"].collect()}
    assert alone["a"] is None and "context length" in alone["b"]
    assert {r.key for r in extraction.run_setups("few", texts, make, "m", mode="full_text", size=1000)["few_shot"].collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        extraction.run_setups("zero", texts, make, "m", mode="other")


def test_models_by_settings():
    local = lambda: (lambda s, p: "l")
    assert extraction.call_from({"url": " "}, local) is local and callable(extraction.call_from({"url": "http://x", "key": "k"})())
    with pytest.raises(RuntimeError):
        extraction.call_from({})


def test_staged_and_appended_lines(spark, tmp_path):
    path = str(tmp_path / "o")
    rows = spark.createDataFrame([("a", 1), ("b", None)], "pdf string, n int")
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    assert sinks.write_json_lines(rows.mapInArrow(counted, rows.schema), path, keep_old_if_empty=True) and runs.value == 2  # computed once
    assert not sinks.write_json_lines(rows.limit(0), path, keep_old_if_empty=True)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"pdf":"a","n":1}', '{"pdf":"b","n":null}']
    fails = rows.select("pdf", F.when(F.col("pdf") == "b", F.raise_error(F.lit("killed"))).otherwise(F.col("n")).alias("n"))
    with pytest.raises(Exception, match="killed"):
        sinks.write_json_lines(fails, path, keep_old_if_empty=True)
    assert spark.read.text(path).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["o"]
    assert sinks.write_json_lines(rows.where("n = 1"), path, keep_old_if_empty=True) and spark.read.text(path).count() == 1
    sinks.append_json_lines(rows, path)
    assert records.records_by_key(records.json_lines(spark, path)).count() == 2


def test_report_of_missing_values(spark, tmp_path):
    found = spark.createDataFrame([("Age", "b"), ("Age", "a"), ("X", "z")], "field string, record string")
    lines = sinks.missing_report(found, ["Country", "Age"])
    sinks.write_report(lines, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["Country: no missing values detected", "Age: missing in 2 records", "  - a", "  - b"]
