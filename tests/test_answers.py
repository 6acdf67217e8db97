"""Answers of a model: strict parsing, requests that fail, and counts that do not depend on partitions."""

from pyspark.sql import functions as F

from checks.answer_checks import cached_and_open_requests, closed_client, echo_client
from folioframe import schemas
from folioframe.operators import explain as E
from folioframe.plans import explain as PE


def test_only_whole_json_objects_with_all_fields_count(spark):
    good = '{"acronyms": [{"term": "a", "definition": "b"}], "core_methodology": "c", "assumed_concepts": []}'
    bodies = [good, "{'acronyms': []}", "{}", '{"a": 1}', "[1]", good + "}", '{"acronyms": [{"term": "a"}], "core_methodology": "c", "assumed_concepts": []}', "", None]
    df = spark.createDataFrame([(i, b, "STOP") for i, b in enumerate(bodies)], "i int, body string, finish string")
    out = {r["i"]: r for r in E.parse_model_json(df, schemas.GLOBAL_MAP).collect()}
    assert out[0]["error"] is None and out[0]["parsed"]["core_methodology"] == "c"
    assert [(out[i]["error"] or "").split(" (")[0] for i in range(1, 9)] == ["Invalid JSON", "Invalid answer", "Invalid answer", "Invalid answer", "Invalid JSON", "Invalid answer", "Empty response", "Empty response"]
    assert all(out[i]["parsed"] is None for i in range(1, 9))


def test_client_errors_are_rows(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "i int, prompt string")
    out = E.score_requests(df, closed_client, wait=False).collect()
    assert all((r["status"], r["body"], r["finish"], r["attempts"]) == (None, None, "client error: RuntimeError: asked again", 1) for r in out)


def test_attempts_depend_on_the_prompt_alone(spark):
    rows = [(i, "[S0] " + "x" * (1 + i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, prompt string")
    got = [sorted((r["i"], r["attempts"], r["status"]) for r in E.score_requests(df.repartition(n), echo_client, wait=False, tasks=t).collect()) for n, t in ((1, None), (7, 3))]
    assert got[0] == got[1] == [(i, 2 if len(p) % 7 == 0 else 1, 200) for i, p in rows]


def test_only_good_answers_are_stored_and_the_others_asked_again(spark, fresh_dir):
    def half_bad_client():
        """Good for prompts that end in 0; else cut off, invalid, or refused with a body."""
        good = echo_client()

        def ask(prompt):
            status, body, finish = good(prompt)
            return {"0": (status, body, finish), "1": (status, body, "MAX_TOKENS"), "2": (status, body[:-9] if body else body, finish), "3": (400, body, finish)}[prompt[-1]]
        return ask

    asked = spark.createDataFrame([(f"k{i}", f"[S0] Some text. {'x' * (9 - len('[S0] Some text. ') % 7)}{i}") for i in range(4)], "key string, prompt string")
    store = f"{fresh_dir}/answers"
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert keys(PE.answers(asked, store, half_bad_client, wait=False)) == ["k0"] == keys(spark.read.parquet(store))
    errors = {r["key"]: r["error"] for r in spark.read.parquet(f"{store}_errors").collect()}
    assert {k: e.split(" (")[0] for k, e in errors.items()} == {"k1": "Response truncated", "k2": "Invalid JSON", "k3": "Status 400"}
    assert keys(PE.answers(asked, store, echo_client, wait=False)) == ["k0", "k1", "k2", "k3"]
    out = PE.answers(asked, store, closed_client, wait=False)
    assert keys(out) == ["k0", "k1", "k2", "k3"] and all(r["parsed"] is not None for r in out.collect())
    # What an older run stored is asked again too.
    spark.createDataFrame([("k1", "{", "STOP")], PE.ANSWER).write.parquet(f"{fresh_dir}/old")
    assert keys(PE.answers(asked.where("key = 'k1'"), f"{fresh_dir}/old", echo_client, wait=False)) == ["k1"]


def test_texts_that_share_a_key_are_told_apart(spark):
    """The hash in a key has 32 bits: "aaB" and "aba" have the same one."""
    key = lambda c: E.explain_cache_key(F.lit("f"), F.col(c), F.lit("en"))
    asked = spark.createDataFrame([("aaB",), ("aba",), ("abc",)], "text string").withColumn("key", key("text"))
    assert asked.select("key").distinct().count() == 2
    hit, todo = E.cache_lookup(asked, asked.where("text = 'aaB'"), ("text",))
    assert [r["text"] for r in hit.collect()] == ["aaB"] and sorted(r["text"] for r in todo.collect()) == ["aba", "abc"]


def test_cached_requests_compare_texts(spark, fresh_dir):
    rows = [(1, 0, "aaB"), (1, 1, "aba"), (2, 1, "aaB"), (2, 2, "abc")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{fresh_dir}/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): r["cached"] for r in cached_and_open_requests(spark, fresh_dir).collect()}
    assert got == {(1, 0): True, (1, 1): False, (2, 1): True, (2, 2): False}
