"""What a run of explanations moves and stores: texts to their chain and to their key, answers to the requests, nothing else."""

from pyspark.sql import functions as F

from checks.answer_checks import _info, closed_client, echo_client
from checks.flow_checks import linear_flow, whole_rows
from folioframe.operators import scans
from folioframe.plans import explain as PE
from folioframe.sources import sample_layout
from folioframe.sources.layout import read_layout

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanged(df):
    return [line for line in _plan(df).splitlines() if "Exchange" in line]


def test_blocks_are_made_where_their_lines_lie(spark):
    texts = [(1, "\n".join(f" Line {i} of a text. " for i in range(1300))), (2, "a\n\n b"), (3, ""), (4, None), (5, "\n \n"), (6, "\n".join("x" * 512))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.doc_id, r.span): len(r.lines) for r in sample_layout.stretches(docs).collect()} == {(1, 0): 512, (1, 1): 512, (1, 2): 276, (2, 0): 2, (6, 0): 512}
    dealt = read_layout(sample_layout.layout_blocks(scans.by_span(sample_layout.stretches(docs))))
    again = scans.by_span(dealt)
    assert len(_exchanged(again)) == 1 and not [line for line in _exchanged(again) if "block_type" in line]
    whole = read_layout(sample_layout.layout_blocks(docs))
    columns = [F.col(c).cast("string") for c in sorted(whole.columns)]
    assert sorted(dealt.select(*columns).collect()) == sorted(whole.select(*columns).collect())


def test_cards_leave_requests_where_they_lie(spark, fresh_dir, monkeypatch):
    rows, info = whole_rows(spark, SF, linear_flow(spark, SF)), _info(spark, SF).withColumn("map_json", F.lit("{}"))
    stored, held = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    settle = PE.settle
    monkeypatch.setattr(PE, "settle", lambda df, *by: stored.append(df.columns) or settle(df, *by))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = PE.prepare(rows, info)
        # Neither boxes nor prompts are stored.
        assert [c for c in stored if "texts" in c] == [["key", "doc_id", "chain", "texts", "footnotes", "map_json", "language"]]
        first = PE.explain_prepared(asked, f"{fresh_dir}/answers", echo_client, wait=False)
        assert len([c for c in stored if "texts" in c]) == 1
        second = PE.explain_prepared(asked, f"{fresh_dir}/answers", closed_client, wait=False)
        plan = _plan(second)
        assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(key" in plan
        get = lambda df: sorted((r.doc_id, r.chain, r.slot, r.item, r.quote) for r in df.collect())
        assert get(first) == get(second) == get(PE.explain(rows, info, f"{fresh_dir}/other", echo_client, wait=False))
        assert first.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_prompts_of_prepared_requests_are_those_of_requests(spark):
    rows, info = whole_rows(spark, SF, linear_flow(spark, SF)), _info(spark, SF).withColumn("map_json", F.concat(F.lit("map "), "filename"))
    note = F.struct(F.lit("a note").alias("text"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox"), F.lit("†").alias("marker"), F.lit(1.0).alias("font_scale"))
    rows = rows.withColumn("footnotes", F.when(F.col("ri") % 3 == 0, F.array(note)).otherwise(F.col("footnotes")))
    asked = PE.prepare(rows, info).select("doc_id", "chain", "key", PE._prompt(F.col("texts")).alias("prompt"))
    want = PE.requests(PE.payloads(rows), info).select("doc_id", "chain", "key", "prompt")
    assert asked.where("prompt like '%[Footnote] a note%'").count() > 0
    assert sorted(asked.collect()) == sorted(want.collect())


def test_answers_are_judged_once(spark, fresh_dir, monkeypatch):
    stored, settle = [], PE.settle
    monkeypatch.setattr(PE, "settle", lambda df: stored.append(df.columns) or settle(df))

    def client():
        body = '{"sentence_explanations": [], "paragraph_context": {"section_role": "r", "narrative": "n"}}'
        return lambda prompt: (200, body if prompt == "good" else "{", "STOP")

    requests = spark.createDataFrame([("a", "good"), ("b", "bad")], "key string, prompt string")
    got = PE.answers(requests, f"{fresh_dir}/answers", client, wait=False)
    # What is stored says which answers are good, so none is parsed again to tell.
    assert stored == [["key", "status", "body", "finish", "error"]]
    assert [r.key for r in got.collect()] == ["a"]
    assert [(r.key, r.error is not None) for r in spark.read.parquet(f"{fresh_dir}/answers_errors").collect()] == [("b", True)]
