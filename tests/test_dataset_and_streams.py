"""Training-set prep, inference, streaming (DSP*, STR*)."""

import json

from pyspark.sql import functions as F

from inkgauge.plans import catalog as C
from inkgauge.plans import dataset as D
from inkgauge.plans import infer as I
from inkgauge.session import scratch_dir
from inkgauge.sources import derived
from inkgauge.streaming import incremental as INC


def test_chat_records_shape_and_split(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    recs = D.chat_records(docs, derived.image_listing(labels))
    n = labels.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id").count()
    counts = {r["split"]: r["count"] for r in recs.groupBy("split").count().collect()}
    assert counts["train"] == int(n * 0.8) and counts["train"] + counts["test"] == n
    r = recs.first()
    assert [m["role"] for m in r["messages"]] == ["user", "assistant"]
    assert r["images"][0] == f"images/{r['id']}.jpg"
    t = recs.select(D.apply_template(F.col("messages"), add_generation_prompt=True).alias("t")).first()["t"]
    assert t.startswith("<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\n")
    assert t.endswith("<|start_header_id|>assistant<|end_header_id|>\n\n")
    re = D.reprompt(recs).first()
    assert re["messages"][0]["content"].endswith("<|image|>")


def test_collate_labels(spark):
    docs = spark.createDataFrame([(0, "a bb"), (1, "ccc"), (2, "d e f g"), (3, "h"), (4, "ii jj")],
                                 "doc_id long, text string")
    ids = docs.select("doc_id", derived.token_ids(F.col("text"), D.IMAGE_ID).alias("tokens"))
    rows = {r["doc_id"]: r for r in D.collate(ids, "doc_id", "tokens").collect()}
    assert rows[0]["batch"] == 0 and rows[4]["batch"] == 1
    assert rows[0]["padded_len"] == 5 and rows[4]["padded_len"] == 3
    assert rows[1]["input_ids"] == [D.IMAGE_ID, 3, 0, 0, 0]
    assert rows[1]["labels"] == [-100, 3, -100, -100, -100]


def test_structured_parse_marks_corrupt(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    labels = spark.read.parquet(f"{sf001}/labels.parquet")
    parsed = D.explode_structured(D.parse_structured(derived.structured_json(docs, labels)))
    bad = parsed.where("corrupt").select("doc_id").distinct().collect()
    assert bad and all(r["doc_id"] % derived.CORRUPT_EVERY == 0 for r in bad)
    good = parsed.where("not corrupt").groupBy("doc_id").count().collect()
    assert all(r["count"] == 4 for r in good)


def test_structured_linked_information_is_kept(spark, sf001):
    linked = {"personal_information": {"name": "Ann", "id_no": None}, "named_entities": [{"entity": "Rome", "type": "place"}, {"entity": "Bo"}],
              "dates": [], "monetary_amounts": None, "employment_events": [{"incident": "fall", "reference_numbers": ["r1", "r2"]}, {"date": "d"}],
              "other": ["x", "y"], "metadata": None, "sentiment": "calm"}
    js = json.dumps({"ocr_text": "t", "sections": [{"section_name": "s", "fields": [
        {"field_name": "a", "value": "1"}, {"field_name": "b", "value": "2", "linked_information": linked}]}]})
    rows = D.explode_linked(D.parse_structured(spark.createDataFrame([(1, js), (2, js[:-9]), (3, None)], "doc_id long, json string"))).collect()
    assert {(r["doc_id"], r["section_pos"], r["field_pos"], r["field_name"]) for r in rows} == {(1, 0, 1, "b")}
    got = [(r["level"], r["pos"], r["name"], r["item"], r["value"]) for r in rows]
    assert len(got) == len(set(got)) == 6 + 2 * 2 + 2 * 4 + 2 + 2 + 1
    assert {x for x in got if x[4] is not None} == {
        ("personal_information", 0, "name", 0, "Ann"), ("named_entities", 0, "entity", 0, "Rome"), ("named_entities", 0, "type", 0, "place"),
        ("named_entities", 1, "entity", 0, "Bo"), ("employment_events", 0, "incident", 0, "fall"),
        ("employment_events", 0, "reference_numbers", 0, "r1"), ("employment_events", 0, "reference_numbers", 1, "r2"),
        ("employment_events", 1, "date", 0, "d"), ("other", 0, "value", 0, "x"), ("other", 1, "value", 0, "y"), ("sentiment", 0, "value", 0, "calm")}
    # every level of the fixture's answers arrives, with the tables' values
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    js = derived.structured_json(docs, spark.read.parquet(f"{sf001}/labels.parquet"), linked=True)
    rows = D.explode_linked(D.parse_structured(js)).collect()
    assert {r["level"] for r in rows} == set(D.LINKED_SCHEMA.names)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    names = {r["doc_id"]: r["value"] for r in rows if (r["level"], r["name"]) == ("personal_information", "name")}
    assert names == {i: x for i, x in source.items() if i % derived.CORRUPT_EVERY}


def test_batch_infer_isolates_errors(spark):
    def make_reader():
        def read(contents, prompt):
            if any(len(c) < 50 for c in contents):
                raise ValueError("image too small to read")
            return [prompt + bytes(c).decode() for c in contents]
        return read

    items = spark.createDataFrame([("a.jpg", b"x" * 80), ("b.jpg", b"tiny"), ("c.jpg", b"y" * 60)],
                                  "file_name string, content binary")
    out = {r["key"]: r for r in I.infer(items, make_reader, "P", key="file_name", batch_size=4).collect()}
    assert out["b.jpg"]["status"] == "error" and "too small" in out["b.jpg"]["error"]
    assert out["a.jpg"]["status"] == "success" and out["a.jpg"]["output"] == "P" + "x" * 80
    assert all(r["seconds"] >= 0 for r in out.values())


def test_incremental_second_run_adds_nothing(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").where("doc_id < 40")
    src, out, ck = (scratch_dir(spark, n) for n in ("t_in", "t_out", "t_ck"))
    sc = docs.selectExpr("concat(doc_id, '.jpg.model') file_name", "text", "doc_id")

    def drop(rest):
        sc.where(f"doc_id % 2 = {rest}").drop("doc_id").write.mode("append").json(src)

    def run():
        return INC.run_available(spark, src, INC.SIDECAR_SCHEMA, INC.clean_transform(), out, ck, fmt="json")
    drop(0)
    run()
    first = spark.read.parquet(out).count()
    p = run()
    assert spark.read.parquet(out).count() == first
    assert p.get("numInputRows", 0) == 0
    drop(1)
    run()
    assert spark.read.parquet(out).select("file_name").distinct().count() == spark.read.parquet(out).count() == 40


def test_scoring_waits_for_truth_and_survives_a_rerun(spark):
    from pyspark.sql import types as T
    src, truth, state = (scratch_dir(spark, n) for n in ("wait_src", "wait_truth", "wait_state"))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("transcription", T.StringType())])
    sidecars = lambda rows: spark.createDataFrame(rows, INC.SIDECAR_SCHEMA).write.mode("append").json(src)
    known = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").json(truth)
    job = INC.IncrementalScoring(spark, state)
    known([("0", "unrelated")])
    sidecars([("1.jpg.model", "a b"), ("2.jpg.model", "c d"), ("2.jpg.model", "c")])
    assert job.run(src, truth, schema) == {"scored": 0, "pending": 3}
    known([("2", "c d"), ("9", "never")])
    assert job.run(src, truth, schema) == {"scored": 2, "pending": 1}
    assert job.run(src, truth, schema) == {"scored": 2, "pending": 1}
    sidecars([("3.jpg.model", "x")])
    known([("1", "a b"), ("3", "x y")])
    assert job.run(src, truth, schema) == {"scored": 4, "pending": 0}
    rows = sorted(map(tuple, job.scored().collect()))
    assert rows == [("1", 1.0, 1.0), ("2", 1.0, 0.5), ("2", 1.0, 1.0), ("3", 1.0, 0.5)]
    # the last batch once more, as after a failure: nothing is added
    again = spark.createDataFrame([("3", "x")], INC.HYP_COLUMNS)
    job._settle(again, INC.RETRIES)
    assert sorted(map(tuple, job.scored().collect())) == rows and job.pending().count() == 0
