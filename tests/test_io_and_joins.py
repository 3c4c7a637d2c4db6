"""Sources, sinks and joins (SRC*, SNK*, JOIN*)."""

import os

from pyspark.sql import functions as F

from inkgauge.operators import joins as J
from inkgauge.operators import sampling as SM
from inkgauge.plans import score as S
from inkgauge.session import scratch_dir
from inkgauge.sinks import writers as W
from inkgauge.sources import files as FS


def test_quoted_csv_roundtrip(spark):
    vals = [("1", "a\\b"), ("2", 'q"x'), ("3", "line1\nline2"), ("4", ""), ("5", "NA"), ("6", None), ("7", " pad ")]
    df = spark.createDataFrame(vals, "id string, t string")
    path = scratch_dir(spark, "csv_test")
    W.write_quoted_csv(df, path, sep="|")
    back = {r["id"]: r["t"] for r in FS.read_delimited(spark, path, sep="|").collect()}
    assert back == {"1": "a\\b", "2": 'q"x', "3": "line1\nline2", "4": None, "5": None, "6": None, "7": " pad "}


def test_merge_null_keys_and_duplicates(spark):
    left = spark.createDataFrame([(None, "l0", "a"), ("2", "l2", "b"), ("2", "l2b", "c")],
                                 "id string, transcription string, x string")
    right = spark.createDataFrame([(None, "r0", "p"), ("2", "r2", "q"), ("2", "r2b", "r")],
                                  "id string, transcription string, y string")
    m = S.merge_inputs(left, right)
    rows = m.collect()
    assert len(rows) == 1 + 4
    assert set(m.columns) == {"id", "transcription", "x", "y"}
    assert all(r["transcription"].startswith("l") for r in rows)


def test_semi_anti_and_pending(spark):
    rows = spark.createDataFrame([(" 1",), ("2",), ("3",)], "id string")
    images = spark.createDataFrame([("1.jpg",), ("3.jpg",)], "file_name string")
    assert sorted(r["id"] for r in J.with_images(rows, images).collect()) == [" 1", "3"]
    assert [r["image_file"] for r in J.missing_images(rows, images).collect()] == ["2.jpg"]
    outputs = spark.createDataFrame([("1.jpg.model",)], "file_name string")
    assert [r["image_file"] for r in J.pending(images, outputs).collect()] == ["3.jpg"]
    prompt = spark.createDataFrame([("Read it",)], "p string")
    assert J.with_prompt(rows, prompt).select("prompt").distinct().collect()[0][0] == "Read it"


def test_sidecars_and_images(spark, tmp_path):
    root = tmp_path / "imgs"
    root.mkdir()
    for name in ("a.JPG", "b.png", "c.txt", "a.JPG.model"):
        (root / name).write_bytes(b"not really an image")
    (root / "a.JPG.model").write_text("<|eot_id|>hello")
    listing = FS.list_images(spark, str(root)).collect()
    assert sorted(r["file_name"] for r in listing) == ["a.JPG", "b.png"]
    sc = FS.read_sidecars(spark, str(root), ".model").collect()
    assert [(r["file_name"], r["text"]) for r in sc] == [("a.JPG.model", "<|eot_id|>hello")]
    assert FS.load_images(spark, str(root)).count() == 0          # undecodable files dropped
    fb = FS.load_images(spark, str(root), fallback=True).collect()
    assert fb and all(not r["valid"] and r["height"] == 224 for r in fb)
    latest = FS.latest_file(FS.list_images(spark, str(root))).first()
    assert latest["path"].endswith(("a.JPG", "b.png"))


def test_prompt_default(spark, tmp_path):
    p = tmp_path / "prompt.txt"
    p.write_text("  Transcribe this.\n")
    assert FS.read_prompt(spark, str(p)).first()["prompt"] == "Transcribe this."
    assert FS.read_prompt(spark, str(tmp_path / "missing.txt"), default="fallback").first()["prompt"] == "fallback"


def test_exact_split_sizes(spark):
    df = spark.range(0, 1234).select(F.col("id").cast("string").alias("id")).repartition(7)
    out = SM.exact_split(df, "id", 0.8, 42)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": int(1234 * 0.8), "test": 1234 - int(1234 * 0.8)}
    again = SM.exact_split(df.repartition(3), "id", 0.8, 42)
    assert sorted(out.collect()) == sorted(again.collect())


def test_head_and_sample_are_deterministic(spark):
    df = spark.range(0, 500).select(F.col("id").cast("string").alias("id"))
    a = SM.sample_k(df.repartition(4), "id", 20).collect()
    b = SM.sample_k(df.repartition(9), "id", 20).collect()
    assert a == b and len(a) == 20
    assert [r["id"] for r in SM.head(df, 3, [F.col("id").cast("long")]).collect()] == ["0", "1", "2"]


def test_report_sink_order(spark):
    blocks = spark.createDataFrame([(i, f"block {i}") for i in range(1, 30)], "idx long, block string").repartition(5)
    path = scratch_dir(spark, "report_test")
    W.write_report(blocks, path, header="HEADER")
    path = path.replace("file:", "", 1)
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    text = "".join(open(os.path.join(path, f)).read() for f in files)
    assert text.splitlines() == ["HEADER"] + [f"block {i}" for i in range(1, 30)]


def test_projection_helpers(spark):
    import pytest
    from inkgauge.operators import project as PR
    df = spark.createDataFrame([("1", 0.5, "x")], "id string, score double, note string")
    with pytest.raises(ValueError):
        PR.require_columns(df, ["id", "transcription"])
    assert PR.numeric_columns(df, ["score", "note", "absent"]) == ["score"]
    p = PR.profile(df, "t").first()
    assert (p["rows"], p["columns"], p["schema"]) == (1, 3, "id:string,score:double,note:string")
    assert PR.or_empty(df.where("id = 'none'"))[1] is True


def test_chat_dataset_from_an_indented_array(spark, tmp_path):
    import json
    record = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "images": ["1.jpg"]}
    (tmp_path / "train.json").write_text(json.dumps([record, record], indent=2))
    rows = FS.read_chat_dataset(spark, {"train": str(tmp_path / "train.json")}, arrays=True).collect()
    assert [r["messages"][1]["content"] for r in rows] == ["a", "a"] and rows[0]["images"] == ["1.jpg"]


def test_plain_typed_csv_keeps_backslashes(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n\\\\x,1\ny,bad\n")
    rows = FS.read_typed(spark, str(tmp_path / "t.csv"), {"b": "bigint"}).collect()
    assert [tuple(r) for r in rows] == [("\\\\x", 1), ("y", None)]


def _csv_rows(rnd, n):
    words = ['a', 'b|c', 'line\nbreak', 'two\n\nbreaks', 'q"uo"te', '"', '\\', ' pad ', 'é漢', '', 'x' * 50, '\r\n', '","', '"\n"']
    return [(str(i), rnd.choice(words) + rnd.choice(words) + "z", "".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) + ".") for i in range(n)]


def test_large_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    import csv
    import random
    rows = _csv_rows(random.Random(2), 4000)
    (tmp_path / "in").mkdir()
    for name, part in (("a.csv", rows[:3900]), ("b.csv", rows[3900:])):
        with open(tmp_path / "in" / name, "w", newline="") as f:
            w = csv.writer(f, quoting=csv.QUOTE_ALL, lineterminator="\n")
            w.writerows([("id", "t", "u"), *part])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = spark.read.text(str(tmp_path / "in"))
        assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 15
        got = FS.read_delimited(spark, str(tmp_path / "in"), na_tokens=(), unescape_backslash=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got)) == sorted(rows)
    whole = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("emptyValue", "")
             .csv(str(tmp_path / "in")))
    assert sorted(map(tuple, whole.collect())) == sorted(rows)


def test_records_begin_in_earlier_blocks(spark, tmp_path):
    # one field with more lines than several blocks hold, then plain records; CRLF line ends; a blank line
    long = "\n".join(f"line {i}" for i in range(800))
    (tmp_path / "t.csv").write_bytes(('"id","t"\r\n"1","' + long + '"\r\n\r\n"2","b"\r\n3,plain\r\n"4","c""\nd"').encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted(map(tuple, FS.read_delimited(spark, str(tmp_path / "t.csv")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 << 20))
    assert got == [("1", long), ("2", "b"), ("3", "plain"), ("4", 'c"\nd')]


def test_tolerant_scan_counts_and_pads(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a|b|c\n1|"x|""y"|3\n1|2|3|4\n"only"\n\n"p\n|q"|2|3|"4|"\n|NA|\n')
    rows, seen = FS.read_tolerant(spark, str(tmp_path / "t.csv"), "|")
    got = sorted((tuple(r) for r in rows.collect()), key=repr)
    assert got == [("1", 'x|"y', "3"), ("only", None, None), (None, None, None)]
    assert seen.get == {"records": 5, "skipped": 2, "padded": 1}


def test_named_files_in_two_phases(spark, tmp_path):
    import pytest
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"{i}.txt", f"body {i}\né") for i in range(30)] + [("null.txt", None)], "file_name string, text string").repartition(5)
    manifest = W.write_named_files(df, out)
    assert manifest.count() == 31 and sorted(os.listdir(out)) == sorted([f"{i}.txt" for i in range(30)] + ["null.txt"])
    assert open(f"{out}/7.txt", newline="").read() == "body 7\né" and os.path.getsize(f"{out}/null.txt") == 0
    # a task that fails leaves no file, and neither do names that are no names
    broken = df.withColumn("text", F.when(F.col("file_name") == "29.txt", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    for bad in (broken, df.unionByName(df), df.withColumn("file_name", F.concat(F.lit("../"), "file_name"))):
        with pytest.raises(Exception):
            W.write_named_files(bad, str(tmp_path / "bad"))
        assert not (tmp_path / "bad").exists() or os.listdir(tmp_path / "bad") == []


def test_sidecar_errors_are_values(spark, tmp_path):
    for name, body in {"a.model": b"ok \xc3\xa9", "b.model": b"bad \xff", "c.model": b"x" * 500, "e.model": b"", "d.txt": b"no"}.items():
        (tmp_path / name).write_bytes(body)
    rows = {r["file_name"]: (r["text"], r["error"]) for r in FS.read_sidecars(spark, str(tmp_path), ".model", max_bytes=400).collect()}
    assert rows == {"a.model": ("ok é", None), "b.model": (None, "not UTF-8"), "c.model": (None, "too large: 500 bytes")}


def test_run_outcomes_are_counted_while_written(spark, tmp_path):
    from inkgauge.operators import stats
    rows = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "ok"), ("4", "odd")], "id string, status string")
    table, counts = stats.run_with_outcomes(rows, str(tmp_path / "run"), ["ok", "bad", "never"])
    assert counts == {"total": 4, "ok": 2, "bad": 1, "never": 0}
    assert [r["id"] for r in table.where("status = 'bad'").collect()] == ["2"] and table.columns == ["id", "status"]
    errors = table.where("status = 'bad'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in errors


def test_chat_json_array_parts_are_one_array(spark, tmp_path):
    import json
    recs = spark.createDataFrame([(f"{i:02}", [("user", "q"), ("assistant", f"é {i}")], [f"{i}.jpg"], "train" if i else "test") for i in range(20)],
                                 "id string, messages array<struct<role: string, content: string>>, images array<string>, split string")
    W.write_chat_json(recs.repartition(4), str(tmp_path / "j"), array=True)
    for split, n in (("train", 19), ("test", 1)):
        folder = tmp_path / "j" / f"split={split}"
        text = "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
        assert [x["messages"][1]["content"] for x in json.loads(text)] == [f"é {i}" for i in range(20 - n if n > 1 else 0, 20 if n > 1 else 1)]
        (tmp_path / f"{split}.json").write_text(text)
    assert FS.read_chat_dataset(spark, {"train": str(tmp_path / "train.json")}, arrays=True).count() == 19


def _png(width, pixels, color):
    """A PNG of 8-bit pixels (color type 2: RGB, 6: RGBA, 0: grey)."""
    import struct
    import zlib
    size = {0: 1, 2: 3, 6: 4}[color]
    rows = b"".join(b"\0" + bytes(pixels[i:i + width * size]) for i in range(0, len(pixels), width * size))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, len(pixels) // size // width, 8, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_are_rgb(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(_png(2, [255, 0, 0, 1, 2, 3], 2))
    (tmp_path / "b.PNG").write_bytes(_png(1, [7, 200], 0))
    rows = {r["path"].rsplit("/")[-1]: r for r in FS.load_images(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.png"]["data"]) == bytes([255, 0, 0, 1, 2, 3]) and rows["a.png"]["width"] == 2
    assert len(rows["b.PNG"]["data"]) == 6 and all(r["channels"] == 3 for r in rows.values())


def test_written_tables_can_be_dropped(spark):
    from inkgauge import session
    kept = session.written(spark.range(3), "keep")
    assert kept.count() == 3
    other = spark.newSession()  # the same application, so the same folder
    path = session.scratch_dir(other, "x").rsplit("/", 1)[0].replace("file:", "", 1)
    assert os.listdir(path) and spark.sparkContext.applicationId in path


def test_large_json_array_is_read_by_many_tasks(spark, tmp_path):
    import json
    import random
    from inkgauge.sources.json_arrays import array_objects
    rnd = random.Random(5)
    bits = ["}", "{", '"', "\\", "[", "]", "},{", "\n", "é漢", "text ", '"}', "\\\\"]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))
    records = [{"messages": [{"role": "user", "content": text()}, {"role": "assistant", "content": text()}], "images": [text()] * rnd.randint(0, 2)}
               for _ in range(600)]
    want = sorted(json.dumps(r, sort_keys=True) for r in records)
    for indent in (None, 1):
        for ascii_only in (True, False):
            path = tmp_path / f"a{indent}{ascii_only}.json"
            path.write_text(json.dumps(records, indent=indent, ensure_ascii=ascii_only))
            spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
            try:
                assert spark.read.option("lineSep", "}").text(str(path)).select(F.spark_partition_id().alias("p")).distinct().count() > 10
                found = [json.loads(r["element"]) for r in array_objects(spark, str(path)).collect()]
                rows = FS.read_chat_dataset(spark, {"train": str(path)}, arrays=True).collect()
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 << 20))
            assert sorted(json.dumps(r, sort_keys=True) for r in found) == want
            got = [{"messages": [m.asDict() for m in r["messages"]], "images": r["images"]} for r in rows]
            assert sorted(json.dumps(r, sort_keys=True) for r in got) == want
    for body, n in (("[]", 0), ("", 0), ('[1, "x}", {"a": {"b": [{}]}}, null]', 1), ('[{"a": 1}, {"a": ', 1)):
        (tmp_path / "small.json").write_text(body)
        assert array_objects(spark, str(tmp_path / "small.json")).count() == n
