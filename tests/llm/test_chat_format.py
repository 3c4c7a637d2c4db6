import hashlib

from inkgauge.llm import chat_format as C
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType()),
                      # names that the operator uses inside
                      *[T.StructField(c, T.StringType()) for c in ("conv", "block", "parts", "flat", "out", "tag", "nth", "first", "t", "b")]])


def turns(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], TURNS).repartition(3)


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, own in convs.items():
        own.sort()
        lines = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        loss = "".join(t for _, _, r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(own), sha(lines), len(loss), sha(loss)))
    return sorted(out, key=repr)


ODD = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "tie b"), (1, 1, "assistant", "tie a"), (1, 1, "assistant", "tie a"),
       (2, None, None, "no turn"), (2, -5, "user", "before"), (2, 0, "as>sist\\g<turn x>", "\\l\\s <image 0> </turn>\n<turn user>"),
       (None, 0, "user", "a"), (None, 1, "assistant", "b \U0001f642 é\n"), (3, 7, "assistant", "</turn>\n" * 300),
       (4, 0, "assistant", "long \\ " * 200_000), (5, 0, "system", ""), (-7, 0, "user", C.EXTRA_TEXT), (-7, 1, "assistant", C.EXTRA_TEXT),
       (6, 2**40, "assistant", "far"), (6, -2**40, "user", "first"), (6, 3, "assistant", "<turn assistant>\\")]


def test_odd_rows_read_back(spark):
    got = C.digests(C.format_chats(turns(spark, ODD))).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(ODD)
    assert C.digests(C.format_chats(turns(spark, ODD).limit(0))).count() == 0


def test_hot_conversation_is_spread_over_blocks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"{i} <turn user> \\") for i in range(2000)] + [(2, 0, "user", "x")]
    blocks = C.format_chats(turns(spark, rows))
    assert max(r["n_turns"] for r in blocks.collect()) == C.BLOCK_TURNS
    assert sorted((tuple(r)[:5] for r in C.digests(blocks).collect()), key=repr) == brute(rows)


def part(**kw):
    return tuple(kw.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages"))


def test_typed_parts(spark):
    rows = [(1, 0, "user", None, [part(type="text", text="see <image 1> \\"), part(type="image", ref="a.png", width=29, height=14),
                                 part(type="audio", ref="b.wav", seconds=1.01), part(type="document", ref="c.pdf", pages=3)]),
            (1, 1, "assistant", None, [part(type="text", text="one "), part(type="image", ref=None), part(type="text", text="two"),
                                      part(type=None, text="!"), part(type="video", text="?", ref="lost")]),
            (1, 2, "assistant", "plain", None), (2, 0, "assistant", "unused", [])]
    kind = "conv_id long, turn long, role string, text string, content " + C.PART
    out = {r["conv_id"]: r for r in C.format_chats(spark.createDataFrame(rows, kind), parts_col="content").collect()}
    one = out[1]
    assert one["formatted"] == ("<turn user>see \\limage 1> \\s<image 1><audio 2><document 3></turn>\n"
                                "<turn assistant>one <image 1>two!?</turn>\n<turn assistant>plain</turn>\n")
    assert [one["formatted"][s:e] for s, e in one["loss_spans"]] == ["one ", "two", "!", "?", "plain"]
    found = [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]]
    assert found == [(0, 1, "image", "a.png", 3), (0, 2, "audio", "b.wav", 26), (0, 3, "document", "c.pdf", 1536), (1, 1, "image", None, 0)]
    for a in one["attachments"]:
        assert one["formatted"][a["start"]:].startswith(f"<{a['type']} {a['part']}>")
    assert one["attachment_tokens"] == 3 + 26 + 1536 and out[2]["formatted"] == "<turn assistant></turn>\n"
    assert out[2]["loss_spans"] == [] and out[2]["attachment_tokens"] == 0


def test_escape_is_undone_and_hides_control_strings(spark):
    texts = ["", "\\", "\\l", "\\s\\l\\\\", "</turn>\n", "<turn ", "< turn <imagex <<audio", "<\\image", "\\<document 3>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e")).withColumn("back", C.unescape(F.col("e")))
    for r in rows.collect():
        assert r["back"] == r["t"] and not any(x in r["e"] for x in ("<turn", "</turn", "<image", "<audio", "<document"))


def test_plan_has_no_python(spark):
    plan = C.digests(C.format_chats(C.with_extra(spark, spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))))
    text = plan._jdf.queryExecution().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas"))
