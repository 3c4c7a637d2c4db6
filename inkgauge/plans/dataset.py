"""Training-set preparation (trace E3) and report formatting.

Chat records, re-prompting, chat templates and label collation are nested
Column expressions (``struct`` / ``array`` / ``transform``); the exact
80/20 split and running indexes use the distributed rank.  Nothing here
groups more than a fixed, small number of rows (4 per collation batch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extract_response, strip_py
from ..operators.joins import with_images
from ..operators.quantiles import rank_within_groups
from ..operators.sampling import exact_split
from ..sources.derived import BOS, EOT, HDR_END, HDR_START, IMAGE_TOKEN, PROMPT

# --- fixed values that must equal the evaluated system's behaviour ---------
# Exact split: 80 % train with seed 42; labels ignore id -100; report
# blocks end with a rule of 50 '=' characters.
TRAIN_RATIO = 0.8
SPLIT_SEED = 42
IGNORE_INDEX = -100
REPORT_RULE = "=" * 50
# ---------------------------------------------------------------------------

# Ids that no token has.
PAD_ID = 0
IMAGE_ID = 999_999
BATCH_SIZE = 4

CHAT_SCHEMA = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
    T.StructField("images", T.ArrayType(T.StringType())),
])


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_records(rows: DataFrame, images: DataFrame, prompt: str = PROMPT, image_dir: str = "images",
                 ext: str = ".jpg", ratio: float = TRAIN_RATIO, seed: int = SPLIT_SEED, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """DSP1 / DSP2: (user = prompt, assistant = stripped transcription, image)
    for rows whose image exists in the listing ``images`` (``file_name``), with
    an exact seeded train/test split.  ``key`` and ``text`` name the caller's
    columns; rows without one of them are left out."""
    rows = rows.select(F.col(key).cast("string").alias("id"), F.col(text).alias("transcription"))
    rows = rows.dropna(subset=["id", "transcription"])
    rows = with_images(rows, images, "id", ext)
    recs = rows.select(
        "id",
        F.array(message("user", F.lit(prompt)), message("assistant", strip_py(F.col("transcription"))))
        .alias("messages"),
        F.array(F.concat(F.lit(image_dir + "/"), F.trim(F.col("id")), F.lit(ext))).alias("images"))
    return exact_split(recs, "id", ratio, seed)


def flatten_records(recs: DataFrame) -> DataFrame:
    m = F.col("messages")
    return recs.select("id", m[0]["role"].alias("user_role"), m[0]["content"].alias("user_content"),
                       m[1]["role"].alias("assistant_role"), m[1]["content"].alias("assistant_content"),
                       F.col("images")[0].alias("image"), "split")


def reprompt(recs: DataFrame, prompt: str = PROMPT) -> DataFrame:
    """DSP3: keep the assistant turn, replace the user turn with the prompt
    followed by the image token."""
    return recs.withColumn("messages", F.array(message("user", F.lit(prompt + IMAGE_TOKEN)),
                                               message("assistant", F.col("messages")[1]["content"])))


def template_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit(HDR_START), role, F.lit(HDR_END + "\n\n"), content, F.lit(EOT))


def apply_template(messages: Column, add_generation_prompt: bool = False) -> Column:
    """DSP4: chat template of a message list (train form; with
    ``add_generation_prompt`` the open assistant header is appended)."""
    body = F.array_join(F.transform(messages, lambda m: template_turn(m["role"], m["content"])), "")
    tail = F.lit(HDR_START + "assistant" + HDR_END + "\n\n") if add_generation_prompt else F.lit("")
    return F.concat(F.lit(BOS), body, tail)


def collate(rows: DataFrame, key: str, ids: str, batch_size: int = BATCH_SIZE, pad_id: int = PAD_ID,
            image_id: int = IMAGE_ID) -> DataFrame:
    """DSP5: consecutive batches (by ``key``) of ``batch_size`` rows; each
    sequence of token ids in the column ``ids`` padded to its batch's longest;
    labels = ids with pad and image ids -> -100.

    Only keys are ranked; the window below holds ``batch_size`` rows."""
    ranked = rank_within_groups(rows.select(key, F.col(ids).cast("array<bigint>").alias("ids")), [], [key])
    b = ranked.withColumn("batch", F.floor(F.col("_rank") / batch_size).cast("long"))
    b = b.withColumn("padded_len", F.max(F.size("ids")).over(Window.partitionBy("batch")).cast("long"))
    padded = F.concat(F.col("ids"), F.array_repeat(F.lit(pad_id).cast("long"),
                                                   (F.col("padded_len") - F.size("ids")).cast("int")))
    labels = F.transform(padded, lambda x: F.when((x == pad_id) | (x == image_id), F.lit(IGNORE_INDEX).cast("long"))
                         .otherwise(x))
    out = b.select(key, "batch", "padded_len", padded.alias("input_ids"), labels.alias("labels"))
    return out.withColumn("n_masked", F.size(F.filter("labels", lambda x: x == IGNORE_INDEX)).cast("long"))


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Structured extraction output: the prompt's JSON schema, all levels
# (unknown keys are ignored by the parser).
LINKED_SCHEMA = T.StructType([
    T.StructField("personal_information", _strings("name", "date_of_birth", "social_security_no", "employee_no", "id_no",
                                                   "rp_certificate_no")),
    T.StructField("named_entities", T.ArrayType(_strings("entity", "type"))),
    T.StructField("dates", T.ArrayType(_strings("date", "category"))),
    T.StructField("monetary_amounts", T.ArrayType(_strings("amount", "category"))),
    T.StructField("relationships", T.ArrayType(_strings("entity1", "relationship", "entity2"))),
    T.StructField("medical_information", T.ArrayType(_strings("info", "category"))),
    T.StructField("family_information", T.ArrayType(_strings("name", "relationship", "event"))),
    T.StructField("employment_history", T.ArrayType(_strings("date", "position_description", "division", "department", "location",
                                                             "rate_of_pay", "remarks"))),
    T.StructField("employment_events", T.ArrayType(T.StructType([
        *_strings("date", "location", "incident", "action_taken"),
        T.StructField("reference_numbers", T.ArrayType(T.StringType()))]))),
    T.StructField("geographical_information", T.ArrayType(T.StringType())),
    T.StructField("document_specific_information", T.ArrayType(T.StringType())),
    T.StructField("other", T.ArrayType(T.StringType())),
    T.StructField("metadata", _strings("document_type", "period", "context")),
    T.StructField("sentiment", T.StringType()),
])
STRUCTURED_SCHEMA = T.StructType([
    T.StructField("ocr_text", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("sections", T.ArrayType(T.StructType([
        T.StructField("section_name", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StructType([
            T.StructField("field_name", T.StringType()),
            T.StructField("value", T.StringType()),
            T.StructField("linked_information", LINKED_SCHEMA),
        ]))),
    ]))),
    T.StructField("_corrupt", T.StringType()),
])


def parse_structured(js: DataFrame, column: str = "json") -> DataFrame:
    """DSP8: parse model JSON permissively; malformed text lands in
    ``_corrupt`` instead of failing the job."""
    parsed = F.from_json(F.col(column), STRUCTURED_SCHEMA,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return js.select("*", parsed.alias("doc"))


def explode_structured(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections -> fields, one row per field (outer: corrupt or empty
    documents keep one row with nulls)."""
    s = parsed.select(key, F.col("doc._corrupt").isNotNull().alias("corrupt"),
                      F.explode_outer("doc.sections").alias("s"))
    f = s.select(key, "corrupt", F.col("s.section_name").alias("section_name"),
                 F.explode_outer("s.fields").alias("f"))
    return f.select(key, "corrupt", "section_name", F.col("f.field_name").alias("field_name"),
                    F.col("f.value").alias("value"))


def explode_linked(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """DSP8, below the fields: one row per value of a field's linked
    information.  ``level`` is the prompt's name of the group, ``pos`` the
    element in its list (0 where the group is no list), ``name`` the
    attribute (``value`` in lists of strings and for the sentiment) and
    ``item`` the position inside ``reference_numbers`` (else 0).

    An element's missing attributes are rows with null values; groups that are
    null or empty, and corrupt documents, give no rows."""
    def entry(level, pos, name, value, item=F.lit(0)):
        return F.struct(F.lit(level).alias("level"), pos.cast("int").alias("pos"), F.lit(name).alias("name"),
                        item.cast("int").alias("item"), value.alias("value"))

    def entries(level, struct_type, element, pos):
        out = F.array(*[entry(level, pos, f.name, element[f.name]) for f in struct_type if isinstance(f.dataType, T.StringType)])
        for f in struct_type:
            if isinstance(f.dataType, T.ArrayType):
                more = F.transform(element[f.name], lambda v, j: entry(level, pos, f.name, v, j))
                out = F.when(element[f.name].isNull(), out).otherwise(F.concat(out, more))
        return out

    def group(f):
        linked, kind = F.col("f.linked_information")[f.name], f.dataType
        if isinstance(kind, T.StringType):
            rows = F.array(entry(f.name, F.lit(0), "value", linked))
        elif isinstance(kind, T.StructType):
            rows = entries(f.name, kind, linked, F.lit(0))
        elif isinstance(kind.elementType, T.StructType):
            rows = F.flatten(F.transform(linked, lambda e, i: entries(f.name, kind.elementType, e, i)))
        else:
            rows = F.transform(linked, lambda e, i: entry(f.name, i, "value", e))
        return F.when(linked.isNotNull(), rows).otherwise(F.array().cast("array<struct<level:string,pos:int,name:string,item:int,value:string>>"))

    s = parsed.select(key, F.posexplode("doc.sections").alias("section_pos", "s"))
    f = s.select(key, "section_pos", F.col("s.section_name").alias("section_name"), F.posexplode("s.fields").alias("field_pos", "f"))
    v = f.select(key, "section_pos", "section_name", "field_pos", F.col("f.field_name").alias("field_name"),
                 F.explode(F.concat(*[group(x) for x in LINKED_SCHEMA])).alias("v"))
    return v.select(key, "section_pos", "section_name", "field_pos", "field_name", "v.*")


def report_blocks(rows: DataFrame, name: str, output: str, seconds: str, prompt: str = PROMPT) -> DataFrame:
    """SNK5 / WIN2: one text block per item in the order of ``name``, ``Image
    i/N: file``, run time, the response extracted from the model's ``output``
    and a rule; ``idx`` orders the blocks.  ``seconds`` is printed with three
    decimals."""
    ranked = rank_within_groups(rows.select(name, output, seconds), [], [name])
    block = F.concat(F.lit("Image "), (F.col("_rank") + 1).cast("string"), F.lit("/"), F.col("_n").cast("string"),
                     F.lit(": "), F.col(name).cast("string"), F.lit("\nTime: "), F.col(seconds).cast("decimal(18,3)").cast("string"),
                     F.lit("s\n"), extract_response(F.col(output), prompt), F.lit("\n" + REPORT_RULE))
    return ranked.select((F.col("_rank") + 1).alias("idx"), block.alias("block"))
