"""Secret scan with corpus-wide ownership frequency.

Each text is scanned once for fixed key formats.  All candidates' value
hashes are then aggregated by distinct owner and by distinct repository: a
value that several owners hold, or that many repositories of one owner hold,
is a copied example, any other looks live.  Repositories with the same text
count as one, so a mirrored text does not make its values copied.  Formats that the base list does not have are reported only where
they look live.  No value is too long: a "mixed" run counts at any length, and
long encoded blobs are reported like keys, since their characters do not tell
them apart.  Candidates, not texts, are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, texts

# The base kinds, in their order.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")
# Further public key formats; group "v" is the secret itself.
MORE = {
    "github": re.compile(r"(?P<v>gh[pousr]_[A-Za-z0-9]{20,})"),
    "slack": re.compile(r"(?P<v>xox[abprs]-[A-Za-z0-9-]{10,})"),
    "jwt": re.compile(r"(?P<v>eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?P<v>[A-Za-z0-9+/=\s]{16,})"),
    "url": re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:(?P<v>[^\s/:@]{6,})@"),
    "mixed": re.compile(r"(?<![A-Za-z0-9+/_=-])(?P<v>(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])"
                        r"[A-Za-z0-9+/_-]{24,}={0,2})(?![A-Za-z0-9+/_=-])"),
}
KINDS = (*BASE, *MORE)
MIN_BITS = 3.5   # entropy per character of a "mixed" value
MAX_OWNERS = 1   # owners up to which a value looks live
MAX_REPOS = 3    # repositories, identical texts as one, up to which it does
LONG_RUN = re.compile(rb"[A-Za-z0-9+/_-]{24}")
HEX_RUN = re.compile(rb"[0-9a-f]{24}")


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def candidates(raw: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind number, start, end, value hash) of one text, offsets in code points."""
    low = raw.lower()
    worded = any(w in low for w in (b"passw", b"secret", b"token", b"api"))
    long_run = LONG_RUN.search(raw)
    if not (worded or long_run or b"AKIA" in raw or b"://" in raw or b"xox" in raw or b"eyJ" in raw or b"-----BEGIN" in raw
            or HEX_RUN.search(raw)):
        return []  # none of the patterns below can match
    text, out = raw.decode("utf-8", "replace"), []

    def add(kind, start, end, value):
        out.append((KINDS.index(kind), start, end, xxhash.xxh3_128_digest(value.encode())))

    if worded:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                add("assign", *m.span(), m[2])
    for kind, pattern, least in (("access", ACCESS, 20), ("hex", HEX, 24)):
        for m in pattern.finditer(text) if kind != "hex" or HEX_RUN.search(raw) else ():
            if len(m[0]) >= least:
                add(kind, *m.span(), m[0])
    for kind, pattern in MORE.items():
        if kind != "mixed" or long_run:
            for m in pattern.finditer(text):
                if kind != "mixed" or entropy(m["v"]) >= MIN_BITS:
                    add(kind, *m.span(), m["v"])
    return out


FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    for batch in slices(batches):
        found = [[dict(zip(("kind", "start", "end", "value"), c)) for c in candidates(t)] for t in texts(batch)]
        rows = range(row, row := row + len(found))
        yield pa.record_batch([pa.array(rows, pa.int64()), batch["id"], batch["owner"], batch["repo"], batch["th"], pa.array(found, FOUND)],
                              names=["row", "id", "owner", "repo", "th", "found"])


def _joined(spans):
    """kind:start:end by start, then kind as listed, then end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per input row: id, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``spans``, ``n_live`` and ``n_copied`` candidates.

    A candidate is live while at most ``max_owners`` owners and at most
    ``max_repos`` repositories hold its value, copied otherwise.

    Null or empty text has no spans.  A null owner or repository is one of
    its own; repeated rows are one repository; ties at one start go by kind,
    then end; an empty table gives no rows.  Texts are scanned whole, whatever
    their length; other columns are ignored whatever their names."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"),
                       F.col(repo_col).cast("string").alias("repo"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    found = stage(rows.mapInArrow(_scan, f"row bigint, id {id_type}, owner string, repo string, th bigint, "
                                         "found array<struct<kind:int,start:bigint,end:bigint,value:binary>>"), "secrets")
    each = found.select("row", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"),
                        "th", F.explode("found").alias("c")).select("row", "owner", "repo", "th", "c.*")
    # distinct first, so a value copied a million times is counted before it is gathered
    owners = each.select("value", "owner").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("owners"))
    # one repository stands for all with the same text: those hold the same values
    repos = (each.groupBy("value", "th").agg(F.min(F.struct("owner", "repo")).alias("place")).select("value", "place").distinct()
             .groupBy("value").agg(F.count(F.lit(1)).alias("repos")))
    judged = (each.join(owners.join(repos, "value"), "value")
              .withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)))
    by_row = judged.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "live")).alias("all"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,live:boolean>>")
    out = found.select("row", "id").join(by_row, "row", "left").withColumn("all", F.coalesce("all", none))
    count = lambda test: F.size(F.filter("all", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    base = F.filter("all", lambda s: s["kind"] < len(BASE))
    return out.select(
        F.col("id").alias(id_col),
        *[count(of_kind(k)).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.filter("all", lambda s: (s["kind"] < len(BASE)) | s["live"])).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"))
