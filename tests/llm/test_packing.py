import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from inkgauge.llm import packing
from inkgauge.llm.queries import op8_packing, public_tokenizer

from .util import ODD_ROWS, docs


def check(pieces, texts):
    """Exact round trip: whole tokenisation, gapless pieces, gapless sequences."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizer())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = tok.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            part = np.array(ids[at:at + p["length"]], "<u4")
            assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    return sum(p["length"] for p in pieces), len(by_seq)


def test_round_trip(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()
    total, sequences = check(op8_packing(spark, sf001).collect(), {r[0]: r[1] for r in rows})
    assert total / (sequences * 2048) > 0.97


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_the_best_subset(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 25) for _ in range(9))
    room = rng.randint(1, 60)
    sums = {0}
    for x in counts.elements():
        sums |= {s + x for s in sums}
    got = packing.fill(dict(counts), room)
    assert sum(k * v for k, v in got.items()) == max(s for s in sums if s <= room)
    assert all(v <= counts[k] for k, v in got.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(7)
    counts = Counter(rng.choice([2048, 1500, 37, rng.randint(1, 2047)]) for _ in range(5000))
    ends, used = defaultdict(int), Counter()
    for length, rows in packing.plan(dict(counts)).items():
        for (a, seq, slots, offset), b in zip(rows, [r[0] for r in rows[1:]] + [counts[length]]):
            for n in range(b - a):
                ends[seq + n // slots] += length
                used[length] += 1
    assert used == counts and max(ends.values()) <= 2048


def test_odd_rows(spark):
    rows = packing.pack(docs(spark, ODD_ROWS), public_tokenizer()).collect()
    whole = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    assert whole == Counter(i for i, _ in ODD_ROWS)
    assert all(r["doc_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(docs(spark, ODD_ROWS).limit(0), public_tokenizer()).collect() == []


def test_words_of_any_table_size_and_other_tokenizers(monkeypatch):
    """The same ids whatever stays in the table, and for a file that the word rule is not for."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    odd = ["don't", "x<|endoftext|>y", "ÉÀ,", "Ünï;:", "a1b2", "漢字。", "...", "İ", "ß!", "é", "é", "\x1c", "'s", "--", " x", "A" * 300]
    texts = [" ".join(rng.choice(odd) if rng.random() < 0.1 else rng.choice("abcdefgh") * rng.randint(1, 9) + rng.choice(["", ".", ",!"])
                      for _ in range(200)) for _ in range(30)]
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        tok = Tokenizer.from_file(str(public_tokenizers.path(name)))
        assert packing.by_words(tok) is by_words
        for limit in (20, 10_000):
            monkeypatch.setattr(packing.WordTokens.__init__, "__defaults__", (limit,))
            ids_of = packing._slice_ids(tok)
            for i in range(0, 30, 5):
                ids, until = ids_of(pa.array(texts[i:i + 5]))
                want = [tok.encode(t, add_special_tokens=False).ids for t in texts[i:i + 5]]
                assert [ids[a:b].tolist() for a, b in zip(until[:-1], until[1:])] == want


def test_hot_words_stay_when_the_table_is_thinned():
    from tokenizers import Tokenizer

    table = packing.WordTokens(Tokenizer.from_file(public_tokenizer()), limit=50)
    for k in range(20):
        table.look_up([b"hot", b"word."] + [f"rare{k}x{i}".encode() for i in range(20)], np.array([0, 1] * 30 + list(range(2, 22))))
    assert len(table) <= 71 and b"hot" in table and table[b"hot"] < 40 and b"rare0x0" not in table
