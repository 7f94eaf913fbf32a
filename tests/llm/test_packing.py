import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
CACHE = packing.PieceCache(PATH, 1000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=" \n\t 　ab'sé1!<|>", max_size=12), st.just("<|endoftext|>"), st.just("<|endof")), max_size=6).map("".join))
def test_ids_are_those_of_tokenizers(text):
    assert packing.token_ids(text, CACHE).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=7), st.integers(0, 60))
def test_fill_is_closest_subset_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    got = packing.fill(counts, room)
    assert all(k <= counts[n] for n, k in got)
    assert sum(n * k for n, k in got) == max(s for s in sums if s <= room)


def test_every_id_lies_in_one_piece(spark):
    texts = [None, "", "a b  c", "word " * 9000, "Ünï 😀 <|endoftext|>"] + [f"tok{i} " * (i * 7 % 613) for i in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x"), (None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string").repartition(3)
    got = packing.pack(docs, PATH, pool=40).collect()
    ids = {i: np.array(TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t, _ in rows}
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _, _ in rows)
    sequences, pieces = defaultdict(list), Counter()
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        sequences[r.sequence_id].append(r)
        pieces.update([(r.doc_id, r.start + k) for k in range(r.length)])
    assert all(n == (2 if doc == 2 else 1) for (doc, _), n in pieces.items())
    for rows_of in sequences.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
