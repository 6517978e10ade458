import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadlake.llm import packing
from roadlake.llm.common import table

from .helpers import docs, saved, with_clashes


@given(st.integers(0, 9000))
def test_cuts_add_up(n):
    """All ids, no short pieces but whole documents, and little room left in the bins of a piece's length."""
    cuts = packing.class_cuts(n)
    assert sum(cuts) == n and all(0 < c <= 2048 for c in cuts)
    assert len(cuts) <= 1 or min(cuts) >= packing.LEAST
    assert sum((2048 // (2048 // c) - c) for c in cuts) <= max(2, n / packing.SLACK)


def test_pieces_are_few_and_not_short():
    cuts = [packing.class_cuts(n) for n in range(1, 4097)]
    assert sum(map(len, cuts)) / 4096 < 3.5
    assert all(min(c) >= 32 for c, n in zip(cuts, range(1, 4097)) if n >= 32)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80))
def test_word_table_equals_tokenizer(text):
    text = text.encode("utf-8", "replace").decode()
    t = packing.WordTokenizer(packing.vocabulary_path())
    assert t.encode(text) == np.array(t.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check(rows, texts, most_padding):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    want = sorted((str(d), len(tok.encode(t, add_special_tokens=False).ids) + 1) for d, t in texts)
    starts = sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0)
    assert starts == want
    ids = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= most_padding * sum(n for _, n in want) + 2048


def test_packing(spark, sf_dir, tmp_path):
    given_docs = table(spark, sf_dir, "documents").collect()
    check(packing.op2_harmonic_packing(spark, sf_dir).collect(), [(r.doc_id, r.text or "") for r in given_docs], 0.01)
    small = with_clashes(docs(spark))
    check(packing.op2_harmonic_packing(spark, saved(spark, tmp_path, documents=small)).collect(), [(r.doc_id, r.text or "") for r in small.collect()], 0.01)
    assert packing.pack(packing.pieces(docs(spark, []))).count() == 0


@pytest.mark.parametrize("lengths", [[], [2048, 2048], [1000, 900, 800, 100, 100]])
def test_first_fit(lengths):
    bins, places = packing.first_fit(lengths, 2048)
    ends = {}
    for n, b, p in zip(lengths, bins, places):
        assert p == ends.get(b, 0)
        ends[b] = p + n
    assert all(v <= 2048 for v in ends.values())
