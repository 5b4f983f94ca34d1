"""Ids of texts of any characters against the library's, in particular of those that Python's tables don't know."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("patchlens.llm.queries")
import public_tokenizers  # noqa: E402

from patchlens.llm import packing  # noqa: E402


def _char(r):
    c = r.choice((r.randrange(0x80), r.randrange(0x80), r.randrange(0x3000), r.randrange(0x10000), r.randrange(sys.maxunicode + 1), 0x1C8A, 0x1C89, 0xA7CB, 0x10D50))
    return " " if 0xD800 <= c < 0xE000 else chr(c)


@pytest.mark.parametrize("seed", range(4))
def test_any_characters(seed):
    r = random.Random(seed)
    texts = ["".join(_char(r) for _ in range(r.randrange(1, 14))) for _ in range(6000)]
    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids, ends = tok.ids(pa.array(texts))
    want = [e.ids for e in tok.whole.encode_batch(texts, add_special_tokens=False)]
    for text, own, all_ in zip(texts, np.split(ids, ends[:-1]), want):
        assert own.tolist() == all_, ascii(text)
