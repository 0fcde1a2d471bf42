"""Plain versions shared by the tests of this folder."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from test_exact_and_mixing import lowered, plain_mix  # noqa: F401
from test_quality_rules import plain_features, plain_model  # noqa: F401


def plain_mix_rows(rows):
    """Whole documents as often as at least half of them is served."""
    served = {}
    by_id = {r.doc_id: r for r in rows}
    out = []
    for d, n, _, _, taken in plain_mix([(r.doc_id, r.text, r.source) for r in rows]):
        served[d] = taken
        whole, part = divmod(taken, n) if n else (1, 0)
        out += [by_id[d]] * (whole + (2 * part >= n > 0 and part > 0))
    return out


def packed_rows(rows, capacity=2048):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at: at + capacity]
            out.append((r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out
