import random
import zlib

import numpy as np
import pytest

from caseflow.llm import packing
from caseflow.llm.packing import Packing, Windows
from caseflow.llm.queries import public_vocabulary

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def ids_of(text):
    found = tokenizers.Tokenizer.from_file(public_vocabulary()).encode(text or "", add_special_tokens=False).ids
    return np.array([*found, 1], "<u4")


def check(rows, found, size):
    """Each id lies in exactly one piece; pieces lie gapless in their sequences."""
    texts, sequences = dict(rows), {}
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids, copies = ids_of(texts[doc]), sum(1 for i, _ in rows if i == doc)
        assert sum(r.length for r in own) == copies * len(ids)
        covered = np.zeros(len(ids), int)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies).all()
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= size
    return sequences


@pytest.mark.parametrize("settings", [{}, {"size": 64, "open_windows": 3, "fan_in": 2}])
def test_round_trip(docs, odd, settings):
    r = random.Random(2)
    rows = odd + [(100 + i, " ".join(r.choices(["the", "Quality", "naïve", "x9", "it's", "###"], k=r.randrange(1, 90)))) for i in range(200)]
    pack = Packing(public_vocabulary(), **settings)
    table = docs(rows).repartition(7)
    sequences = check(rows, packing.packed(table, pack).collect(), pack.size)
    total = sum(len(ids_of(t)) for _, t in rows)
    assert len(sequences) * pack.size < 1.1 * total + 4 * pack.size


def test_empty_table(docs):
    assert packing.packed(docs([]), Packing(public_vocabulary())).count() == 0


def test_encoder_equals_the_tokenizer():
    texts = [
        "", "It's we'll I'd 've 'RE don''t", "ÀÉÎõü ß×÷ªµº", "a<|endoftext|>b", "x <|startoftext|>", "1234 ½ ٣", "tab\tnew\nline\r\n\x0b\x0c\x1c\x85\u00a0\u2003end",
        "e\u0301 e\u0301 \u0301x", "ΑΣ ΑΣ. İI ı", "日本語 テキスト", "😀😀 a😀b", "!!!???...''s'", "A" * 3000, "ﬁ Ⅳ ™", "\ud7ff\ue000", "don\u2019t",
    ]
    encode, plain = packing.encoder(public_vocabulary()), tokenizers.Tokenizer.from_file(public_vocabulary())
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    r = random.Random(5)
    signs = [chr(c) for c in [*range(32, 127), *range(160, 256), 9, 10]]
    for _ in range(300):
        text = "".join(r.choices(signs, k=60))
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_windows_best_fit_and_bound():
    w = Windows(10, 2)
    for n in (6, 7, 3, 5):
        w.put([("d", 0, n)], n)
    assert [sum(p[2] for p in c) for c in w.closed] == [10, ] and len(w.fill) == 2
    assert w.room_to_fill(9) == 4 and w.room_to_fill(4) == 0
    w.put([("d", 0, 9)], 9)
    assert len(w.fill) == 2 and [sum(p[2] for p in c) for c in w.closed] == [10, 6]
