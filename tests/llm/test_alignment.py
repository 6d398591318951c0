"""Cross-tokenizer alignment against brute force over whole texts."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventloom.llm import alignment
from eventloom.llm.queries import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
TEXTS = [
    "plain words, here", "", None, " ", "  two  spaces ", "tab\tand\n newline \n\n end\n", "Straße naïve 日本語 text ０", "a b  c", "x\x1c y\x00z",
    "<|endoftext|> and </s> [INST] <0x0A>", "space mark ▁ here", "▁", "don't we'll  'tis", "😀😀 é", "plain words, here", "word" * 300, "1234567890 " * 40,
]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    ta, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    alphabet, names = alignment.byte_alphabet(), {i: s for s, i in ta.get_vocab().items()}
    found, count = [], collections.Counter()
    for doc_id, text in rows:
        a, b = (ta.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        ba = [bytes(alphabet[c] for c in names[i]) for i in a]
        bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            found.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (ba, bb)]
        cuts = [0, *sorted(set(ends[0]) & set(ends[1]))]
        groups = [[[x for x, e in zip(ids, es, strict=True) if low < e <= high] for ids, es in zip((a, b), ends, strict=True)] for low, high in zip(cuts, cuts[1:], strict=False)]
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        links = [(x, y) for x, e, p in zip(a, ends[0], ba, strict=True) for y, f, q in zip(b, ends[1], bb, strict=True) if max(e - len(p), f - len(q)) < min(e, f)]
        count.update(links)
        found.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest()))
    top = collections.Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(d, a, b, g, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), h) for d, a, b, g, links, h in found]


def key(row):
    return str(row)


@pytest.mark.parametrize(("block", "together"), [(12 << 20, 4096), (40, 3)])
def test_align(spark, monkeypatch, block, together):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    monkeypatch.setattr(alignment, "TOGETHER", together)
    r = random.Random(7)
    texts = TEXTS + ["".join(r.choice("ab c'\n\t é日,.▁1" if i % 9 == 0 else "ab c'\n\t é日,.1") for _ in range(r.randint(1, 60))) for i in range(60)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*x, 1, "k", "s") for x in rows], "doc_id long, text string, block long, pair string, `a.b` string").repartition(3)
    got = [tuple(x) for x in alignment.align(docs, A, B).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_align_without_cuts(spark, monkeypatch):
    """Where a piece might reach over a space, whole texts are encoded."""
    monkeypatch.setattr(alignment.Encoders, "segments", lambda self, text: [text])
    rows = [(1, "some words here"), (2, "some words here "), (3, "odd ▁")]
    enc = alignment.encoders(A, B)
    cuts, enc.cuts = enc.cuts, False
    try:
        block = alignment.Block(enc)
        for x in rows:
            block.add(*x)
        frame = block.frame(0)
    finally:
        enc.cuts = cuts
    want = brute(rows)
    assert [tuple(x) for x in frame[frame.kind == 0][["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].itertuples(index=False)] == [(*x[:5], x[7]) for x in want]


def test_align_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    got = alignment.align(spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string"), A, B).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [tuple(x) for x in got] == [(None, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]
