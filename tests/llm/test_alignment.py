"""Alignment of two tokenizers against brute force over the libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glucospan.llm import alignment
from glucospan.llm.queries import BYTE_LEVEL, PIECES


def texts():
    draw = random.Random(8)
    made = ["".join(draw.choice("abeth  ing.12é漢🙂'sT\n") for _ in range(draw.randint(1, 90))) for _ in range(80)]
    fixed = [None, "", " ", "trail ", "x  y", "a▁b", "<s> <|endoftext|> <0x41>", "the " * 9000, "internationalisation" * 40, "日本語"]
    return [*fixed, *made, *made[:9]]


def tokens(text):
    """(ids, byte offsets of their ends) of both sides by the libraries, or nothing."""
    if not text:
        return None
    known = Tokenizer.from_file(BYTE_LEVEL)
    known.encode_special_tokens = True
    sides = []
    names = alignment.byte_names()
    back = {c: b for b, c in names.items()}
    a = known.encode(" " + text, add_special_tokens=False)
    sides.append((a.ids, [bytes(back[c] for c in t) for t in a.tokens]))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    b = model.encode(text)
    sides.append((b, [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]))
    if any(b"".join(p) != (" " + text).encode() for _, p in sides):
        return None
    return [(ids, np.cumsum([len(p) for p in pieces]).tolist()) for ids, pieces in sides]


def brute(text):
    """Groups as text, and links as pairs of ids."""
    sides = tokens(text)
    if sides is None:
        return 0, 0, "", []
    (a, a_end), (b, b_end) = sides
    parts, i, j = [], 0, 0
    places = {e: k for k, e in enumerate(b_end)}
    for k, end in enumerate(a_end):
        if end in places:
            parts.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : places[end] + 1])))
            i, j = k + 1, places[end] + 1
    links, low = [], 0
    for x, end in enumerate(a_end):
        start = a_end[x - 1] if x else 0
        while b_end[low] <= start:
            low += 1
        y = low
        while y < len(b) and (b_end[y - 1] if y else 0) < end:
            links.append((a[x], b[y]))
            y += 1
    return len(a), len(b), ";".join(parts), links


@pytest.mark.parametrize("chunk", [300, 4 << 20])
def test_links_are_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    data = texts()
    rows = [*enumerate(data), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("x")).withColumn("n_a", F.lit(-1))
    got = {r.doc_id: r for r in alignment.linked(df.repartition(3), BYTE_LEVEL, PIECES).collect()}
    assert len(got) == len(rows)
    want = {i: brute(t) for i, t in rows}
    count = Counter(pair for *_, links in want.values() for pair in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for i, (n_a, n_b, spelled, links) in want.items():
        r = got[i]
        digest = hashlib.sha256(spelled.encode()).hexdigest() if spelled else ""
        assert (r.n_a, r.n_b, r.groups_sha256, r.n_links) == (n_a, n_b, digest, len(links))
        assert r.n_groups == (spelled.count(";") + 1 if spelled else 0)
        assert r.count_sum == sum(count[p] for p in links)
        assert r.n_best == sum(count[p] == most[p[1]] for p in links)


def test_groups(spark):
    rows = alignment.groups(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string"), BYTE_LEVEL, PIECES).collect()
    for r in rows:
        text = texts()[r.doc_id]
        assert ";".join(f"{','.join(map(str, g.a))}|{','.join(map(str, g.b))}" for g in r.groups) == brute(text)[2]
        assert not r.groups or r.groups[-1].end == len((" " + text).encode())


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.linked(empty, BYTE_LEVEL, PIECES).count() == 0
    nulls = spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")
    assert [tuple(r)[1:6] for r in alignment.linked(nulls, BYTE_LEVEL, PIECES).collect()] == [(0, 0, 0, 0, "")] * 2


def test_galloping():
    draw = np.random.default_rng(2)
    for _ in range(50):
        target = np.unique(draw.integers(0, 500, 80))
        value = draw.integers(0, target[-1] + 1, 30)
        low = np.minimum(draw.integers(0, len(target), 30), np.searchsorted(target, value))
        found = alignment.gallop(target, value, low, np.full(30, len(target)))
        assert found.tolist() == np.searchsorted(target, value).tolist()
