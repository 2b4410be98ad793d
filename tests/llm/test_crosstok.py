"""Cross-tokenizer alignment against brute force with the tokenizers' own libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe, crosstok


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k.model"))
    a_bytes = bpe.Codec(bpe.vocabulary_path()).bytes_of
    piece = lambda k: bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()
    out, linked = [], []
    for _, text in rows:
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        a_parts, b_parts, want = [a_bytes[k] for k in a], [piece(k) for k in b], (" " + (text or "")).encode()
        if b"".join(a_parts) != want or b"".join(b_parts) != want or not text:
            out.append((0, 0, []))
            linked.append(Counter())
            continue
        ends = [set(np.cumsum([len(x) for x in p]).tolist()) for p in (a_parts, b_parts)]
        groups, shared = defaultdict(lambda: ([], [])), np.array(sorted(ends[0] & ends[1]))
        for side, (ids, parts) in enumerate(((a, a_parts), (b, b_parts))):
            for k, at in zip(ids, np.cumsum([len(x) for x in parts]), strict=True):
                groups[int(np.searchsorted(shared, at))][side].append(k)
        groups = [groups[k] for k in sorted(groups)]
        linked.append(Counter())
        for xs, ys in groups:
            for x, k in Counter(xs).items():
                for y, m in Counter(ys).items():
                    linked[-1][x, y] += k * m
        out.append((len(a), len(b), groups))
    n = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (x, _), k in n.items():
        best[x] = max(best[x], k)
    spell = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return sorted(
        ((d, na, nb, len(g), sum(len(x) * len(y) for x, y in g), sum(k for p, k in c.items() if n[p] == best[p[0]]), sum(n[p] * k for p, k in c.items()), hashlib.sha256(spell(g).encode()).hexdigest() if g else "") for (d, _), (na, nb, g), c in zip(rows, out, linked, strict=True)),
        key=repr,
    )


def texts():
    rng = np.random.default_rng(0)
    some = ["retitioning the of", "漢字かな交じり文", "naïve café", "  two   spaces ", "line\nbreaks\n\n", "it's <|endoftext|> done", "😀👍🏽", "tab\tand\r\n", "<0x41> <unk> </s>", "12345.678", "ﬁne ½", "▁piece", " nbsp​", "aaaaaaaa" * 20]
    rows = [(k, " ".join(rng.choice(some, rng.integers(1, 8)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "\n"), (104, "x" * 30_000), (105, " " * 5_000), (106, "ab" * 10_000 + "漢" * 3000), (None, "naïve café"), (107, "same"), (107, "same"), (108, "\0"), (109, "á" * 400)]
    return rows


@pytest.mark.parametrize("one_read", [crosstok.ONE_READ, 30, 0])
def test_links(spark, one_read):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pairs": F.lit(1), "n_a": F.lit("mine"), "id": F.lit(0)})
    got = crosstok.link_counts(docs, one_read=one_read)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_long_groups_and_empty_tables(spark, monkeypatch):
    rows = texts()
    t = crosstok.tokenizers(bpe.vocabulary_path(), bpe.vocabulary_path("piece_bpe_32k.model"))
    plain = crosstok.align([x for _, x in rows], t)
    monkeypatch.setattr(crosstok, "LISTED", 1)
    for x, y in zip(plain, crosstok.align([x for _, x in rows], t), strict=True):
        assert x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all()
    assert crosstok.link_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert tuple(crosstok.link_counts(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()) == (1, 0, 0, 0, 0, 0, 0, "")


def test_cuts_of_any_shape():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.02, 0.5, 1.0):
        a = np.cumsum(rng.integers(1, 4, 3000))
        b = np.union1d(a[rng.random(3000) < share], rng.integers(1, a[-1], 500))
        b = np.union1d(b[b <= a[-1]], a[-1:])
        got = crosstok.shared_ends(a, b, np.array([0]), np.array([3000]))
        assert (got == np.isin(a, b)).all()


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, crosstok.op13_cross_tokenizer(spark, d).collect()), key=repr)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()])
