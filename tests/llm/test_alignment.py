"""Alignment of tokenizers against brute force over token occurrences."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from conftest import SF
from siteval.llm import alignment


def brute(rows):
    """Rows of the contract, from both tokenizers' slow paths and a walk over all ends."""
    from tokenizers import Tokenizer
    import sentencepiece
    a = Tokenizer.from_file(alignment.BYTE_LEVEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    of = alignment._byte_level()
    seen = []
    for doc_id, t in rows:
        raw = b" " + (t or "").encode()
        x = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in (a.encode(" " + t, add_special_tokens=False).ids if t else [])]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in (b.encode(t) if t else [])]
        if not t or b"".join(s for _, s in x) != raw or b"".join(s for _, s in y) != raw:
            seen.append((doc_id, 0, 0, [], ""))
            continue
        ends = []
        for side in (x, y):
            at, own = 0, {}
            for i, s in side:
                at += len(s)
                own[at] = i
            ends.append(own)
        shared = sorted(set(ends[0]) & set(ends[1]))
        order = {e: k for k, e in enumerate(shared)}
        parts = [[[], []] for _ in shared]
        for k, own in enumerate(ends):
            at = 0
            for e, i in own.items():
                parts[at][k].append(str(i))
                at += e in order
        groups = ["|".join(map(",".join, p)) for p in parts]
        seen.append((doc_id, len(x), len(y), [(ends[0][e], ends[1][e]) for e in shared], hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for *_, links, _ in seen for p in links)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(d, n, m, len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), h) for d, n, m, links, h in seen]


ODD = [None, "", " ", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> and <s></s><unk>", "<0x41>", "a▁b", "été naïve Übung", "你好 \U0001f600 ﬁ ½",
       "aaaa" * 200, "x\x00y", "\x85  ", "copy of a text", "copy of a text", "it's we'll 1234567 !!!", "٠١ กำ"]


def test_merge_path_cuts_into_equal_work():
    rng = np.random.default_rng(1)
    for piece in (1, 2, 3, 7, 100):
        for _ in range(40):
            a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
            i, j = alignment.merge_path(a, b, piece)
            assert (np.diff(i + j)[:-1] == piece).all() and i[-1] == len(a) and j[-1] == len(b)
            x, y = alignment.shared_ends(a, b, piece)
            assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 8])
def test_rows_equal_brute_force_on_odd_texts(spark, frequent):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(3, "again three", "x", 1), (None, "null id", "x", 1), (50, "word " * 3_000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, pair int")
    got = alignment.aligned_documents(docs, frequent=frequent)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute([r[:2] for r in rows]), key=str)


def test_empty_table(spark):
    assert alignment.aligned_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, alignment.query(spark, SF).collect())) == sorted(brute(map(tuple, docs)))
