"""The operators of siteval.llm on small tables, held against brute force."""

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteval.llm import jaccard, langid, lattice, mixing, packing, passages, polytope, shuffle, tokens, warc
from siteval.runtime import scratch_path

DOCS = "doc_id long, text string, lang string, source string, _extra int, token int, node string"


def prose(rng, n, words=400):
    return " ".join(f"w{i}" for i in rng.integers(0, words, n))


def corpus():
    """Copies, near copies, a shared passage, short, empty, null, long and repeated texts."""
    rng = np.random.default_rng(1)
    texts = [prose(rng, 120) for _ in range(12)]
    base = prose(rng, 200).split()
    for i in range(10):
        near = list(base)
        near[10 * i + 3] = f"edit{i}"
        texts.append(" ".join(near))
    passage = prose(rng, 70, 10_000)
    texts += [f"{prose(rng, 60)} {passage} {prose(rng, 60)}" for _ in range(4)]
    texts += [texts[0], texts[0].upper(), "one two", "One  two", "", None, " \n\t ", prose(rng, 20_000), "go " * 400, "go " * 300, "Ünïcode \x0b words", "  nbsp"]
    return [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", 7, 8, "n") for i, t in enumerate(texts)]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard_equals_brute_force(spark):
    rows = corpus()
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_jaccard_repeated_and_null_ids(spark):
    text = prose(np.random.default_rng(2), 30)
    rows = [(5, text), (5, "other words here are few"), (None, text), (3, "other words here are few"), (9, None)]
    got = sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert {(r[0], r[2]) for r in got} == {(5, 3), (None, 3), (3, 3), (9, 9)} and len(got) == 5


def test_jaccard_prefix_grows_with_cost():
    assert jaccard.need_of(np.zeros(100), 100, 75) == 1
    assert jaccard.need_of(np.full(100, 1000.0), 100, 75) > 1


def test_blocks_divide_the_holders_of_all_lists_of_a_hub(spark, monkeypatch):
    def held(threshold):
        schema, names = jaccard._MET_SCHEMA, jaccard._MET
        return lambda t: pa.table({c: pa.array([len(set(t["node"].to_pylist())) if c == "a" else 0], schema.field(c).type) for c in names}, schema=schema)

    monkeypatch.setattr(jaccard, "_block_counts", held)
    monkeypatch.setattr(jaccard, "PAIR_BLOCK", 20)
    rows = [(t, 0 if i == 0 else 100 * t + i, 30, 1, 1, 0, 1, 9 if i == 0 else 1, 20) for t in range(1, 21) for i in range(20)]
    got = jaccard._long_lists(spark.createDataFrame(rows, "token long, node long, n int, level int, need int, root long, total int, central int, c long"), 75).collect()
    assert len(got) > 1 and max(r.a for r in got) <= 100


def test_passages_cover_all_exact_repeats(spark):
    rows = corpus()
    word = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    seen, want = {}, {}
    for i, w in word.items():
        for j in range(len(w) - 49):
            first = seen.setdefault(tuple(w[j : j + 50]), i)
            if first < i:
                want.setdefault(i, set()).update(range(j, j + 50))
    got = {}
    df = spark.createDataFrame(rows, DOCS)
    for r in passages.repeated_passages(df).collect():
        assert r.ref_id < r.doc_id and r.equal_words * 100 >= 75 * (r.end_word - r.start_word)
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert all(not want[i] - got.get(i, set()) for i in want)
    assert not set(got) - {r[0] for r in rows if len(word[r[0]]) >= 50}
    cut = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert len(cut) == len(rows) and cut[28] == "one two" and cut[31] is None and cut[0] == rows[0][1] and (cut[26] or "").strip() == ""


def test_chains_follow_order_and_break_at_gaps():
    pos, ref = np.array([0, 10, 20, 30, 200]), np.array([5, 500, 25, 35, 205])
    best = passages.chains(pos, ref)[0]
    assert best.tolist() == [0, 2, 3]
    assert sorted(int(i) for c in passages.chains(pos, ref) for i in c) == [0, 1, 2, 3, 4]
    assert passages.chains(np.array([1, 2, 300]), np.array([1, 2, 300]))[0].tolist() == [0, 1]


def test_dissimilar_chain_is_split(spark):
    """Two exact passages with another stretch between are found apart, whatever the share of the whole."""
    rng, rows, want = np.random.default_rng(11), [], {}
    for k in range(40):
        one, two = prose(rng, 52, 10**6), prose(rng, 52, 10**6)
        for i in (2 * k, 2 * k + 1):
            rows.append((i, f"{prose(rng, 40, 10**6)} {one} {prose(rng, 36, 10**6)} {two} {prose(rng, 40, 10**6)}"))
        want[2 * k + 1] = set(range(40, 92)) | set(range(128, 180))
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want


@pytest.mark.parametrize("n, edits", [(60, 6), (60, 9), (60, 12), (60, 14), (100, 20), (100, 24)])
def test_edited_passages_are_found(spark, n, edits):
    rng, rows = np.random.default_rng(12), []
    for k in range(40):
        own = prose(rng, n, 10**6).split()
        other = list(own)
        for i in rng.choice(n, edits, replace=False):
            other[i] = f"edit{rng.integers(10**9)}"
        rows += [(2 * k + j, f"{prose(rng, 60, 10**6)} {' '.join(w)} {prose(rng, 60, 10**6)}") for j, w in enumerate((own, other))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.ref_id == r.doc_id - 1} == set(range(1, 80, 2))


def test_passage_whose_parts_lie_in_earlier_documents(spark):
    rng, rows, want = np.random.default_rng(13), [], {}
    for k in range(0, 120, 4):
        whole = prose(rng, 60, 10**6).split()
        for i, w in enumerate((whole[:32], whole[28:], whole, whole)):
            rows.append((k + i, f"{prose(rng, 40, 10**6)} {' '.join(w)} {prose(rng, 40, 10**6)}"))
        want[k + 3] = set(range(40, 100))
    got = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_matches_over_batch_edges(size):
    rng = np.random.default_rng(14)
    rows = sorted({(int(s), int(d), int(p)) for s, d, p in zip(rng.integers(0, 6, 300), rng.integers(0, 9, 300), rng.integers(0, 5, 300))})
    want = []
    for s, d, p in rows:
        group = [r for r in rows if r[0] == s]
        before = [r for r in group if r[1] < d]
        want += [(d, p, *group[0][1:])] if d != group[0][1] else []
        want += [(d, p, *before[-1][1:])] if s % 2 and before and before[-1][1] != group[0][1] else []
    cut = [pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), (pa.int64(), pa.int64(), pa.int32()))], names=["seed", "doc", "pos"]) for i in range(0, len(rows), size)]
    assert sorted(tuple(r.values()) for b in passages._matched(cut) for r in b.to_pylist()) == sorted(want)


def test_chain_of_a_later_passage_is_not_hidden():
    pos, ref = np.append(np.arange(60), [1000, 1010, 1020, 1030]), np.append(np.arange(60), [1001, 1011, 990, 1031])
    assert [c.tolist() for c in passages.chains(pos, ref)][1] == [60, 61, 63]


@pytest.mark.parametrize("block", [8, 34, 1 << 20])
def test_separator_scan_over_block_edges(spark, block):
    rows = corpus()
    path = scratch_path(spark, "flat")
    tokens.write_flat(spark.createDataFrame(rows, DOCS).coalesce(2), path)
    e = tokens.encoder(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    got = tokens.document_lengths(spark, path, block_bytes=block).collect() if block > 100 else tokens.document_lengths(spark, path, block_bytes=block * 64).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(e.encode_ordinary(r[1] or "")) for r in rows) and all(r.closed for r in got)
    for f in {r.file for r in got}:
        mine = sorted((r.doc_index, r.start, r.n_tokens) for r in got if r.file == f)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(mine, mine[1:]))


def test_rake_meets_margins_and_draws_by_weight(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(40, 4000)), ["en", "de"][int(rng.random() < 0.3)], f"s{min(3, int(rng.exponential(1)))}") for i in range(3000)] + [(9000, None, None, None), (9001, "", "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goal = {"source": {"s0": 0.25, "s1": 0.25, "s2": 0.25, "s3": 0.25}, "lang": {"en": 0.5, "de": 0.5}, "topic": 1.0}
    got = mixing.mixed(docs, shares=goal).toPandas()
    assert len(got) == len(rows) and got._probability.between(0, 1).all() and not got[got.doc_id >= 9000]._kept.any()
    total = (got._tokens * got._probability).sum()
    for axis in ("source", "lang"):
        for value, share in goal[axis].items():
            own = got[got[axis] == value]
            assert abs((own._tokens * own._probability).sum() / total - share) < 1e-4
            assert abs((own._tokens * own._kept).sum() / (got._tokens * got._kept).sum() - share) < 0.06
    with pytest.raises(ValueError, match="margins"):
        mixing.mixed(docs.filter("doc_id < 10").withColumn("lang", F.when(F.col("source") == "s0", "en").otherwise("de")), shares={"source": {"s0": 0.9, "s1": 0.1}, "lang": {"en": 0.1, "de": 0.9}, "topic": 1.0})


@pytest.mark.parametrize("local", [0, mixing.LOCAL])
def test_contradictory_temperatures_end_with_the_best_fit(spark, local):
    cells = spark.createDataFrame([("a", "en", "prose", 100), ("b", "de", "prose", 900)], "source string, lang string, topic string, n long")
    got = {r.source: r for r in mixing.rake(cells, mixing.TEMPERATURE, local=local).collect()}
    # Least divergence of (w, 1 - w) from both pairs of targets: the odds are their geometric mean.
    odds = 9.0 ** ((0.7 + 0.8) / 2)
    assert abs(got["b"].w / got["a"].w - odds) < 1e-3 * odds and got["a"].off > 0.01
    with pytest.raises(ValueError, match="margins"):
        mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": 0.8, "topic": 1.0}, local=local)


def test_slow_margins_are_met(spark):
    cells = spark.createDataFrame([("a", "en", "p", 1_000_000), ("a", "de", "p", 30_000), ("b", "en", "p", 30_000), ("b", "de", "p", 1_000_000)], "source string, lang string, topic string, n long")
    got = mixing.rake(cells, {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.69, "de": 0.31}, "topic": 1.0}).toPandas()
    assert abs(got[got.source == "a"].w.sum() - 0.7) < 1e-5 and abs(got[got.lang == "en"].w.sum() - 0.69) < 1e-5


def test_rare_cells_repeat_and_others_keep_their_rate(spark):
    rows = [(i, "x" * 400, "en", f"s{i % 20}") for i in range(20_000)] + [(20_000, "x" * 400, "en", "rare")]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    taken = mixing.repeated(got).groupBy("source").count().toPandas().set_index("source")["count"]
    want = 20_001 / (20 * 1000**0.7 + 1)
    assert abs(taken["rare"] - want) <= 1 and taken["rare"] > 1 and taken.drop("rare").sum() > 0.98 * 20_000


def test_boundaries_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, 8, replace=False)) + 1
        counts = rng.integers(1, 20, 8)
        pad = lambda edges: sum(c * (min(e for e in edges if e >= n) - n) for n, c in zip(lengths, counts))
        best = min(pad([*e, lengths[-1]]) for e in combinations(lengths[:-1], 2))
        assert pad(packing.boundaries(lengths, counts, 3)) == best


def test_equal_lengths_need_no_padding(spark):
    got = packing.packed(spark.createDataFrame([(i, "y" * 36) for i in range(50)] + [(90, "y" * 8001)], "doc_id long, text string"), budget=90).collect()
    assert all(r.boundary == r.n_tokens for r in got) and max(r.slot for r in got) == 9


def test_batches_hold_the_budget(spark):
    rows = spark.createDataFrame([(i % 300, "y" * (7 * i % 4001)) for i in range(900)] + [(None, None), (1, "z" * 900_000)], "doc_id long, text string")
    got = packing.packed(rows, buckets=5, budget=4000).toPandas()
    assert len(got) == 902 and (got.boundary >= got.n_tokens).all() and got.bucket.nunique() == 5
    for (_, _), g in got.groupby(["bucket", "batch"]):
        assert sorted(g.slot) == list(range(len(g))) and (len(g) == 1 or g.boundary.sum() <= 4000)
    for _, g in got.groupby("bucket"):
        assert sorted(g.batch.unique()) == list(range(g.batch.nunique()))


def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        v = rng.normal(size=16)
        rows.append((i, v.tolist(), i % 3))
    centre = rng.normal(size=16)
    centre /= np.linalg.norm(centre)
    rows += [(300 + i, (centre + rng.normal(size=16) * 0.04).tolist(), 1) for i in range(60)]
    rows += [(400, rows[0][1], 0), (401, (np.array(rows[1][1]) * 3).tolist(), 1), (402, None, 1), (403, [0.0] * 16, 1), (404, [float("nan")] * 16, 1), (405, [1.0, None] + [0.0] * 14, 1), (406, rows[2][1], None), (407, [], 1), (500, [1.0, 2.0], 1), (501, [2.0, 4.0], 1)]
    return rows


def test_lattice_equals_brute_force(spark):
    rows = vectors()
    good = {i: (np.array(v, float) / np.linalg.norm(v), g) for i, v, g in rows if g is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.93]
    ids = [r[0] for r in rows]
    root = components(ids, links)
    degree = {i: sum(i in p for p in links) for i in ids}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (degree[i], root[i], root[i] == i) for i in ids}


def test_decode_is_the_nearest_lattice_point():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)) * 2
    y = lattice.decode(x)
    near = lattice.minimal_vectors()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(axis=1), 2)
    assert all(((a - b) ** 2).sum() <= ((a - b - near) ** 2).sum(axis=1).min() + 1e-9 for a, b in zip(x, y))


def test_polytope_recall_and_small_tables(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 24)]
    got = polytope.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(2000), d))[:10]) & set(g.vec_id))
        assert np.allclose(d[g.sort_values("rank").vec_id], g.sort_values("rank").score) and sorted(g["rank"]) == list(range(1, 11))
    assert got.query_id.nunique() == 20 and hits >= 0.9 * 200
    few = polytope.nearest(spark.createDataFrame(rows[:4] + [rows[1]], "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(i + 1, j) for i, j in enumerate(np.argsort(((x[1:4] - x[0]) ** 2).sum(axis=1)) + 1)]


def test_shards_are_even_and_whole(spark):
    rows = [(i // 2, "copy" if i % 3 else f"text {i} ü", i) for i in range(1001)] + [(None, None, 1)]
    path = scratch_path(spark, "shards")
    shuffle.write_shards(spark.createDataFrame(rows, "doc_id long, text string, mark int"), path, "doc_id", "text", shards=7, bucket_bytes=2000)
    got = spark.read.parquet(path).toPandas()
    counts = got.groupby("_shard").size()
    assert len(got) == 1002 and sorted(got.mark) == sorted(r[2] for r in rows) and counts.max() - counts.min() <= 1 and len(counts) == 7
    assert all(sorted(g._slot) == list(range(len(g))) for _, g in got.groupby("_shard"))
    order = got.sort_values(["_shard", "_slot"]).mark.to_numpy()
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.15


def test_warc_round_trip_with_segments_and_revisits(spark):
    big = "<p>ü</p>" * 9000
    rows = [(1, "http://a", big), (2, None, big), (3, "http://b\r\nX: y", "WARC/1.1\r\n\r\n" + "z" * 200), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (0, "u", big), (None, "u", big), (0, "u", big)]
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, segment=5000)
    got = warc.read_archives(spark, path).select(warc.page_of(F.col("name")).alias("page"), "kind", warc.page_of(F.col("refers")).alias("refers"), F.col("payload").cast("string").alias("payload")).collect()
    want = [(p, "revisit" if h == big and p in (1, 2) else "response", 0 if h == big and p in (1, 2) else None, None if h == big and p in (1, 2) else h or "") for p, _, h in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_broken_chunks_have_no_payload():
    assert warc.unchunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000
    assert warc.unchunked(b"3\r\nabc\r\n") is None and warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_language_network_learns_and_answers_for_all_rows(spark):
    rng = np.random.default_rng(8)
    vocab = {"aa": ["the", "and", "house", "with"], "bb": ["der", "und", "haus", "mit"], "cc": ["él", "casa", "ñandú", "con"]}
    rows = [(i, " ".join(rng.choice(vocab[g], int(rng.integers(3, 150)))), g) for i, g in enumerate(rng.choice(list(vocab), 900))]
    rows += [(2000, None, "aa"), (2001, "", "bb"), (2002, "123 456", "aa"), (2003, "ñ", None), (2004, "der und " * 50_000, None), (None, "the house", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs)
    assert net.languages == ["aa", "bb", "cc"]
    got = langid.predicted(docs, net).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    by = {r.doc_id: r for r in got.itertuples() if r.doc_id == r.doc_id}
    assert [by[i].lang_pred for i in (2000, 2001, 2002)] == ["und"] * 3 and by[2004].lang_pred == "bb"
    held = [(r, by[r[0]]) for r in rows[:900] if by[r[0]].held_out]
    assert all(p.held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r, p in held) and len(held) > 150
    assert sum(r[2] == p.lang_pred for r, p in held) >= 0.97 * len(held)
    assert langid.train(docs.filter("false")) is None


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    vecs = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    path = [scratch_path(spark, "none") for _ in range(3)]
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path[0])
    shuffle.write_shards(docs, path[1], "doc_id", "text")
    tokens.write_flat(docs, path[2])
    for df in (jaccard.near_duplicates(docs), passages.repeated_passages(docs), mixing.mixed(docs), packing.packed(docs), langid.predicted(docs, None), lattice.near_duplicates(vecs),
               polytope.nearest(vecs, F.col("id") % 100 == 0), warc.read_archives(spark, path[0]), spark.read.schema("doc_id long").parquet(path[1]), tokens.document_lengths(spark, path[2])):
        assert df.count() == 0
