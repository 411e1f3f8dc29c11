"""Ranked search, nearest vectors and filling in the middle against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import infill, neighbours, queries, ranking

# fill in the middle


def plain_cut(key, text):
    """(n, form, prefix_chars, middle_chars, output) by a list of units."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def infill_rows():
    rng = random.Random(13)
    pool = ["a", "Z", "bcd", " ", "\n", "\r\n", "é", "漢字", "😀", "7", "<", "<P", ">", "P>", "\x00", "ſ", "ª", "."]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "a null key"), (1002, "holds <M> itself"), (1003, "same"), (1003, "same"), (1003, "other of one key"), (-5, "negative key")]
    rows += [(2000 + i, "word, " * 40_000 + "é" * i) for i in range(4)]  # very long
    return rows


def test_infill_against_a_list_of_units(spark):
    rows = infill_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("clash"), "output": F.lit("clash")})
    made = infill.fill_in_middle(df)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    own = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr)
    assert own == sorted(((k, *plain_cut(k, t)) for k, t in rows), key=repr)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["back"]) for r in got) == sorted((k is None, k or 0, t or "") for k, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infill_of_no_rows(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_masks_and_ranked_bits():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aB é漢😀.1") for _ in range(rng.randrange(1, 60)))
        raw = text.encode()
        starts, leads = infill.unit_starts(raw)
        places = [len(text[: m.start()].encode()) for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        assert [i for i in range(len(raw)) if starts >> i & 1] == places
        assert leads.bit_count() == len(text)
        assert [infill.ranked_bit(starts, len(raw), k) for k in range(len(places))] == places


def test_broken_bytes_are_replaced(spark):
    df = spark.sql("SELECT 3L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    got = infill.fill_in_middle(df).collect()[0]
    assert (got["doc_id"], got["n"], got["form"], got["prefix_chars"], got["middle_chars"], got["output"]) == (3, *plain_cut(3, "a�b"))


# ranked search


def plain_rank(docs, items, k=10):
    """All documents scored for all items."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    counted = [(key, Counter(terms(t))) for key, t in docs]
    counted = [(key, c, c.total()) for key, c in counted if c]
    n_docs, n_all = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c, n in counted:
            m = 25 + 75 * n * n_docs // n_all
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, r + 1, key, -s) for r, (s, _, _, key) in enumerate(sorted(scored)[:k])]
    return out


def ranking_rows():
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Ünïcode", "ÉA", "don't", "a_b", "漢字", "THE", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " \t.,-"), (None, text(20)), (503, docs[0][1]), (7, docs[0][1]), (7, docs[0][1]), (504, "the " * 5000 + text(3000))]
    items = [(i, text(rng.randrange(1, 12))) for i in range(30)] + [(90, None), (91, "..."), (92, "nowhere"), (93, "the the the THE"), (93, "the the the THE"), (None, "w1 w2"), (94, docs[0][1])]
    return docs, items


@pytest.mark.parametrize(("postings", "terms", "piece", "read"), [(1_000_000, 200_000, 1 << 20, 16), (150, 40, 64, 1)])
def test_ranking_against_all_documents(spark, monkeypatch, postings, terms, piece, read):
    for name, value in (("BLOCK_POSTINGS", postings), ("BLOCK_TERMS", terms), ("PIECE", piece), ("FIRST_READ", read)):
        monkeypatch.setattr(ranking, name, value)
    monkeypatch.setattr(ranking, "GROUPS", 3)
    docs, items = ranking_rows()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("clash"), "score": F.lit(1)})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit("clash"), "rank": F.lit("clash")})
    got = sorted((tuple(r) for r in ranking.rank(d, i).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == sorted(plain_rank(docs, items), key=repr)


def test_ranking_of_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items, no_items = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ranking.rank(none, items).collect() == []
    assert ranking.rank(some, no_items).collect() == []
    assert [tuple(r) for r in ranking.rank(some, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_the_threshold_stops_before_all_documents_are_scored():
    rng = np.random.default_rng(3)
    n, terms = 4000, np.array([0, 1])
    rare = np.zeros(n, bool)
    rare[rng.choice(n, 40, replace=False)] = True
    row = np.concatenate([[0], np.cumsum(1 + rare)])
    listed = np.concatenate([[0, 1] if r else [1] for r in rare])
    rate = rng.integers(400_000, 900_000, len(listed))
    shard = ranking.Shard(np.arange(n), np.ones(n, bool), row, listed, rate, 2)
    best = ranking.Best(10)
    weights = np.array([9000, 50], np.int64)
    assert shard.search(terms, weights, best) < n / 4
    scores = np.add.reduceat(weights[listed] * rate, row[:-1])
    assert best.score.tolist() == sorted(scores.tolist(), reverse=True)[:10]
    assert not best.beats(int(best.score[-1])) and best.beats(int(best.score[-1]) - 1)  # strictly below only


# nearest vectors


def vector_rows(n=3000, dim=24, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    hub = (x[0] / np.linalg.norm(x[0])).tolist()
    rows += [(n + i, hub) for i in range(120)]  # copies
    rows += [(n + 200 + i, (np.array(hub) + rng.normal(size=dim) * 0.01).tolist()) for i in range(120)]  # near copies
    return rows


def plain_nearest(rows, k=20):
    """(query, rank, id, score) by all inner products in double precision, summed in order."""
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20:
            continue
        scored = sorted((-float(np.cumsum(x * y)[-1]), i) for i, y in good if i != q and len(y) == len(x))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def got_nearest(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for found in out.values():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    return {q: [(i, s) for _, i, s in found] for q, found in out.items()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = vector_rows()
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit("clash"), "cid": F.lit("clash"), "q": F.lit(0)}).repartition(4).cache()


def test_recall_of_the_graph(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 128)
    monkeypatch.setattr(neighbours, "TABLES", 4)
    monkeypatch.setattr(neighbours, "MAX_BROADCAST_ROWS", 10)
    monkeypatch.setattr(neighbours, "HELD", 5000)
    monkeypatch.setattr(neighbours, "TOGETHER", 50)
    rows, df = vectors
    index = neighbours.Index(df)
    got, want = got_nearest(index.search(df.where("vec_id % 20 = 0"))), plain_nearest(rows)
    assert len(index.changes) > 1 and index.changes[-1] < neighbours.CHANGED <= index.changes[0]
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    exact = {(q, i): s for q, found in plain_nearest(rows, len(rows)).items() for i, s in found}
    assert all(exact[q, i] == s for q, found in got.items() for i, s in found)
    index.drop()


def test_queries_that_the_index_does_not_hold(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 512)
    rows, df = vectors
    index = neighbours.Index(df.where("vec_id % 20 <> 0"))
    got = got_nearest(index.search(df.where("vec_id % 20 = 0")))
    want = {q: [i for i, _ in found if i % 20][:20] for q, found in plain_nearest(rows, 60).items()}
    hits = sum(len({i for i, _ in got[q]} & set(want[q])) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 20 * len(want)
    index.drop()


def test_few_vectors_are_compared_exactly(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(90)]
    rows += [(100, None), (120, []), (140, [0.0] * 6), (160, [1.0, None, 0, 0, 0, 0]), (180, [1.0, nan, 0, 0, 0, 0]), (200, [inf, 1.0, 0, 0, 0, 0]), (None, [1.0] * 6)]
    rows += [(220, [1.0, 2.0, 3.0]), (240, [3.0, 2.0, 1.0]), (260, [5.0])]  # other lengths
    rows += [(280 + i, [1.0, 0.0, -0.0, 0, 0, 0.5]) for i in range(30)] + [(310 + i, [1.0, -0.0, 0.0, 0, 0, 0.5]) for i in range(30)]  # equal but for the zeros' signs
    df = spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<float>")
    got, want = got_nearest(neighbours.nearest(df, df.where("vec_id % 20 = 0"))), plain_nearest(rows)
    assert got == {q: found for q, found in want.items() if found}
    assert got[220] == [(240, 10.0)] and 260 not in got


def test_rows_that_share_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.9, 0.1]), (21, [0.5, 0.5]), (21, [0.5, 0.5]), (22, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, df.where("vec_id = 20")).collect())
    assert got == [(1, 21, 0.5), (1, 21, 0.5), (2, 21, 0.5), (2, 21, 0.5), (3, 22, 0.0), (3, 22, 0.1)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, df).collect() == []


def test_best_of():
    u, v, s, flag = (np.array(c) for c in ([1, 1, 1, 1, 2], [5, 6, 5, 7, 5], [0.5, 0.7, 0.5, 0.7, 0.1], [1, 1, 0, 1, 1]))
    assert [c.tolist() for c in neighbours.best_of(u, v, s, flag, 3)] == [[1, 1, 1, 2], [6, 7, 5, 5], [0.7, 0.7, 0.5, 0.1], [1, 1, 0, 1]]
    assert [c.tolist() for c in neighbours.best_of(u, v, s, flag, 1)][1] == [6, 5]


# the queries themselves, on a small folder of tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    docs, items = ranking_rows()
    spark.createDataFrame([*docs, *infill_rows()[:60]], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, v, 0) for i, v in vector_rows(300, 8)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_queries(spark, folder):
    docs, items = ranking_rows()
    docs = [*docs, *infill_rows()[:60]]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.op13_fill_in_middle(spark, folder)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, *c[:-1], sha(c[-1]), sha(t or "")) for k, t in docs for c in [plain_cut(k, t)]), key=repr)
    assert sorted(map(tuple, queries.op11_threshold_search(spark, folder).collect()), key=repr) == sorted(plain_rank(docs, items), key=repr)
    assert got_nearest(queries.op12_nearest_vectors(spark, folder)) == plain_nearest(vector_rows(300, 8))
