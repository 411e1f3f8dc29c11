"""Archives, shards, replication and the pipeline."""

import base64
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import common, compaction, fertility, langid, mixing, queries, warc

# archives

PAGES = [
    (3, "http://a/", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (2, "http://c/\r\nX: y", "<p>other</p>"), (7, None, None), (5, "u", ""), (4, "é", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
    (6, "u", "x" * 200_000), (8, "u", "<p>same</p>"), (9, "u", "twice"), (9, "u", "twice"), (None, "u", "alone"), (None, "u", "<p>same</p>"), (None, "n", "nobody"), (None, "n", "nobody"),
]


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected_captures(min_bytes):
    out = []
    for key, _, page in PAGES:
        keys = [k for k, _, p in PAGES if (p or "") == (page or "") and k is not None]
        size = len((page or "").encode())
        revisit = size >= min_bytes and bool(keys) and (key is None or key > min(keys))
        out.append((key, size, sha1(page), "revisit" if revisit else "response", min(keys) if revisit else None))
    return out


order = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 12])
@pytest.mark.parametrize("few", [True, False])
def test_archive(spark, monkeypatch, min_bytes, few):
    monkeypatch.setattr(warc, "MAX_BROADCAST_COPIES", 100 if few else -1)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "payload": F.lit(1)})
    path = common.scratch(spark, "archive")
    warc.write_archive(pages.repartition(3), path, min_bytes=min_bytes)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({p or "" for _, _, p in PAGES})  # once each
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["digest"] for r in stored.collect())
    records = warc.restore(spark, path).cache()
    got = warc.captures(warc.parse(records)).collect()
    page = lambda v: None if v is None else int(v)
    assert order((page(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to"])) for r in got) == order(expected_captures(min_bytes))
    # through plain files and back, byte for byte
    files = common.scratch(spark, "warc")
    warc.write_files(records, files, records_per_file=2)
    back = warc.read_files(spark, files)
    assert order(bytes(r["record"]) for r in back.collect()) == order(bytes(r["record"]) for r in records.collect())
    common.drop(spark, path, files)


def test_damaged_payload_is_refused(spark):
    path = common.scratch(spark, "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    wrong = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("abd"), "UTF-8")).collect()
    spark.createDataFrame(wrong, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs"):
        warc.restore(spark, path).collect()


def test_empty_archive(spark):
    path = common.scratch(spark, "archive")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(warc.parse(warc.restore(spark, path))).count() == 0
    with pytest.raises(ValueError):
        list(warc.split_records(b"junk"))


# shards


def shard(name, size):
    return compaction.Shard(name, size)


def test_plan():
    mb = 1 << 20
    small = tuple(shard(str(i), mb) for i in range(10))
    bins = compaction.plan_bins((*small, shard("big", 100 * mb), shard("mid", 30 * mb)), 4 * mb)
    assert [len(b) for b in bins] == [4, 4, 2] and [s.path for s in bins[0]] == ["0", "1", "2", "3"]
    assert compaction.plan_bins(small[:3]) == []  # no run of one tier yet
    assert compaction.tier(0) == 0 and compaction.tier(5 * mb) == 1 and compaction.tier(17 * mb) == 2


def test_store(spark):
    store = compaction.Store(spark, common.scratch(spark, "store"))
    with pytest.raises(FileNotFoundError):
        store.manifest()
    rows = [(i, None if i % 7 == 0 else f"text {i}") for i in range(50)] + [(1, "text 1"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    store.append(df.where("doc_id < 10").repartition(3))
    first = store.manifest()
    store.append_batches(df.where("doc_id >= 10 or doc_id is null"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)))
    assert len(store.versions()) == 6
    before = sorted(map(repr, store.read().collect()))
    assert before == sorted(map(repr, df.collect()))
    last = store.compact()
    assert len(last.shards) == 1 and last.version > 6 and sorted(map(repr, store.read().collect())) == before
    assert sorted(map(repr, store.read(first.version).collect())) == sorted(map(repr, df.where("doc_id < 10").collect()))  # old versions stay readable
    with pytest.raises(compaction.Conflict):
        store._commit(first, last.schema, [], set())
    assert store.vacuum() > 0 and store.versions() == [last.version] and sorted(map(repr, store.read().collect())) == before
    clash = compaction.Store(spark, common.scratch(spark, "store"))
    clash.append_batches(df.withColumn("__batch", F.lit("own")), F.lit(1))
    assert {r["__batch"] for r in clash.read().collect()} == {"own"}


def test_arrivals_come_in_order_of_their_numbers(spark):
    store = compaction.Store(spark, common.scratch(spark, "store"))
    df = spark.range(160).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 150, (F.col("id") % 15).cast("int")).alias("batch"))
    store.append_batches(df, F.col("batch"))
    assert store.versions() == list(range(1, 17)) and store._numbers("s") == [16]
    seen = [{r["batch"] for r in store.read(v).collect()} for v in store.versions()]
    assert [new - old for old, new in zip([set(), *seen], seen)] == [*({i} for i in range(15)), {None}]
    store.append(df.limit(1))
    assert store.read(16).count() == 160 and store.read(17).count() == 161 and store.read(3).count() == 30
    store.vacuum(keep=2)
    assert store.versions() == [16, 17] and store.read(16).count() == 160 and store.read().count() == 161


def test_a_vacuum_spares_writers_at_work(spark, monkeypatch):
    """A second writer, and a vacuum, come between the data and the commit of the first."""
    path = common.scratch(spark, "store")
    store, other = compaction.Store(spark, path), compaction.Store(spark, path)
    store.append(spark.range(10).toDF("doc_id"))
    plain, calls = compaction.Store._commit, []

    def slow(self, last, schema, add, remove):
        if self is store and not calls:
            calls.append(1)
            other.append(spark.range(20, 25).toDF("doc_id"))
            other.vacuum()
        return plain(self, last, schema, add, remove)

    monkeypatch.setattr(compaction.Store, "_commit", slow)
    made = store.append(spark.range(10, 20).toDF("doc_id"))
    assert calls and made.version == 3 and sorted(r["doc_id"] for r in store.read().collect()) == list(range(25))
    assert store._announced() == set()


@pytest.mark.parametrize("rival", ["append", "compact"])
def test_a_merge_that_finds_its_version_taken(spark, monkeypatch, rival):
    path = common.scratch(spark, "store")
    store, other = compaction.Store(spark, path), compaction.Store(spark, path)
    store.append_batches(spark.range(40).toDF("doc_id"), F.col("doc_id") % 4)
    plain, calls = compaction.Store._commit, []

    def slow(self, last, schema, add, remove):
        if self is store and not calls:
            calls.append(1)
            other.append(spark.range(100, 101).toDF("doc_id").coalesce(1)) if rival == "append" else other.compact()
        return plain(self, last, schema, add, remove)

    monkeypatch.setattr(compaction.Store, "_commit", slow)
    last = store.compact()
    assert calls and sorted(r["doc_id"] for r in store.read().collect()) == [*range(40), *([100] if rival == "append" else [])]
    assert len(last.shards) == (2 if rival == "append" else 1) and last == store.manifest()
    store.vacuum()
    assert store.read().count() == (41 if rival == "append" else 40)


def test_a_vacuum_takes_what_dead_writers_left(spark, monkeypatch):
    store = compaction.Store(spark, common.scratch(spark, "store"))
    store.append(spark.range(3).toDF("doc_id"))
    monkeypatch.setattr(compaction.Store, "_added", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.append(spark.range(3).toDF("doc_id"))
    monkeypatch.undo()
    assert store.vacuum() == 0
    monkeypatch.setattr(compaction, "INTENT_HOURS", -1)
    assert store.vacuum() > 0 and store.read().count() == 3


def test_empty_store(spark):
    store = compaction.Store(spark, common.scratch(spark, "store"))
    empty = spark.createDataFrame([], "doc_id long, text string")
    store.append_batches(empty, F.lit(1))
    store.append(empty)
    store.compact()
    assert store.read().count() == 0 and store.read().columns == ["doc_id", "text"]


# replication


def inverse(u, mean):
    k, p, c = 0, math.exp(-mean), math.exp(-mean)
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def draw(seed, name):
    return int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest()[:13], 16) / 16**13


def test_replication_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, f"t{i}", rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(600)] + [(None, None, "a"), (5, "again", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit("clash"), "rate": F.lit(1)})
    n = {}
    for r in rows:
        n[r[2]] = n.get(r[2], 0) + 1
    mass = sum(math.sqrt(v) for v in n.values())
    expected = []
    # ids that are null or not a row's own draw by the row's place besides
    place = {(r["doc_id"], r["text"]): r["place"] for r in df.withColumn("place", F.monotonically_increasing_id()).collect()}
    for key, text, source in rows:
        rate = math.sqrt(n[source]) / mass * len(rows) / n[source]
        shared = key is None or sum(r[0] == key for r in rows) > 1
        k = inverse(draw(20, f"{'null' if key is None else key}#{place[key, text]}" if shared else key), rate)
        expected += [(key, text, source, c, k) for c in range(1, k + 1)]
    got = [(r["doc_id"], r["text"], r["source"], r["copy_no"], r["n_copies"]) for r in mixing.mix(df).collect()]
    assert order(got) == order(expected)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_rows_of_null_and_repeated_ids_draw_alone(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_IDS", most)
    rows = [(None, "same text", "a")] * 10_000 + [(7, "same text", "a")] * 10_000 + [(100 + i, "x", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 40_000 / 20_400, "b": 800 / 20_400}
    got = mixing.mix(df, weights).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("id")).agg(F.count("*").alias("n"), F.count_distinct("shuffle_key").alias("keys")).collect()
    by = {r["id"]: r for r in got}
    for i in (-1, 7):  # a mean of two copies for each row
        assert abs(by[i]["n"] - 20_000) < 6 * math.sqrt(20_000) and by[i]["n"] != 20_000 and by[i]["keys"] == by[i]["n"]
    assert abs(sum(r["n"] for i, r in by.items() if i >= 100) - 800) < 6 * math.sqrt(800)


def test_long_texts_are_carried(spark):
    df = spark.createDataFrame([(1, "y" * 3_000_000, "a"), (2, None, "a"), (3, "", "a")], "doc_id long, text string, source string")
    got = mixing.mix(df, epochs=5.0).select("doc_id", F.length("text").alias("n")).distinct().collect()
    assert {(r["doc_id"], r["n"]) for r in got} <= {(1, 3_000_000), (2, None), (3, 0)} and got


def test_given_weights(spark):
    rows = [(i, "x", s) for i, s in enumerate(["a"] * 3000 + ["b"] * 1000 + ["c"] * 10 + [None] * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: r["n"] for r in mixing.mix(df, {"a": 0.25, "b": 0.5, None: 0.25, "absent": 9.0}, epochs=2.0, keep_draw=False).groupBy("source").agg(F.count("*").alias("n")).collect()}
    total = 2 * len(rows)
    assert set(got) == {"a", "b", None}
    for source, share in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        assert abs(got[source] - share * total) < 6 * math.sqrt(share * total) + 300 * (source is None)


def test_mix_edges(spark):
    df = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    assert mixing.mix(df.where("false")).count() == 0
    clash = df.withColumns({"n_copies": F.lit("mine"), "rate": F.lit(7), "doc": F.lit("d"), "place": F.lit(0), "of_source": F.lit("o"), "__mix_n": F.lit(2)})
    got = mixing.mix(clash, epochs=50.0)
    assert got.columns == ["doc_id", "text", "source", "rate", "doc", "place", "of_source", "__mix_n", "copy_no", "n_copies", "shuffle_key"]
    rows = got.collect()
    assert len(rows) == rows[0]["n_copies"] > 1 and {(r["rate"], r["doc"], r["__mix_n"]) for r in rows} == {(7, "d", 2)}
    assert mixing.mix(clash, epochs=50.0, keep_draw=False).columns == clash.columns
    with pytest.raises(Exception, match="repetition rate"):
        mixing.mix(df, {"a": 1.0}, epochs=1000.0).collect()


def test_any_default_rate(spark):
    """Rates that follow from the corpus are drawn exactly, however large."""
    from decimal import Decimal, localcontext

    def exact(u, mean):
        with localcontext() as c:
            c.prec = 60
            k, p = 0, (-Decimal(mean)).exp()
            total = p
            while total <= Decimal(u):
                k += 1
                p *= Decimal(mean) / k
                total += p
            return k

    cases = [(u, mean) for mean in (0.3, 699.5, 700.5, 936.0, 1752.25, 20_000.0) for u in (1e-12, 0.001, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9)]
    got = spark.createDataFrame(cases, "u double, mean double").select("u", "mean", mixing.poisson_inverse(F.col("u"), F.col("mean")).alias("k")).collect()
    assert len(got) == len(cases) and all(r["k"] == exact(r["u"], r["mean"]) for r in got)
    rows = [(i, "x", "a") for i in range(3)] + [(9, "x", None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), epochs=1500.0).groupBy("doc_id").count().collect()
    mass = math.sqrt(3) + 1
    assert {r["doc_id"]: r["count"] for r in out} == {i: exact(draw(20, i), (math.sqrt(3) / 3 if s else 1.0) / mass * 4 * 1500) for i, _, s in rows}


def test_many_sources_are_shuffled(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x", f"s{i % 40}") for i in range(400)], "doc_id long, text string, source string")
    few = order(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 1)
    assert order(map(tuple, mixing.mix(df).collect())) == few


# pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    """Each stage against a plain version of it on the stage's own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(10_001, None, "en", "src1", 0), (10_002, "", None, None, 0), (10_003, "123 456", "en", "src1", 7), (None, "the and of to", "en", "src2", 13)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.where("doc_id = 3"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in P.STAGES:
        rows = now.collect()
        out, _ = common.written(stage(spark, now, str(tmp_path)), "stage")
        seen[name] = (rows, out.collect())
        if name != "tokenise":
            assert out.columns == list(P.DOC_COLUMNS)
        now = out
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "near_duplicates", "mix_sources", "tokenise"]

    rows, kept = seen["language_id"]
    ids = {r["doc_id"] for r in kept}
    assert {r["doc_id"] for r in rows} - ids >= {10_001, 10_002, 10_003}
    model = langid.train(spark.createDataFrame(rows, docs.schema))
    found = langid._Scorer(model).label([r["text"] for r in rows])
    ok = {r["doc_id"] for r, f in zip(rows, found, strict=True) if f[0] != "und" and f[1] >= P.MIN_LANGUAGE_SCORE}
    assert ids == ok and len(kept) == sum(r["doc_id"] in ok for r in rows)

    rows, kept = seen["quality_rules"]
    verdict = {r["doc_id"]: r["kept"] for r in fertility.quality(spark.createDataFrame(rows, docs.schema), queries.FERTILITY).collect()}
    assert order(map(tuple, kept)) == order(tuple(r) for r in rows if verdict[r["doc_id"]])

    rows, kept = seen["near_duplicates"]
    grams = {r["doc_id"]: set() for r in rows}
    for r in rows:
        w = r["text"].encode().lower().split()
        grams[r["doc_id"]] |= {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    place = {i: i for i in grams if i is not None}
    for a in sorted(place):
        for b in sorted(place):
            o = len(grams[a] & grams[b])
            if a < b and 100 * o >= 80 * (len(grams[a]) + len(grams[b]) - o):
                x, y = place[a], place[b]
                place = {k: (min(x, y) if v in (x, y) else v) for k, v in place.items()}
    assert len(rows) > len({r["doc_id"] for r in rows})  # a repeated row is one more copy, so one of its group stays
    assert all(r["doc_id"] is not None for r in rows)
    assert order(map(tuple, kept)) == order({tuple(r) for r in rows if place[r["doc_id"]] == r["doc_id"]})

    rows, kept = seen["mix_sources"]
    n = {}
    for r in rows:
        n[r["source"]] = n.get(r["source"], 0) + 1
    mass = sum(math.sqrt(v) for v in n.values())
    assert len({r["doc_id"] for r in rows}) == len(rows)
    expected = [tuple(r) for r in rows for _ in range(inverse(draw(20, r["doc_id"]), math.sqrt(n[r["source"]]) / mass * len(rows) / n[r["source"]]))]
    assert order(map(tuple, kept)) == order(expected)

    rows, coded = seen["tokenise"]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.BYTE_BPE)
    assert order((r["doc_id"], r["n_tokens"], list(r["ids"]), r["restored"]) for r in coded) == order((r["doc_id"], len(e), e, True) for r in rows for e in [lib.encode(r["text"], add_special_tokens=False).ids])
    assert order(map(tuple, P.run(spark, str(tmp_path)).collect())) == order(map(tuple, coded))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "restored"]


def test_pipeline_of_long_texts_and_clashing_names(spark, tmp_path):
    """Columns beside the five are not carried, whatever their names; a very long text goes through whole."""
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in P.quality_rules(spark, docs, "").orderBy("doc_id").limit(60).collect()]
    long = " ".join(texts * 40)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)] + [(900, long, "en", "a", len(long)), (901, None, None, None, None), (902, "", "en", "a", 0)]
    clash = {"row": F.lit(1), "kept": F.lit("x"), "component_id": F.lit(2), "node": F.lit(3), "n": F.lit(4), "lang_pred": F.lit("y"), "score": F.lit(0), "__mix_rate": F.lit(1)}
    spark.createDataFrame(rows, docs.schema).withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:3]:
        now, _ = common.written(stage(spark, now, str(tmp_path)), name)
        kept = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert now.columns == list(P.DOC_COLUMNS) and not kept & {901, 902}
    assert now.where("doc_id = 900").count() == (900 in kept)
    out = P.tokenise(spark, common.written(spark.createDataFrame(rows, docs.schema), "long")[0], "").where("doc_id = 900").first()
    assert out["restored"] and out["n_tokens"] > 100_000


def test_row_numbers_stay_whatever_the_splits(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    clash = {"file": F.lit("x"), "place": F.lit(1), "row": F.lit(2), "_metadata": F.lit("y")}
    docs.withColumns(clash).write.parquet(str(tmp_path / "a b%20c"))  # blanks and escapes in the path
    docs = spark.read.parquet(str(tmp_path / "a b%20c"))
    seen = []
    for cores, size in ((16, "128m"), (2, "20k"), (64, "1k")):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        seen.append({(r["row"], r["doc_id"], r["text"]) for r in P._numbered(docs).collect()})
    for name in ("leafNodeDefaultParallelism", "files.maxPartitionBytes", "files.openCostInBytes"):
        spark.conf.unset(f"spark.sql.{name}")
    assert seen[0] == seen[1] == seen[2] and len({r for r, _, _ in seen[0]}) == 200


def test_rows_of_null_and_shared_ids_are_judged_alone(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = [r for r in P.quality_rules(spark, docs, "").orderBy("doc_id").collect()][:3]
    a, b, c = (r["text"] for r in good)
    junk = "the and of to in"
    mixed = [(None, a, "en", "s", 1), (None, junk, "en", "s", 2), (20_001, b, "en", "s", 3), (20_001, junk, "en", "s", 4), (None, None, "en", "s", 5)]
    made = spark.createDataFrame(mixed, docs.schema)
    both, _ = common.written(docs.unionByName(made), "mixed")
    kept = [r["n_chars"] for r in P.quality_rules(spark, both, "").where("source = 's'").collect()]
    assert sorted(kept) == [1, 3]
    found = [r["n_chars"] for r in P.language_id(spark, both, "").where("source = 's'").collect()]
    assert 5 not in found and {1, 3} <= set(found)
    copies = [(None, a, "en", "s", 1), (None, a, "en", "s", 2), (None, b, "en", "s", 3), (7, b, "en", "s", 4), (9, b, "en", "s", 5), (8, c, "en", "s", 6), (8, a + " x", "en", "s", 7)]
    left = sorted(r["n_chars"] for r in P.near_duplicates(spark, common.written(spark.createDataFrame(copies, docs.schema), "copies")[0], "").collect())
    assert left == [4, 6, 7]
    again = [(3, a, "en", "s", 1), (3, a, "en", "s", 1), (3, a + " x", "en", "s", 2), (4, b, "en", "s", 3), (4, b, "en", "s", 3)]
    left = sorted(r["n_chars"] for r in P.near_duplicates(spark, common.written(spark.createDataFrame(again, docs.schema), "copies")[0], "").collect())
    assert len(left) == 2 and left[1] == 3
    with pytest.raises(ValueError):
        P.quality_rules(spark, made, "")


def test_registered_names():
    names = set(queries.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names}
    assert set(queries.oracle_sql()) <= names
