"""The pipeline's stages, each against what its operator says of the stage's own input."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(str(folder / name))
        out = spark.read.parquet(str(folder / name))
        seen.append((name, docs, out))
        docs = out
    return {n: (a, b) for n, a, b in seen}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        assert name == "token_files" or after.columns == before.columns


def test_clean_documents_stay(stages):
    before, after = stages["language_id"]
    assert len(ids(after)) >= 0.99 * len(ids(before))


def test_one_of_each_near_copy_stays(stages):
    from tessera.llm import simhash

    before, after = stages["simhash_near_dedup"]
    assert ids(after) == sorted({r.component_id for r in simhash.near_duplicates(before).collect()})


def test_contaminated_documents_go(spark, stages):
    from tessera.llm import contamination

    before, after = stages["decontamination"]
    marked = contamination.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == ids(marked.where("not contaminated"))


def test_mixing_loses_no_document(stages):
    before, after = stages["mixing"]
    assert set(ids(after)) == set(ids(before)) and after.count() >= before.count()


def test_tokens_cover_the_mixture(stages):
    before, after = stages["token_files"]
    assert ids(after) == ids(before)
    rows = sorted(after.collect(), key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_odd_documents_pass_through(spark):
    rows = [(None, "an the on er ti an the on", "en", None, 1), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "the ann er ton ty ka lo", "en", "a", 9), (3, "the ann er ton ty ka lo", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES[1:]:
        assert f(spark, docs, SF).count() >= 1
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0


def test_null_and_repeated_ids_are_decided_per_row(spark):
    from tessera.llm import contamination

    other = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    rows = [(None, t) for t in other[:4]] + [(7, t) for t in other[4:7]] + [(None, other[0]), (7, other[4]), (8, other[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert sorted(kept.collect(), key=str) == sorted(spark.createDataFrame(rows[:7], docs.schema).collect(), key=str)

    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(2).collect()
    bad = " ".join(i.text for i in items)
    mixed = spark.createDataFrame([(None, bad), (7, bad), *rows[:7]], docs.schema)
    assert contamination.contamination(mixed, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 2
    kept = corpus_pipeline.drop_contaminated(spark, mixed, SF)
    assert sorted(kept.collect(), key=str) == sorted(spark.createDataFrame(rows[:7], docs.schema).collect(), key=str)


def brute_groups(texts, more=()):
    """Groups of indices linked by five-word Jaccard >= 0.8, or by the pairs given."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    close = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in [*close, *more]:
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    return group


@pytest.mark.parametrize("hot", [2, 8, 128])
def test_similar_shingle_sets_link_as_by_brute_force(spark, hot):
    import random

    from tessera.llm import jaccard
    from tessera.llm.components import components

    rnd, texts = random.Random(hot), ["", None, "one two", "one two", "one  TWO", "one"]
    line = " ".join(f"c{i}" for i in range(30))
    for size in (6, 20, 60, 200):
        base = [f"w{rnd.randrange(400)}" for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randrange(1 + size // 25)):
                w[rnd.randrange(size)] = f"x{rnd.randrange(9)}"
            texts.append(" ".join(w[rnd.randrange(1 + size // 20) :]) + (" " + line if rnd.random() < 0.3 else ""))
    docs = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "key string, text string")
    sets = spark.createDataFrame(jaccard.node_sets(docs, 5).collect(), "key string, node long, n int, prefix array<bigint>")
    root = {r.node: r.root for r in components(jaccard.links(docs, sets, 5, hot)).collect()}
    got = {r.key: root.get(r.node, r.node) for r in sets.collect()}
    want = brute_groups(texts, [(0, 1)])
    assert 10 < len(set(want)) < len(texts) - 10
    assert len({(got[f"{i:04d}"], g) for i, g in enumerate(want)}) == len(set(got.values())) == len(set(want))


def test_near_copies_by_five_words_go(spark, stages):
    from tessera.llm import simhash

    before, after = stages["simhash_near_dedup"]
    rows = sorted(before.select("doc_id", "text").collect())
    at = {r.doc_id: i for i, r in enumerate(rows)}
    more = [(at[r.doc_id], at[r.component_id]) for r in simhash.near_duplicates(before).collect()]
    assert ids(after) == [rows[i].doc_id for i in sorted(set(brute_groups([r.text for r in rows], more)))]


@pytest.mark.parametrize("hot", [2, 128])
def test_near_copies_link_by_either_rule_as_by_brute_force(spark, stages, hot):
    """Operator 3 without a distance: three-word fingerprints within two bits, or five-word similarity of 0.8."""
    from test_llm_operators import brute_fingerprint

    from tessera.llm import simhash

    rows = sorted(stages["simhash_near_dedup"][0].select("doc_id", "text").collect())
    rows += [(1000, None), (1001, ""), (1002, " \t "), (1003, "one two"), (1004, "one  TWO")]
    texts = [t for _, t in rows]
    fps = [brute_fingerprint(t) for t in texts]
    close = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = brute_groups(texts, close)
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, key string, node int")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, hot=hot).collect()}
    assert [got[i].component_id for i, _ in rows] == [rows[g][0] for g in want]
    assert [got[i].fingerprint for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert len(set(want)) < len(want) - 10


def test_documents_with_a_passage_of_any_one_item_go(spark):
    """Planted passages of eight words and more of single items, by brute force; nearly whole passages stay."""
    import re

    items = [i.text for i in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + 8]) for t in items for w in [words(t)] for i in range(max(1, len(w) - 7))}
    fill = lambda k: " ".join(f"fill{k}x{i}" for i in range(30))
    texts = [f"{fill(k)} {' '.join(words(t)[: 7 + k % 4])} {fill(k)}" for k, t in enumerate(items)] + [fill(i) for i in range(90, 99)]
    docs = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    dirty = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    kept = sorted(r.text for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect())
    assert kept == sorted(t for t in texts if not dirty(t)) and 9 < len(kept) < len(texts) - 9


def test_no_column_name_clashes(spark):
    """Every name that a stage or its operator uses inside, as a column of the caller's."""
    inner = ["_found0", "_key", "_key0", "_copy", "_copy0", "_id", "key", "node", "n", "prefix", "sketch", "fp", "tie", "_source", "_h", "_n", "_times", "_full", "_rest", "_blocks", "_cb", "_ck", "_ch", "_epoch", "_block", "_order", "weight", "tokens", "epochs", "k", "b", "h", "crops", "lang_pred", "score"]
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    rows = [(i % 6 or None, t, "en", "abc"[i % 3], 9, *[f"mine {i}"] * len(inner)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in inner))
    for name, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.collect()} == set(rows), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == len(rows)
    from tessera.llm import mixing

    assert mixing.mixed(docs, mixing.plan(docs, max_repeats=2.0)).columns == [*docs.columns, "__epoch", "__block", "__order"]


@pytest.mark.parametrize("swapped", [False, True])
def test_the_language_network_learns_from_every_labelled_text(spark, monkeypatch, swapped):
    """Two dialects stand in one long text each, which no hash of 200 documents a language takes; either label is learned."""
    import zlib

    from pyspark.sql import functions as F

    from tessera.llm import langid

    places = spark.range(4000).select("id", F.expr("pmod(xxhash64(cast(id as string)), 1L << 40)").alias("h")).orderBy("h").collect()
    usable = [r.id for r in places if zlib.crc32(str(r.id).encode()) % 4 != 2]
    last = usable[-2:]
    rows = [(i, "aba bab abba " * 9 if k % 2 else "cdc dcd cddc " * 9, "xy"[k % 2]) for k, i in enumerate(usable[:-2])]
    dialects = ["mno onm nomon mmo ", "rst tsr strst rrt "]
    long = ["".join(f"{d * (1 + i % 3)}{i} " for i in range(9000)) for d in dialects]
    labels = "yx" if swapped else "xy"
    rows += list(zip(last, long, labels))
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    used, plain = [], langid.predictor
    monkeypatch.setattr(langid, "predictor", lambda spark, model: used.append(model) or plain(spark, model))
    assert corpus_pipeline.keep_known_languages(spark, docs, SF).count() == len(rows)
    assert langid.predict_texts(used[0], ["aba bab abba " * 9, "cdc dcd cddc " * 9, *[d * 14 for d in dialects]])[0] == ["y", "x", *labels]


def test_the_language_network_is_the_same_however_rows_are_stored(spark):
    import numpy as np

    from tessera.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, usable = langid.train(docs, usable=langid.learnable()), langid.learnable()
    some = [langid.learn_all(d, first, usable=usable, group=300).weights() for d in (docs, docs.repartition(7), docs.orderBy("text"))]
    assert all(np.array_equal(some[0], x) for x in some[1:]) and not np.array_equal(some[0], first.weights())
    assert langid.learn_all(docs.limit(0), None) is None
    none = docs.withColumn("text", docs.text.substr(1, 0))
    assert np.array_equal(langid.learn_all(none, first).weights(), first.weights())


def test_halved_windows_hold_every_byte():
    import numpy as np

    from tessera.llm import langid

    windows, _ = langid.windows_of("".join(f"word{i} " for i in range(4000)) + "the end")
    got, labels = langid.halved(windows, np.arange(len(windows)), 5)
    assert len(windows) * 1.1 < len(got) < len(windows) * 1.3 and got.dtype == np.uint8
    whole = lambda rows: b"".join(r.tobytes().rstrip(b"\0") for r in rows)
    assert [whole(got[labels == i]) for i in range(len(windows))] == [whole(windows[i : i + 1]) for i in range(len(windows))]


def test_shingles_are_counted_over_all_rows(spark):
    """In 40,000 rows, five share a shingle and each has one of its own: the rarer one leads the order."""
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.llm import jaccard

    shared = F.concat(F.lit("f"), F.expr("id div 5"), F.lit(" a b c d"))
    texts = spark.range(40_000).select(F.col("id").cast("string").alias("key"), F.concat(shared, F.lit(" u"), F.col("id")).alias("text"))
    first = jaccard.node_sets(texts, 5).select(F.explode("prefix").alias("s")).groupBy("s").count().where("count > 1").agg(F.sum("count")).first()[0] or 0
    assert first < 0.02 * 40_000
    hashes = np.concatenate([jaccard.shingle_set(r.text, 5) for r in texts.collect()])
    assert np.array_equal(jaccard.frequency(texts, 5), np.bincount(jaccard.bucket_of(hashes), minlength=jaccard.COUNTED))
