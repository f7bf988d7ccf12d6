"""The training-data operators against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import chat, contamination, exact, htmltext, langid, mixing, secretscan, shards, simhash, tokenfile
from tessera.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, fp long, shard int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(r, n):
    return " ".join("".join(r.choice(["an", "the", "on", "er", "é", "ti"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, names that clash with the operators' own."""
    r = random.Random(4)
    texts = [text_of(r, r.randint(1, 60)) for _ in range(40)]
    rows = [(i, texts[i % 40] if i < 60 else text_of(r, 30), r.choice(["en", "fr"]), r.choice(["a", "a", "a", "b", None]), 1, "x", 5, 3) for i in range(90)]
    near = text_of(r, 120)
    rows += [(100 + i, near + " end" * i, "en", "a", None, None, None, None) for i in range(6)]
    rows += [(200, None, None, None, None, None, None, None), (201, "", "en", "b", 0, "", 0, 0), (202, " \t\n ", "en", "b", 0, "", 0, 0), (203, "1234 5678", "en", "b", 0, "", 0, 0), (None, "an the null id", "en", "b", 0, "", 0, 0)]
    rows += [(204, "one two", "en", "a", 0, "", 0, 0)] * 2
    rows += [(205, text_of(r, 40_000), "fr", "b", 0, "", 0, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b\\|<|x"), (1, 2, "assistant", None), (1, 3, "assistant", "<|im_end|><|im_start|>assistant ok\\"), (1, None, "sys\ntem\\n", "z<"), (2, 0, None, ""), (2, 0, None, ""), (None, 5, "assistant", "q" * 5000)]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "conv_id long, turn long, role string, text string, turns string, n_turns int")
    made = chat.format_chats(df)
    out = {r.conv_id: r for r in made.select("*", chat.parse(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in (1, 2, None):
        turns = sorted([((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert [(t.role, t.text) for t in out[conv].back] == [(b, c) for _, b, c in turns]
        assert out[conv].loss == "".join(c for _, b, c in turns if b == "assistant")
    assert out[1].formatted.count("<|im_start|>") == 3
    d = {r.conv_id: r for r in chat.digest(made).collect()}
    assert d[2].n_turns == 2 and d[2].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest()
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_exact_groups(docs, empty):
    got = exact.exact_groups(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict = {}
    for i, t in plain(docs):
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    assert len(got) == docs.count()
    for r in got:
        members = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (min(members)[3], len(members))
    assert sum(r.kept for r in got) == len(groups)
    assert exact.exact_groups(empty).count() == 0


def test_exact_groups_survive_hash_collisions(docs):
    forced = exact.exact_groups(docs, content_hash=lambda c: F.substring(F.md5(c), 1, 2))
    key = lambda r: (str(r.doc_id), r.keep_id or -1, r.kept, r.text_sha256)
    assert sorted(map(key, forced.collect())) == sorted(map(key, exact.exact_groups(docs).collect()))


def test_decontamination_matches_brute_force(spark, docs, empty):
    texts = [t for _, t in plain(docs) if t]
    items = [(1, " ".join(texts[0].split()[:9])), (2, texts[1].upper()), (3, "one, TWO!"), (4, ""), (5, None), (6, "never seen words at all in any of these documents"), (1, texts[3]), (8, texts[3]), (None, texts[2]), (7, " ".join(texts[-1].split()[100:108]))]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n_words int")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for a in range(max(1, len(w) - 7)):
                windows.setdefault(tuple(w[a : a + 8]), set()).add(i)

    def judge(t):
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                own = windows.get(tuple(w[a : a + n]))
                if own:
                    hit.update(range(a, a + n))
                    found |= own
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2

    want = sorted((str(i), *judge(t)) for i, t in plain(docs))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination.contamination(docs, bench).collect())
    assert got == want and any(w[5] for w in want)
    small = contamination.BLOCK_BYTES
    try:
        contamination.BLOCK_BYTES = 200  # several blocks of items
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination.contamination(docs, bench).collect()) == want
    finally:
        contamination.BLOCK_BYTES = small
    assert contamination.contamination(empty, bench).count() == 0
    assert not any(r.n_items for r in contamination.contamination(docs, bench.limit(0)).collect())


def test_proximity_matches(spark):
    d = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, "aa xx bb cc"), (3, "cc bb aa"), (4, "aa bb xx yy zz cc")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "aa bb cc")], "item_id long, text string")
    near = lambda slop: {r.doc_id for r in contamination.search(contamination.build_index(d), b, 3, slop).collect() if r["items"]}
    assert near(0) == {1} and near(1) == {1, 2} and near(3) == {1, 2, 3, 4}


def brute_fingerprint(t):
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOW)) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(ids, fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    out = []
    for i in range(len(fps)):
        own = [ids[j] for j in range(len(fps)) if find(j) == find(i) and ids[j] is not None]
        out.append(min(own) if own else None)
    return out


@pytest.mark.parametrize(("distance", "parts", "hot"), [(2, 3, 128), (2, 2, 2), (1, 2, 1), (0, 2, 128)])
def test_simhash_matches_brute_force(docs, distance, parts, hot):
    pairs = plain(docs)
    fps = [brute_fingerprint(t) for _, t in pairs]
    want = sorted((str(i), f"{f:016x}", str(c)) for (i, _), f, c in zip(pairs, fps, classes_of([i for i, _ in pairs], fps, distance)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs, distance=distance, parts=parts, hot=hot).collect())
    assert got == want


def test_op3_links_by_fingerprints_alone(spark, tmp_path):
    """Texts with almost the same shingles, but fingerprints more than two bits apart, are not one component."""
    from tessera.llm.queries import op3_simhash_dedup

    r = random.Random(7)
    texts = []
    for _ in range(4):
        words = text_of(r, 300).split()
        texts += [" ".join(words), " ".join(words[:150] + ["changed"] + words[151:]), " ".join(words)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fps = [brute_fingerprint(t) for t in texts]
    assert any((fps[i] ^ fps[i + 1]).bit_count() > 2 for i in range(0, len(fps), 3))
    want = [(i, f"{f:016x}", c) for i, f, c in zip(range(len(fps)), fps, classes_of(list(range(len(fps))), fps, 2))]
    assert sorted(tuple(row) for row in op3_simhash_dedup(spark, str(tmp_path)).collect()) == want


def test_links_of_dense_fingerprints(spark):
    r = random.Random(1)
    centre = r.getrandbits(64)
    fps = sorted({centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)} | {r.getrandbits(64) for _ in range(150)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for hot in (4, 1000):
        got = {x.node: x.root for x in components(simhash.links(df, 2, 3, hot)).collect()}
        want = classes_of(signed, fps, 2)
        assert [got.get(s, s) for s in signed] == want


def test_simhash_of_an_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_long_texts_are_taken_in_pieces():
    t = text_of(random.Random(2), 4000)
    small = simhash.PIECE
    try:
        simhash.PIECE = 97
        assert simhash.fingerprint(t, 3) == brute_fingerprint(t)
        assert simhash.fingerprint("a" * 500, 3) == brute_fingerprint("a" * 500)
    finally:
        simhash.PIECE = small


def test_shards(docs, empty):
    got = shards.kd_shards(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert {(str(r.doc_id), r["size"], r.text_crc32) for r in got} == {(str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in plain(docs)}
    assert shards.kd_shards(empty).count() == 0


def test_shards_are_near_equal_with_one_hot_text(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.repeat(F.lit("x "), (F.col("id") % 97).cast("int"))).alias("text"))
    sizes = [r.b for r in shards.kd_shards(df).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 4 * 195


def test_mixing_solves_and_realises(docs, empty):
    tokens = [1000, 100, 10]
    a = mixing.solve(tokens, max_repeats=3.0)
    w = mixing.tempered(tokens, a)
    reps = [x / t for x, t in zip(w, tokens)]
    assert abs(max(reps) / min(reps) - 3) < 1e-6
    e = mixing.solve(tokens, target_entropy=0.9)
    assert abs(mixing.entropy(mixing.tempered(tokens, e)) - 0.9) < 1e-6
    plan = mixing.plan(docs, max_repeats=2.0, block_tokens=50)
    rows = mixing.mixed(docs, plan).collect()
    n = {str(i): len((t or "").split()) for i, t in plain(docs)}
    for p in plan.collect():
        mine = [r for r in rows if (r.source if r.source is not None else "\x00") == p["_source"]]
        total, most = sum(n[str(r.doc_id)] for r in mine), max([n[str(r.doc_id)] for r in mine], default=0)
        assert p.target_tokens - most <= total <= p.target_tokens or p.tokens == 0
    assert {str(r.doc_id) for r in rows} == set(n)
    assert mixing.mixed(empty, mixing.plan(empty, max_repeats=2.0)).count() == 0
    assert mixing.mixed(docs, mixing.plan(docs, max_repeats=2.0, budget=500)).count() < docs.count()


def test_language_id(spark, docs, empty):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(real, usable=langid.learnable())
    got = langid.identify(real, model).join(real.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (200, 201, 202, 203))
    assert langid.train(empty) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_words_encode_as_whole_texts_do(tokenizer):
    """Pieces of scripts, punctuation and marks in random order: the word-wise ids equal the library's."""
    from tokenizers import Tokenizer

    pools = ["abcXYZ 019.,!?'\"-_()<>|[]{}&#@\n\t", "\u00e9\u00fc\u00df\u0130\u0131\u017f\u03a3\u03c2 ab'.", "\u65e5\u672c \ud55c\u1100\uac00 ", "\u0323\u0301\u1ab0\u05b8\u200d\ufeff a.", "\U0001f600\U0001f3fd a.", "\u00a0\u2028\x85\x1c\x0b a.b", "\ufb01\u00bd\u00b2\u01c5 a1.", "'s't're I'm they'll ", "\u2019\u2018\u201c\u201d\u2013\u2026 ab'."]
    rng = random.Random(7)
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 24))) for _ in range(6000)] + ["\u2019, 'quoted'. a3\u2026. 6\u2019& \u0130."]
    library, coder = Tokenizer.from_file(tokenizer), tokenfile.Encoder(tokenizer)
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [b for a in range(0, len(texts), 50) for b in coder.encode(texts[a : a + 50])] == want


def test_token_files_round_trip(docs, empty, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    files = tokenfile.write_token_files(docs, tokenizer, 1)
    got = sorted(tokenfile.read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))
    assert [r.doc_id or -1 for r in got] == sorted(i if i is not None else -1 for i, _ in plain(docs)) or got[0].doc_id is None
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, x in plain(docs)}
    assert all((r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes())) for r in got)
    tokenfile.export(files, str(tmp_path))
    assert sum(len(tokenfile.read_image(p.read_bytes())[2]) for p in tmp_path.iterdir()) == sum(r.n_tokens for r in got)
    assert tokenfile.read_token_files(tokenfile.write_token_files(empty, tokenizer, 1)).count() == 0


def test_encoder_agrees_with_the_library(tokenizer):
    coder = tokenfile.Encoder(tokenizer, held=50)
    odd = ["", "it's O'NEIL's", "<|endoftext|> x<|startoftext|>", "áë Éİ Å", "x\x1cy\x85z w", "don't!!!... #$% a,b", "日本語 テスト12３", "ǅ ß ﬁ Σας", "e=mc^2 (a)[b]{c}<d>", "'s 't'll", "naïve-café's", "İI"]
    for t in odd * 2:
        assert np.frombuffer(coder.encode([t])[0], "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_simple8b():
    r = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 1000):
        for top in (1, 2, 300, 49_408, 1 << 40):
            x = np.where(r.random(n) < 0.5, r.integers(0, top + 1, n), 0).astype(np.uint64)
            assert (tokenfile.unpack(tokenfile.pack(x), n) == x).all()
    with pytest.raises(ValueError):
        tokenfile.pack(np.array([1 << 60], dtype=np.uint64))


def test_html_extraction(spark):
    real = spark.read.parquet(f"{SF}/pages.parquet")
    wrong = 0
    for r, got in zip(rows := real.orderBy("page_id").collect(), htmltext.extract(real).orderBy("page_id").collect()):
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        wrong += " ".join(b[1] for b in htmltext.leaf_blocks(article)) != got.text
        assert got.n_chars == len(got.text)
    assert wrong <= len(rows) // 50
    kinds = [(1, "u", None), (2, "u", ""), (3, None, "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"), (3, None, "no tags"), (4, "u", "<div class='ad'>buy</div><article><h1>A &amp;amp; b</h1><p>one<b>two</b>\n three<script>x<p></script></article><section class='comments'><p>me too</p></section>")]
    out = htmltext.extract(spark.createDataFrame([(*k, "t") for k in kinds], "page_id long, url string, html string, text string")).collect()
    assert sorted(r.page_id for r in out) == [1, 2, 3, 3, 4]
    assert {r.page_id: r.text for r in out}[4] == "A &amp; b onetwo three"
    assert all(r.text == "" for r in out if r.page_id in (1, 2))


def test_long_pages_carry_state_across_chunks():
    model = htmltext.trained()
    page = "<nav><a href='/'>x</a></nav><article>" + "<p>some words of text here, and more.</p>" * 60 + "</article><footer>end</footer>"
    blocks = htmltext.leaf_blocks(page)
    x, mask, _ = htmltext.padded([(htmltext.block_vectors(blocks, 0, len(blocks), {}), np.zeros(len(blocks)))])
    small = htmltext.CHUNK
    try:
        htmltext.CHUNK = 7
        assert np.allclose(model.long_scores(blocks, {}), model.scores(x, mask)[0], atol=1e-5)
    finally:
        htmltext.CHUNK = small


def test_secret_scan(spark, docs, empty):
    forest = secretscan.trained()
    x, y = secretscan.labelled_findings(500, seed=77)
    assert np.mean((forest.predict(x) >= 0.5) == y) >= 0.95
    key, sha = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'é token = "{key}" end', "src"), (2, f"see commit {sha} for it", "docs"), (3, "password = changeme123", None), (4, None, None), (5, "", "x"), (1, f'é token = "{key}" end', "src")]
    out = secretscan.scan(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, kind string"), forest).collect()
    assert sorted((r.doc_id, r.is_secret) for r in out) == [(1, True), (1, True), (2, False), (3, False)]
    assert next(r for r in out if r.doc_id == 1).start == 11
    assert secretscan.redact(rows[0][1], [(11, 51)]) == 'é token = "[secret]" end'
    assert secretscan.scan(empty, forest).count() == 0
    secretscan.scan(docs, forest).count()


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))).count() == 0


def test_words_of_one_hash_stay_apart(spark):
    """Thue-Morse words: equal under any polynomial hash modulo a power of two, different in their bytes."""
    s = "a"
    for _ in range(11):
        s = "".join({"a": "ab", "b": "ba"}[c] for c in s)
    other = s.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(1, f"x {s} y"), (2, f"x {other} y"), (3, f"{other} {s}")], "doc_id long, text string")
    b = spark.createDataFrame([(7, other)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in contamination.contamination(d, b).collect()}
    assert got == {1: (3, 0, 0), 2: (3, 1, 1), 3: (2, 1, 1)}


def test_word_tables_of_long_texts_in_pieces():
    r = random.Random(6)
    texts = ["".join(r.choice("abC 1,\u00e9\n\u65e5") for _ in range(r.randrange(60))) for _ in range(100)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    usual = contamination.PIECE
    try:
        for contamination.PIECE in (usual, 7, 50):
            per_text, term, counts, terms = contamination.word_table(texts)
            assert [terms[i].decode() for i in term] == [x for t in texts for x in words(t)]
            assert per_text.tolist() == [len(words(t)) for t in texts] and counts.sum() == len(term)
    finally:
        contamination.PIECE = usual


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, library = tokenfile.Encoder(path), Tokenizer.from_file(path)
    texts = ["Hello  World, it's \n\n new", "an the\ton ", "", "日本語 é!"]
    assert not coder.by_words
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_remembered_words_are_bounded_by_bytes(tokenizer):
    coder = tokenfile.Encoder(tokenizer, most_bytes=20_000)
    r = random.Random(9)
    texts = ["".join(r.choice("abcdef") for _ in range(int(r.choice([5, 30, 5000])))) for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [coder.tokenizer.encode(t).ids for t in texts]
    assert coder.bytes < 20_000 + 10_000 and all(len(w) <= tokenfile.LONGEST for w in coder)


def test_new_short_words_are_merged_together(tokenizer):
    """Words not seen before cost no call of the library each, whatever marks and accents they carry."""
    r = random.Random(10)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz\u00e9\u00fc\u0142") for _ in range(r.randint(1, 8))) + r.choice(["", ",", ".)", "'s", "-4", "!"]) for _ in range(5000)]
    texts = [" ".join(words[a : a + 50]) for a in range(0, 5000, 50)]
    coder, calls = tokenfile.Encoder(tokenizer), []
    pieces, whole = coder.pieces, coder._direct
    coder.pieces, coder._direct = lambda w: calls.append(w) or pieces(w), lambda t: calls.append(t) or whole(t)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [coder.tokenizer.encode(t).ids for t in texts]
    assert len(calls) < 50


def test_short_words_in_few_slots_and_parts(tokenizer, monkeypatch):
    """Pieces that share slots, a pool that runs over, and texts cut into parts give the library's ids."""
    monkeypatch.setattr(tokenfile, "TOGETHER", 300)
    r = random.Random(11)
    pools = ["abcdeABC", "aaab", "ab'", "'s't're've'm'll'd'", "0123 a", "\u00e9\u00c9\u0130\u01c5\u0149\u023a\u00df\u0142\u00aa", "-._'\"", "\u00ab\u00a0\u00b2\u65e5\x1c\x00\x7f a", " \n\t"]
    some = lambda n: "".join(r.choice(r.choice(pools)) for _ in range(n))
    texts = [some(r.choice([0, 3, 14, 15, 16, 17, 40, 400, 2000])) for _ in range(1500)] + ["".join(r.choice("abc") for _ in range(n)) for n in range(1, 40)] + ["x" * 1000 + " y", " " * 900, "aaaa'lla'rea're'", "''s 's's '5 'S"]
    coder = tokenfile.Encoder(tokenizer, most_bytes=5_000)
    want = [np.array(coder.tokenizer.encode(t).ids, dtype="<u4").tobytes() for t in texts]
    assert [x for a in range(0, len(texts), 40) for x in coder.encode(texts[a : a + 40])] == want
    assert coder.encode(texts[::-1]) == want[::-1]
    assert len(coder.pool) == 4 << coder.bits and coder.used <= len(coder.pool)


def test_models_with_more_than_merges_encode_whole_texts(tokenizer, tmp_path):
    import json

    with open(tokenizer, encoding="utf-8") as f:
        said = json.load(f)
    said["model"]["ignore_merges"] = True
    (path := tmp_path / "t.json").write_text(json.dumps(said), encoding="utf-8")
    coder = tokenfile.Encoder(str(path))
    assert not coder.by_words and np.frombuffer(coder.encode(["Hello, it's"])[0], "<u4").tolist() == coder.tokenizer.encode("Hello, it's").ids


def test_training_reads_windows_of_whole_texts(spark):
    """A language that shows itself only behind 10,000 characters of another's is still learned."""
    rows = [(i, "zz zz qq " * 1200 + ("vvv kkk jjj " if i % 2 else "ooo eee aaa ") * 2000, "xy"[i % 2]) for i in range(300)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.predict_texts(model, ["vvv kkk jjj " * 30, "ooo eee aaa " * 30])
    assert got[0] == ["y", "x"]


def test_long_conversations_take_linear_time(spark):
    import time

    n = 16_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("\u00e9<| text \\ "), F.repeat(F.lit("word "), 10), F.col("id")).alias("text"))
    chat.digest(chat.format_chats(df.limit(10))).collect()
    began = time.time()
    got = chat.digest(chat.format_chats(df)).first()
    assert time.time() - began < 10
    loss = "".join(f"\u00e9<| text \\ {'word ' * 10}{i}" for i in range(n) if i % 3)
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def brute_medians(rows, depth, dims):
    """The k-d tree in plain Python: rows are (size, key by dimension, value by dimension); returns the leaf of each."""
    spread = {d: max(1, max(r[2][d] for r in rows) - min(r[2][d] for r in rows)) for d in dims}
    nodes = {1: list(range(len(rows)))}
    for level in range(depth):
        below = {}
        for n, own in nodes.items():
            width = {d: (max(rows[i][2][d] for i in own) - min(rows[i][2][d] for i in own)) if own else 0 for d in dims}
            d = max(dims, key=lambda c: (width[c] / spread[c], c))
            by, upto, cut = sorted(own, key=lambda i: rows[i][1][d]), 0, 0
            total = sum(rows[i][0] for i in own)
            for i in by:  # the least key with over half of the bytes at or below it
                upto += rows[i][0]
                if 2 * upto > total:
                    cut = rows[i][1][d]
                    break
            below[2 * n] = [i for i in own if rows[i][1][d] < cut]
            below[2 * n + 1] = [i for i in own if rows[i][1][d] >= cut]
        nodes = below
    return {i: n - (1 << depth) for n, own in nodes.items() for i in own}


def test_shards_split_at_weighted_medians_of_the_widest_dimension(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    key = real.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), *[shards._dimension(real, d).alias(f"d{i}") for i, d in enumerate(("lang", "n_chars"))])
    key = key.withColumn("d_crc", F.shiftrightunsigned("text_crc32", 1))
    dims = ["size", "d_crc", "d0", "d1"]
    rows = key.select("doc_id", "size", F.struct(*[shards._key(d).alias(d) for d in dims]).alias("k"), F.struct(*dims).alias("v")).orderBy("doc_id").collect()
    want = brute_medians([(r["size"], r.k, r.v) for r in rows], 4, dims)
    got = {r.doc_id: r.shard for r in shards.kd_shards(real).collect()}
    assert got == {r.doc_id: want[i] for i, r in enumerate(rows)}
    whole = sum(r["size"] for r in rows)
    for target in (whole, whole // 3, whole // 20):
        sizes = [r.b for r in shards.kd_shards(real, target_bytes=target).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
        assert max(sizes) <= target + max(r["size"] for r in rows) and len(sizes) == 1 << max(0, -(-whole // target) - 1).bit_length()


def test_mixing_cuts_its_permutations_as_by_brute_force(spark, docs):
    """Every source's last epoch is the longest run of its permuted documents that its budget holds."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {p["_source"]: p for p in mixing.plan(real, max_repeats=2.0, block_tokens=300).collect()}
    rows = mixing.mixed(real, mixing.plan(real, max_repeats=2.0, block_tokens=300)).collect()
    keys = real.withColumn("_h", F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")))))
    cut = 0
    for source, p in plan.items():
        own = keys.where(F.coalesce("source", F.lit("\x00")) == source)
        in_epoch = lambda e, o=own: [(r.k, r._h, r.doc_id, len((r.text or "").split())) for r in o.select("doc_id", "text", "_h", mixing._key(F.lit(e), 17).alias("k")).collect()]
        mine = [r for r in rows if (r.source if r.source is not None else "\x00") == source]
        for epoch in range(p.epochs + 1):
            held, want = 0, {}
            for k, _, i, n in sorted(in_epoch(epoch)):
                held += n
                if epoch == p.epochs and (held > p.rest or p.rest <= 0):
                    break
                want[i] = k * p.blocks >> mixing.KEY_BITS
            assert {r.doc_id: r._block for r in mine if r._epoch == epoch} == want
            cut += epoch == p.epochs and 0 < len(want) < own.count()
        for block in {(r._epoch, r._block) for r in mine}:
            assert len({r._order for r in mine if (r._epoch, r._block) == block}) == 1
    assert cut
