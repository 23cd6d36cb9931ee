"""Token files, vector codes, importance resampling and the word hashes, against brute force and on hard rows."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import licenses, mixing, near_copies, quality_rules, resampling, secrets, substring_dedup, token_files, vector_codes, word_hashes

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
HARD = [None, "", " \t\n", "one", "<|endoftext|>a <|startoftext|>", "Σ ΑΣ ς́ é", "a b   c\x1cd\x85e", " ́x", "İstanbul it's 'S 12,5", "😀" * 9, "w" * 3000, "the The tHe " * 400]
#: Two words that a polynomial hash modulo 2^64 takes for one.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
EUHT = THUE.translate(str.maketrans("ab", "ba"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


# words


def test_colliding_words():
    def hashes(lower):
        return [h for _, h, _ in word_hashes.word_blocks(pa.array([f"{THUE} {EUHT} {THUE}", "x" * 5000, "y" + "x" * 4999]), lower)][0].tolist()

    h = hashes(False)
    assert h[0] == h[2] and len(set(h)) == 4 and hashes(True) == h


def test_words_are_told_apart():
    r = random.Random(5)
    words = list({"".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(20_000)})
    _, h, bounds = next(word_hashes.word_blocks(pa.array([" ".join(words), None, " \n".join(words)])))
    assert len(set(h.tolist())) == len(words) and (h[: len(words)] == h[len(words) :]).all() and bounds.tolist() == [0, len(words), len(words), 2 * len(words)]


def test_substrings_with_colliding_words(spark):
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{THUE} {rest}"), (2, f"{EUHT} {rest}"), (3, f"{EUHT}  {rest}\n"), (4, f"{rest} {THUE}")]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed) for r in out.collect()) == [(1, 0), (2, 0), (3, 20), (4, 0)]


def test_near_copies_with_colliding_words(spark):
    rows = [(1, THUE), (2, EUHT), (3, EUHT.upper()), (4, "a b c d"), (5, "a b c e")]
    out = near_copies.first_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4, 5]


# token files


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x0b\x1c\x85  ́̈'<|>aAeİΣσß19.,sSéÉÿÞ×÷Àœ«»"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_encoding_by_words_equals_whole_texts(texts):
    encoder = token_files.Encoder(PATH, True)
    got = []
    for _, ids, bounds in encoder(pa.array(texts, pa.string())):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [ids_of(x) for x in texts]


def token_rows(spark, rows, folder, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(3)
    token_files.write_token_files(df, folder, PATH, end_id=2, **options)
    return token_files.read_token_files(spark, folder)


@pytest.mark.parametrize("options", [{"by_words": True, "vocabulary": 49_408, "pack_bytes": 500}, {"by_words": False}], ids=["by words", "whole"])
def test_token_files_round_trip(spark, tmp_path, options):
    rows = [(i, t, "x", 1) for i, t in enumerate(HARD * 6)] + [(None, "lost", None, None), (None, None, "x", 2), (7, HARD[7], "x", 1), (-3, "first of all", "x", 1)]
    got = token_rows(spark, rows, str(tmp_path / "t"), **options).collect()
    known = sorted(((i, t) for i, t, *_ in rows if i is not None), key=lambda r: r[0])
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.id for r in by_start] == [None, None, *[i for i, _ in known]]
    before = 0
    for r in by_start:
        assert r.start == before and len(r.ids) == 4 * r.n_tokens
        before += r.n_tokens
    texts = dict(known)
    for r in by_start[2:]:
        assert np.frombuffer(r.ids, "<u4").tolist() == [*ids_of(texts[r.id]), 2]
    wanted = token_files.read_token_files(spark, str(tmp_path / "t"), wanted=[3, 40, 41, None, 999])
    assert sorted((r.id is not None, r.id or 0, r.start, bytes(r.ids)) for r in wanted.collect()) == sorted((r.id is not None, r.id or 0, r.start, bytes(r.ids)) for r in got if r.id in (3, 40, 41, None))


def test_token_files_need_their_dictionary(spark, tmp_path):
    rows = [(i, f"text {i} of some words {i * 7}", None, 1) for i in range(300)]
    token_rows(spark, rows, str(tmp_path / "a"), by_words=True, dictionary_bytes=1024).count()
    token_rows(spark, [(i, f"other {i}", None, 1) for i in range(300)], str(tmp_path / "b"), by_words=True, dictionary_bytes=1024)
    found = spark.read.parquet(str(tmp_path / "a" / "dictionary")).first()
    assert len(found.dictionary) > 0 and found.hash == hashlib.sha256(found.dictionary).hexdigest()
    spark.read.parquet(str(tmp_path / "b" / "packs")).write.parquet(str(tmp_path / "a" / "other"))
    (tmp_path / "a" / "packs").rename(tmp_path / "a" / "own")
    (tmp_path / "a" / "other").rename(tmp_path / "a" / "packs")
    with pytest.raises(Exception, match="dictionary"):
        token_files.read_token_files(spark, str(tmp_path / "a")).collect()


def test_token_files_of_nothing(spark, tmp_path):
    out = token_rows(spark, [], str(tmp_path / "t"), by_words=True)
    assert out.count() == 0 and out.columns == ["id", "start", "n_tokens", "ids"]


# vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """{id: (code, error)} and the codebooks of {id: vector}, in Python's whole numbers."""
    kept = {i: [math.floor(4096 * x) for x in v] for i, v in rows.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    own = len(next(iter(kept.values()))) // parts
    cut = {i: [tuple(v[p * own : (p + 1) * own]) for p in range(parts)] for i, v in kept.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut.values():
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for e, members in groups.items():
                books[p][e] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    found = {i: [near(v[p], books[p]) for p in range(parts)] for i, v in cut.items()}
    return {i: ([e for _, e in x], sum(d for d, _ in x)) for i, x in found.items()}, books


@pytest.mark.parametrize(("seed", "n"), [(1, 300), (2, 40), (3, 9)])
def test_codes_by_brute_force(spark, seed, n):
    r = random.Random(seed)
    # few values, so that distances tie
    rows = {i * 3: [float(np.float32(r.choice([-0.5, -0.25001, 0, 0.1, 0.25, 3.75]))) for _ in range(16)] for i in range(n)}
    rows |= {-1: None, 1: [0.5] * 15 + [None], 4: [0.5] * 15 + [float("nan")], 7: [float("-inf")] * 16}
    df = spark.createDataFrame([(i, v, "x", i % 3) for i, v in rows.items()], "vec_id long, embedding array<float>, code string, label int").repartition(3)
    coded, books = vector_codes.code_vectors(df)
    want, want_books = brute_codes(rows)
    assert {x.vec_id: (x.code, x.error) for x in coded.collect()} == want
    assert [[tuple(e) for e in b] for b in books.tolist()] == want_books


def test_nearest_equals_all_distances():
    r = np.random.default_rng(4)
    for size in (1, 2, 16):
        rows, book = r.integers(-3, 4, (500, 8)), r.integers(-3, 4, (size, 8))
        every = ((rows[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = vector_codes.nearest(rows, book)
        assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_codes_of_hard_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, `a.b` int, error string"
    rows = [(1, [0.5] * 10, None, 1, "x"), (1, [0.5] * 10, None, 1, "x"), (None, [0.25] * 10, 1, 1, "x"), (2, [1.0] * 9, 1, 2, "y"), (3, [], 1, 2, "y"), (4, [1e30] * 10, None, 2, "y"), (5, [-0.1] * 10, 1, 2, "y")]
    coded, books = vector_codes.code_vectors(spark.createDataFrame(rows, schema))
    out = vector_codes.with_label_errors(coded).collect()
    assert books.shape == (8, 4, 2) and len(out) == 7 and set(out[0].asDict()) == {"vec_id", "embedding", "label", "a.b", "code", "error", "label_error"}
    assert {(x.vec_id, x.error) for x in out if x.code is None} == {(2, None), (3, None), (4, None)}
    assert all(x.error == 0 for x in out if x.code is not None) and {x.label_error for x in out} == {0}
    empty, none = vector_codes.code_vectors(spark.createDataFrame([], schema))
    assert empty.count() == 0 and none.size == 0
    lost, _ = vector_codes.code_vectors(spark.createDataFrame([(1, None, 1, 1, "x")], schema))
    assert lost.count() == 0


# importance resampling


def grams(text):
    ws = "".join(c if c.isdigit() and c.isascii() or c.isalpha() and c.isascii() or ord(c) > 127 else " " for c in (text or "").translate({c: c + 32 for c in range(65, 91)})).split(" ")
    ws = [w for w in ws if w]
    return ws, [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute_ranks(docs, target, share=5, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, counts in ((docs.values(), s), (target, t)):
        for x in texts:
            for f in grams(x)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + buckets) / ((s[k] + 1) * (sum(t) + buckets)))) for k in range(buckets)]
    out = {}
    for i, x in docs.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in grams(x)[1])
        out[i] = [len(grams(x)[1]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in docs if len(grams(docs[i])[0]) >= least), key=lambda i: (-out[i][2], i))
    for k, i in enumerate(able[: share * len(able) // 100], 1):
        out[i][3] = k
    return {i: tuple(x) for i, x in out.items()}


def test_ranks_by_brute_force(spark):
    r = random.Random(8)
    words = ["été", "x", "日本", "a" * 300, "b" * 70_000, *[f"w{i}" for i in range(40)]]
    docs = {i: r.choice([" ", "-", "\n_"]).join(r.choice(words[2 * (i % 5) :] if i % 9 else words[5:]) for _ in range(r.choice([0, 1, 2, 3, 19, 20, 60]))) for i in range(200)} | {900: None, 901: "", 902: "ONE Two"}
    target = [" ".join(f"w{r.randint(30, 39)}" for _ in range(50)) for _ in range(5)] + [None, ""]
    rows = spark.createDataFrame([(i, x, "n", 1) for i, x in docs.items()], "doc_id long, text string, score string, id int").repartition(4)
    out = resampling.importance_ranks(rows, spark.createDataFrame([(x,) for x in target], "text string"), share=30)
    assert {x.doc_id: (x.n_features, x.weight, x.score, x.rank) for x in out.collect()} == brute_ranks(docs, target, 30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=600), min_size=1, max_size=6))
def test_composed_crcs(words):
    data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    last = np.cumsum(sizes)
    for n, found in enumerate(resampling.gram_crcs(resampling.word_crcs(data, last - sizes, last), sizes, 3), 1):
        assert found.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


def test_shifts_by_many_bytes():
    for n in (0, 1, 255, 256, 257, 70_001, 3_000_000):
        a = zlib.crc32(b"some")
        assert int(resampling.SHIFT(np.array([a], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b"z" * n) == zlib.crc32(b"some" + b"z" * n)


def test_ranks_of_hard_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text)] * 40 + [(None, text)] * 40 + [(2, None), (3, ""), (None, None)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(text,)], "text string")
    out = resampling.importance_ranks(docs, target, share=50).collect()
    assert len(out) == 83 and sorted(x.rank for x in out if x.rank) == list(range(1, 41)) and all(x.rank is None for x in out if x.n_features == 0)
    assert resampling.importance_sample(docs.where("doc_id IS NOT NULL").dropDuplicates(), target, share=100).count() == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.importance_ranks(empty, empty.select("text")).count() == 0
    assert resampling.importance_ranks(docs, empty.select("text")).count() == 83
    assert resampling.importance_ranks(docs.where(F.lit(False)), target).count() == 0


# mixing


@pytest.mark.parametrize("weights", [(0.25,), (1.0,), (0.25, 0.5, 0.7, 1.0), (1e-6, 1.0)])
def test_no_range_of_keys_is_heavy(spark, weights):
    bins, n = 64, 40_000
    r = random.Random(3)
    keys = spark.createDataFrame([(-math.log(r.random()) / r.choice(weights),) for _ in range(n)], "key double")
    most = keys.groupBy(mixing.key_range(F.col("key"), bins).alias("b")).count().agg(F.max("count")).first()[0]
    assert most <= 3 * 0.26 / bins * n


def test_null_ids_are_told_apart(spark):
    rows = [(None, " ".join(["word"] * (i % 17 + 1)) + f" t{i}", "a") for i in range(400)] + [(i, "x y z", "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix_sources(docs).collect()
    assert sorted((x.text, x.taken) for x in out) == sorted((x.text, x.taken) for x in mixing.mix_sources(docs.repartition(5)).collect())
    taken, goal = sum(x.taken for x in out if x.source == "a"), next(x.target for x in out if x.source == "a")
    assert goal - 1 < taken <= goal and all(0 <= x.taken <= 2 * x.size for x in out)


# licenses from files, formats of secrets

SHARED = Path("/usr/share/common-licenses")
LONG = ["Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"]


@pytest.mark.skipif(not all((SHARED / n).exists() for n in LONG), reason="no license texts here")
def test_whole_licenses_from_files(spark, tmp_path):
    """Whole long licenses, a word in twenty dropped or changed, wrapped anew, at any place of a text, are told by their names."""
    for n in LONG:
        (tmp_path / f"{n}.txt").write_text((SHARED / n).read_text())
    templates = licenses.read_templates(spark, str(tmp_path))
    assert sorted(templates) == sorted(LONG) and all(len(x.split()) > 900 for x in templates.values())
    r, docs = random.Random(6), {}
    for k in range(20):
        words = [w if r.random() > 0.05 else r.choice(["", "changed"]) for w in templates[LONG[k % 5]].split()]
        docs[k] = " ".join(f"before{i}" for i in range(r.randint(0, 400))) + "\n" + r.choice([" ", "\n"]).join(words) + " after" * r.randint(0, 90)
    docs[20] = " ".join(templates["GPL-3"].split()[:2000])
    out = licenses.scan_licenses(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4), templates)
    assert {x.doc_id: [s.license for s in x.licenses] for x in out.collect()} == {k: [LONG[k % 5]] for k in range(20)} | {20: []}
    with pytest.raises(ValueError, match="more than"):
        licenses.read_templates(spark, str(tmp_path), most=3)


def planted_formats():
    r = random.Random(21)
    some = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    base62, upper, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    make = {
        "base62": lambda: some(base62, 32),
        "access": lambda: "AKIA" + some(upper, 16),
        "hex": lambda: some(hexes, 40),
        "upper hex": lambda: some(hexes, 32).upper(),
        "uuid": lambda: "-".join(some(hexes, n) for n in (8, 4, 4, 4, 12)),
        "short": lambda: some(base62, 14),
    }
    syllables = ["ter", "na", "tion", "al", "ing", "con", "per", "ma", "lo", "gi", "cal", "un", "der", "stand"]
    plain = lambda: "".join(r.choice(syllables) for _ in range(r.randint(6, 9)))
    docs = {i: " ".join([*(plain() for _ in range(30)), f"token = {make['base62']()}", make["access"](), make["hex"]()]) for i in range(150)}
    planted = {}
    for i in range(1000, 1600):
        kind = list(make)[i % len(make)]
        key, words = make[kind](), [plain() for _ in range(20)]
        words.insert(r.randrange(20), key)
        docs[i], planted[i] = " ".join(words), (kind, key)
    return docs, planted


def test_planted_secrets_of_all_formats(spark):
    """Access keys and hex keys are base spans, all of them; other bare keys are learned spans. Keys of fewer than 16 characters aren't candidates."""
    docs, planted = planted_formats()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    told = {x.doc_id: {docs[x.doc_id][s["start"] : s["end"]] for s in x.spans} for x in secrets.scan_secrets(df).where("doc_id >= 1000").collect()}
    recall = {}
    for i, (kind, key) in planted.items():
        recall.setdefault(kind, []).append(key in told[i])
    recall = {k: sum(v) / len(v) for k, v in recall.items()}
    print(recall, sum(len(told[i] - {planted[i][1]}) for i in planted))
    assert recall["access"] == recall["hex"] == 1 and recall["base62"] >= 0.9
    assert sum(len(told[i] - {planted[i][1]}) for i in planted) <= 0.1 * len(planted)


# quality rules


def test_prose_that_mentions_stock_phrases(spark):
    """Prose on sites and accounts stays, whatever it mentions; menus, banners and footers go."""
    r = random.Random(9)
    words = [f"word{i}" for i in range(60)]
    prose = lambda end: " ".join([*r.choices(words, k=6), "people log in and write to each other", *r.choices(words, k=5)]) + end
    docs = {k: "\n".join(prose(r.choice([".", "?", ""]) if k % 2 else ".") for _ in range(12)) for k in range(40)}
    docs[100] = "\n".join(["Home", "Sign up", "Log in", " ".join(words), "About", "We use cookies, see our cookie policy and privacy policy to learn how", "Terms of use", "All rights reserved"])
    out = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert all(out[k].kept for k in range(40))
    assert sum(len(out[k].clean_text.split()) for k in range(0, 40, 2)) == sum(len(docs[k].split()) for k in range(0, 40, 2))
    assert out[100].clean_text == "\n".join(["Home", " ".join(words), "About"])


def test_texts_are_shuffled_once_with_hot_keys(spark, tmp_path):
    """Keys of many contents don't make substring dedup shuffle the texts a second time."""
    r = random.Random(8)
    phrase, rare = (" ".join(f"{name}{k}" for k in range(24)) for name in ("common", "rare"))
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(30)) + f" {phrase} {i} tail" + f" {rare} {i} end" * (i > 37)) for i in range(40)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = substring_dedup.dedup_substrings(spark.read.parquet(str(tmp_path / "docs")), hot_contents=2)
        removed = {row["doc_id"]: row["n_removed"] for row in out.collect()}
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert removed == {i: 24 * (i > 0) + 25 * (i > 38) for i in range(40)}  # "tail" stands before the rare passage in both


def test_fingerprints_propose_near_copies(spark):
    """Fingerprints equal brute force over blocks of any size, and link sets within two bits by the anchor cover."""
    r = np.random.default_rng(3)
    sets = [r.integers(0, 1 << 63, n, np.uint64) for n in (0, 1, 5, 70_000, 300, 0, 40)]
    found = near_copies.prints(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))))
    bit = lambda x, b: int(((x >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(x)
    assert [int(f) & (1 << 64) - 1 for f in found] == [sum(bit(x, b) << b for b in range(64)) for x in sets]
    nodes = spark.createDataFrame([(1, 10, 0), (2, 10, 3), (3, 10, 3), (4, 10, 1 << 40 | 1 << 50 | 7), (5, 0, 0), (6, 100, 1)], "node long, size long, fp long")
    assert {(x.a, x.b) for x in near_copies.print_pairs(nodes, 0.8).collect()} >= {(2, 3)}
    assert all(4 not in (x.a, x.b) and 5 not in (x.a, x.b) and 6 not in (x.a, x.b) for x in near_copies.print_pairs(nodes, 0.8).collect())
