"""The pipeline against a brute-force version of its stages."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

LINE = "Shared footer line that appears in many of the documents"


def corpus():
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("aeioubcdfgklmnprst") for _ in range(r.randint(2, 8))) for _ in range(n))
    passage = prose(25)
    docs = {i: "\n".join(prose(r.randint(20, 40)) + "." for _ in range(r.randint(3, 6))) for i in range(40)}
    for i in range(8):
        docs[i] += "\n" + LINE
    docs[40], docs[41] = docs[20], docs[20] + "\n" + "extra"
    docs[42] = docs[21] + "\n" + passage
    docs[43] = "\n".join(" ".join(f"{prose(1).upper()}!!" for _ in range(40)) for _ in range(3))
    docs[44] = "too short"
    docs[45] = None
    return docs, {1: passage, 2: prose(12)}


def test_stages(spark, tmp_path):
    docs, bench = corpus()
    spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: t for i, t in docs.items() if not brute.quality(t)[-1] and i != 43}
    lined = brute.line_dedup(kept)
    groups = brute.components({i: brute.fingerprint(t) for i, t in lined.items()})
    single = {i: t for i, t in lined.items() if groups[i] == i}
    clean = {i: t for i, t in single.items() if not brute.contaminated(t, bench)[0]}
    assert 42 not in clean and 43 not in kept and len(single) < len(lined)
    sizes = {i: len(brute.words(t)) for i, t in clean.items()}
    assert {r["doc_id"] for r in found} <= set(clean)
    assert all(r["text"] == clean[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["size"] == sizes[r["doc_id"]] for r in found)
    by = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
    for source, rows in by.items():
        own = sum(n for i, n in sizes.items() if f"s{i % 4}" == source)
        assert rows[0]["source_size"] == own and abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1
    assert abs(sum(rows[0]["target"] for rows in by.values()) - 1.5 * sum(sizes.values())) < 1


def test_stages_name_their_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls, repeats, clashing names and an empty table pass every stage; all but the last keep the columns."""
    from test_llm_operators import SCHEMA, hard_rows

    spark.createDataFrame([(1, "a b c d e f g h i j k"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    hard = spark.createDataFrame(hard_rows(), SCHEMA).cache()
    for name, stage in corpus_pipeline.STAGES:
        for docs in (hard, hard.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert out.count() <= docs.count()
            if name != "mixing":
                assert out.columns == docs.columns


def test_unrelated_texts_under_one_id_stay(spark, tmp_path):
    """Null and repeated ids hold as many documents as they have texts; copies among them still keep one."""
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("aeioubcdfgklmnprst") for _ in range(6)) for _ in range(60))
    nulls, repeated, own = [text() for _ in range(30)], [text() for _ in range(30)], [text() for _ in range(10)]
    rows = [(None, t) for t in nulls] + [(7, t) for t in repeated] + [(100 + k, t) for k, t in enumerate(own)]
    rows += [(None, nulls[0]), (7, repeated[0]), (None, own[0]), (200, repeated[1]), (3, nulls[1])]
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path))
    want = [(None, t) for t in nulls[:1] + nulls[2:]] + [(3, nulls[1])] + [(7, t) for t in repeated] + [(100 + k, t) for k, t in enumerate(own)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_near_copies_equal_brute_force_jaccard(spark, tmp_path):
    """Copies with a few words changed are found down to similarity 0.8 of 5-word shingles, and less similar ones stay."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioubcdfgklmnprst") for _ in range(6))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(150)]
        texts.append(base)
        for edits in (1, 2, 3, 4, 6, 8):
            copy = list(base)
            for at in r.sample(range(150), edits):
                copy[at] = word()
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert 40 < len(want) < len(texts) // 2 + 60
    assert {row["doc_id"] for row in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == want
