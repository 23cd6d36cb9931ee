"""The splitters over whole tables against plain Python versions; what a query registers is compared as it is."""

import re

import pytest
from conftest import SMALL

from quillspark.plans import registry

SPACE = " \t\n\x0b\f\r"
LIMIT, TAIL = 800, 0.15


def packed(parts, limit, sep):
    out, now, size = [], "", 0
    for p in parts:
        if len(p) > limit:
            out += [now] * (size > 0) + [p[k : k + limit] for k in range(0, len(p), limit)]
            now, size = "", 0
        elif size and size + len(p) + len(sep) > limit:
            out.append(now)
            now, size = p, len(p)
        else:
            now, size = f"{now}{sep}{p}" if size else p, size + len(p) + len(sep)
    return out + [now] * (size > 0)


def with_tail(chunks, limit, sep):
    if len(chunks) > 1 and len(chunks[-1]) < limit * TAIL:
        return [*chunks[:-2], chunks[-2] + sep + chunks[-1]]
    return chunks


def filled(parts):
    return [p.strip(SPACE) for p in parts if p.strip(SPACE)]


def by_sentences(text):
    flat = re.sub(" {2,}", " ", re.sub(r"\n(?!\n)", " ", text))
    return with_tail(packed(filled(re.split(r"(?<=[.!?…])\s+", flat, flags=re.ASCII)), LIMIT, "\n"), LIMIT, "\n")


def by_paragraphs(text):
    parts = []
    for p in filled(text.split("\n\n")):
        parts += [p] if len(p) <= LIMIT else packed(filled(p.split("\n")), LIMIT, "\n")
    return with_tail(packed(parts, LIMIT, "\n\n"), LIMIT, "\n\n")


def by_headings(text):
    parts = []
    for s in filled(re.split(r"(?m)(?=^#{1,6} )", text.strip(SPACE))):
        parts += [s] if len(s) <= LIMIT else by_paragraphs(s)
    return with_tail(packed(parts, LIMIT, "\n\n"), LIMIT, "\n\n")


def by_windows(text):
    return re.findall(r"\S.{0,499}(?=\s|$)|\S{1,500}", text, flags=re.ASCII | re.DOTALL)


def marked(row):
    return f"# {row.source}\n\n" + row.text.replace("\n", "\n\n## part\n\n")


SPLITTERS = {"sentence_chunks": lambda r: by_sentences(r.text), "para_chunks": lambda r: by_paragraphs(r.text), "md_chunks": lambda r: by_headings(marked(r)), "text_windows": lambda r: by_windows(r.text)}


@pytest.mark.parametrize("name", SPLITTERS)
def test_chunks_of_all_documents(spark, name):
    got = {}
    for r in registry.queries()[name](spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append((r.position, r.chunk))
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        want = SPLITTERS[name](row) if row.text is not None else []
        assert [c for _, c in sorted(got.get(row.doc_id, []))] == want, row.doc_id


def ratio(a, b):
    """Twice the characters of the longest common blocks, taken from the longest on, over all characters."""

    def blocks(x, y):
        best = max(((k, -i, -j) for i in range(len(x)) for j in range(len(y)) if (k := next((n for n in range(min(len(x) - i, len(y) - j)) if x[i + n] != y[j + n]), min(len(x) - i, len(y) - j)))), default=(0, 0, 0))
        k, i, j = best[0], -best[1], -best[2]
        return k + blocks(x[:i], y[:j]) + blocks(x[i + k :], y[j + k :]) if k else 0

    return 2 * blocks(a, b) / max(1, len(a) + len(b))


def test_name_ratios_of_all_suppliers(spark):
    nations = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{SMALL}/nation.parquet").collect()}
    names = {r.s_suppkey: (r.s_name, nations[r.s_nationkey]) for r in spark.read.parquet(f"{SMALL}/supplier.parquet").collect()}
    got = {r.s_suppkey: r.ratio for r in registry.queries()["name_ratios"](spark, SMALL).collect()}
    assert got == {k: round(max(ratio(s.lower().strip(), p.strip().lower()) for p in f"{n}, {s}".split(",")), 6) for k, (s, n) in names.items()}
