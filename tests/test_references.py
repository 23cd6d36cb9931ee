"""Cases of cited publications, repairs and footnote numbers that the tables do not show."""

from pyspark.sql import functions as F

from quillspark.operators import books, publications


def test_hard_citations(spark):
    text = "x https://doi.org/10.1/short, https://doi.org/10.1000/A(1)b.\r\nsame doi:10.1000/a(1)b;\nhttps://pubmed.ncbi.nlm.nih.gov/12/10.1234/y PMC9"
    chunks = spark.createDataFrame([(1, 1, text), (1, 2, None), (1, 3, ""), (1, 1, text)], "document_id int, chunk_id int, text string")
    got = {(r.kind, r.identifier, r.citation) for r in publications.cited(chunks).collect()}
    # brackets end an address, but not a DOI; repeated chunks count once
    assert got == {("doi", "10.1000/a(1", "x https://doi.org/10.1/short, https://doi.org/10.1000/A(1)b."), ("doi", "10.1000/a(1)b", "same doi:10.1000/a(1)b;"), ("pmid", "12", "https://pubmed.ncbi.nlm.nih.gov/12/10.1234/y PMC9")}
    assert publications.cited(chunks.limit(0)).count() == 0


def test_empty_refresh_drops_links(spark):
    stored = spark.createDataFrame([("a", None, None, "10.1000/x", "u")], "id string, pmid string, pmcid string, doi string, canonical_url string")
    links = spark.createDataFrame([(1, "a", 7, "c"), (2, "a", 8, "c")], "document_id int, publication string, chunk_id int, citation string")
    chunks = spark.createDataFrame([(1, 9, None)], "document_id int, chunk_id int, text string")
    left = lambda whole: sorted(r.document_id for r in publications.refresh_publications(stored, links, chunks, whole)[1].collect())
    assert left(True) == [2] and left(False) == [1, 2]


def test_markers(spark):
    def of(text, n):
        return tuple(spark.range(1).select(books.without_markers(F.lit(text), F.lit(n)).alias("w")).select("w.*").first())

    assert of("a1 b2 Atomic17 c3", 3) == ("a b Atomic17 c", 3)
    assert of("1 a2 b1", 2) == ("1 a2 b", 1)
    assert of("żółć1. słowo_2, log4j x1234 IPv4", 2) == ("żółć. słowo_, log4j x1234 IPv4", 2)
    assert of("a1 a1 a01", 1) == ("a a1 a01", 1)
    assert of("", 1) == ("", 0)


def test_books_without_notes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no heading1"), (4, "  \n# A\nx1\n\n")], "book int, text string")
    notes = spark.createDataFrame([(3, 1, 1), (4, 1, 1), (4, 2, 5), (4, 1, None)], "book int, position int, n int")
    got = {r.book: (r.text, len(r.report)) for r in books.strip_footnote_markers(df, notes).collect()}
    assert got == {1: (None, 0), 2: ("", 0), 3: ("no heading1", 0), 4: ("  \n# A\nx\n\n", 1)}
