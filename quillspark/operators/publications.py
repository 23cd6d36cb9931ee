"""Scholarly publications that texts cite, and their links to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: How the three kinds of identifiers stand in addresses, and a DOI outside of them; the addresses that stand for each.
PMC = r"(?i)(?:pmc\.ncbi\.nlm\.nih\.gov/articles/|ncbi\.nlm\.nih\.gov/pmc/articles/)(PMC\d+)"
PMID = r"(?i)(?:pubmed\.ncbi\.nlm\.nih\.gov/|ncbi\.nlm\.nih\.gov/pubmed/)(\d+)"
DOI = r"(?i)(?:doi\.org/|\bdoi\s*:\s*)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
ADDRESS = r"(?i)https?://[^\s<>\])]+"
KINDS = {"pmcid": ("https://pmc.ncbi.nlm.nih.gov/articles/", "/"), "pmid": ("https://pubmed.ncbi.nlm.nih.gov/", "/"), "doi": ("https://doi.org/", "")}


def _item(kind: str, value: Column) -> Column:
    before, after = KINDS[kind]
    return F.struct(F.lit(kind).alias("kind"), value.alias("identifier"), F.concat(F.lit(before), value, F.lit(after)).alias("canonical_url"))


def cited_in_line(line: Column) -> Column:
    """(kind, identifier, canonical_url) of what a line cites by address, PMC before PubMed before DOI, and by "doi:"; each once."""
    doi = lambda c: F.lower(F.rtrim(c, F.lit(".,;:")))
    first = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))

    def of(address: Column) -> Column:
        pmc, pmid, named = F.upper(first(address, PMC)), first(address, PMID), doi(first(address, DOI))
        return F.when(pmc.isNotNull(), _item("pmcid", pmc)).when(pmid.isNotNull(), _item("pmid", pmid)).when(named.isNotNull(), _item("doi", named))

    addresses = F.transform(F.regexp_extract_all(line, F.lit(ADDRESS), F.lit(0)), lambda a: of(F.rtrim(a, F.lit(".,;:"))))
    loose = F.transform(F.regexp_extract_all(line, F.lit(DOI), F.lit(1)), lambda d: _item("doi", doi(d)))
    return F.array_distinct(F.filter(F.concat(addresses, loose), lambda x: x.isNotNull()))


def cited(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, kind, identifier, canonical_url, citation) of chunks (document_id, chunk_id, text): each identifier once a chunk, with the last line that names it.

    Null and empty texts cite nothing. Lines leave the texts as narrow rows, only those that can cite.
    """
    lines = chunks.select("document_id", "chunk_id", F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike("(?i)https?://|doi"))).alias("at", "line"))
    found = lines.select("document_id", "chunk_id", "at", strip(F.col("line")).alias("line"), F.explode(cited_in_line(F.col("line"))).alias("f"))
    last = found.groupBy("document_id", "chunk_id", "f.kind", "f.identifier").agg(F.max(F.struct("at", F.col("f.canonical_url").alias("url"), "line")).alias("l"))
    return last.select("document_id", "chunk_id", "kind", "identifier", F.col("l.url").alias("canonical_url"), F.col("l.line").alias("citation"))


def refresh_publications(publications: DataFrame, links: DataFrame, chunks: DataFrame, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """publications (id, pmid, pmcid, doi, canonical_url) and links (document_id, publication, chunk_id, citation) after chunks (document_id, chunk_id, text) were read anew.

    Publications are known by any of their identifiers, whatever the case of PMC numbers and DOIs; others are added once, under
    kind:identifier as id. If one identifier is in several rows, the least id counts. With whole=True all links of the documents
    of chunks go first, else only those of these chunks. A publication is linked to a document once, from the first of the chunks
    that cites it; a link from another chunk moves there. Chunks without text only drop links. Joins are on identifiers and on
    documents; nothing is collected.
    """
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("identifier"))
    keys = F.array(key("pmid", F.col("pmid")), key("pmcid", F.upper("pmcid")), key("doi", F.lower("doi")))
    known = publications.select(F.col("id").cast("string").alias("id"), F.explode(keys).alias("k")).where("k.identifier IS NOT NULL").groupBy("k.kind", "k.identifier").agg(F.min("id").alias("id"))
    told = cited(chunks).join(known, ["kind", "identifier"], "left").withColumn("publication", F.coalesce("id", F.concat_ws(":", "kind", "identifier")))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("identifier")).alias(kind)
    new = told.where("id IS NULL").groupBy("publication", "kind", "identifier").agg(F.min("canonical_url").alias("canonical_url")).select(F.col("publication").alias("id"), of("pmid"), of("pmcid"), of("doi"), "canonical_url")
    # two identifiers of one publication in a chunk: the later kind's line would do as well, the least is taken for one result
    fresh = told.groupBy("document_id", "publication").agg(F.min(F.struct("chunk_id", "citation")).alias("f")).select("document_id", "publication", "f.chunk_id", "f.citation")
    gone = ["document_id"] if whole else ["document_id", "chunk_id"]
    kept = links.select("document_id", F.col("publication").cast("string").alias("publication"), "chunk_id", "citation").join(chunks.select(*gone).distinct(), gone, "left_anti").join(fresh, ["document_id", "publication"], "left_anti")
    stored = publications.select(F.col("id").cast("string").alias("id"), F.col("pmid").cast("string").alias("pmid"), "pmcid", "doi", "canonical_url")
    return stored.unionByName(new), kept.select(*fresh.columns).unionByName(fresh)


def _term(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _family(kind: Column) -> Column:
    return F.when(kind == "persName", "person").otherwise("place")


def canonical_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (document_id, type, text, variants, n) with `canonical`: the one text of new (the same columns, variants with base forms) that shares a spelling with it; null if none or several do.

    Persons meet persons only, all other types each other. Spellings are compared without case and by single spaces.
    """
    spelled = lambda df: df.withColumn("term", F.explode(F.array_distinct(F.filter(F.transform(F.concat(F.array("text"), F.coalesce("variants", F.array())), _term), lambda x: x != ""))))
    terms = spelled(new).select("document_id", _family(F.col("type")).alias("family"), "term", F.col("text").alias("canonical")).distinct()
    met = spelled(old.select("document_id", "type", "text", "variants")).withColumn("family", _family(F.col("type"))).join(terms, ["document_id", "family", "term"])
    # distinct partners are counted by least and greatest, not collected
    one = met.groupBy("document_id", "type", "text").agg(F.min("canonical").alias("least"), F.max("canonical").alias("greatest")).where("least = greatest")
    return old.join(one.select("document_id", "type", "text", F.col("least").alias("canonical")), ["document_id", "type", "text"], "left")


def entity_repairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions of a repair: (document_id, text, canonical, change) for each old entity, change being removed, merged, renamed, count or same.

    Merged: another old entity of the document goes to the same text. Counts (n) are compared with those of the new entity,
    whose greatest counts where two types share a text.
    """
    mapped = canonical_names(old, new)
    counts = new.groupBy("document_id", F.col("text").alias("canonical")).agg(F.max("n").alias("new_n"))
    shared = mapped.where("canonical IS NOT NULL").groupBy("document_id", "canonical").agg((F.count("*") > 1).alias("shared"))
    rows = mapped.join(counts, ["document_id", "canonical"], "left").join(shared, ["document_id", "canonical"], "left")
    change = F.when(F.col("canonical").isNull(), "removed").when(F.col("shared"), "merged").when(F.col("canonical") != F.col("text"), "renamed").when(~F.col("n").eqNullSafe(F.col("new_n")), "count").otherwise("same")
    return rows.select("document_id", "text", "canonical", change.alias("change"))


def repaired_links(links: DataFrame, mapped: DataFrame) -> DataFrame:
    """links (id, document_id, person, mention) to persons after a repair, as (id, document_id, person, mention, action), mapped being canonical_names().

    Of several links of a document to one person the one of the least id is looked at, the others are deduplicated. A mention
    that spells an old person takes its new text (updated), or goes with it (removed); other mentions are kept. Where two old
    persons share a spelling, the greater text counts.
    """
    spelled = mapped.where("type = 'persName'").select("document_id", "text", "canonical", F.explode(F.array_distinct(F.transform(F.concat(F.array("text"), F.coalesce("variants", F.array())), _term))).alias("term"))
    old = spelled.groupBy("document_id", "term").agg(F.max_by("canonical", "text").alias("canonical"))
    first = F.row_number().over(Window.partitionBy("document_id", "person").orderBy("id")) == 1
    rows = links.withColumn("first", first).withColumn("term", _term(F.col("mention"))).join(old.withColumn("known", F.lit(True)), ["document_id", "term"], "left")
    target = F.col("canonical")
    action = F.when(~F.col("first"), "deduplicated").when(target.isNotNull(), F.when(target.eqNullSafe(F.col("mention")), "kept").otherwise("updated")).when(F.col("known"), "removed").otherwise("kept")
    return rows.select("id", "document_id", "person", F.when(F.col("first"), F.coalesce(target, F.col("mention"))).otherwise(F.col("mention")).alias("mention"), action.alias("action"))
