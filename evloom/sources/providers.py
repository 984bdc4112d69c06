"""Landed provider pages to one citation schema. Fetching them is not part of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evloom.functions import text
from evloom.functions import status as st

RELATION = "array<struct<relation:string,direction:string,status:string,target_doi:string,target_pmid:string,target_pmcid:string>>"
COLUMNS = ["source", "source_id", "doi", "pmid", "pmcid", "title", "authors", "year", "url", "abstract", "full_text_url", "license",
           "version", "is_preprint", "status", "related_dois", "updated_at", "update_relations"]
TYPES = {"authors": "array<string>", "related_dois": "array<string>", "update_relations": RELATION, "year": "int", "is_preprint": "boolean"}
# What each kind of notice says about the record it points to.
CROSSREF_NOTICES = {"retraction": "retracted", "correction": "corrected", "expression-of-concern": "concern", "withdrawal": "withdrawn"}
PUBMED_INCOMING = {"RetractionIn": "retracted", "ExpressionOfConcernIn": "concern", "ErratumIn": "corrected",
                   "RetractedandRepublishedIn": "retracted", "CorrectedandRepublishedIn": "corrected", "UpdateIn": "corrected"}
PUBMED_OUTGOING = {"RetractionOf": "retracted", "ExpressionOfConcernFor": "concern", "ErratumFor": "corrected",
                   "RetractedandRepublishedFrom": "retracted", "CorrectedandRepublishedFrom": "corrected", "UpdateOf": "corrected"}

CROSSREF_ITEM = """struct<DOI:string,URL:string,title:array<string>,author:array<struct<given:string,family:string>>,abstract:string,type:string,
published:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>,indexed:struct<`date-time`:string>,
relation:struct<`is-preprint-of`:array<struct<id:string>>,`has-preprint`:array<struct<id:string>>>,`update-to`:array<struct<type:string,DOI:string>>>"""
OPENALEX_ITEM = """struct<id:string,doi:string,display_name:string,publication_year:int,type:string,updated_date:string,is_retracted:boolean,
authorships:array<struct<author:struct<display_name:string>>>,abstract_inverted_index:map<string,array<int>>,
best_oa_location:struct<pdf_url:string,landing_page_url:string,license:string,version:string>>"""
EUROPEPMC_ITEM = """struct<id:string,source:string,pmcid:string,doi:string,title:string,abstractText:string,pubYear:string,license:string,versionNumber:string,
isRetracted:string,firstIndexDate:string,firstPublicationDate:string,authorList:struct<author:array<struct<fullName:string>>>,
fullTextUrlList:struct<fullTextUrl:array<struct<availabilityCode:string,url:string>>>>"""
SCOPUS_ITEM = """struct<eid:string,`dc:identifier`:string,`prism:doi`:string,`dc:title`:string,`dc:creator`:string,`prism:coverDate`:string,`dc:description`:string,`prism:url`:string>"""
_TEXT = "struct<_VALUE:string,_IdType:string>"
PUBMED_ARTICLE = f"""struct<MedlineCitation:struct<PMID:string,DateRevised:struct<Year:string,Month:string,Day:string>,
Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,AuthorList:struct<Author:array<struct<ForeName:string,LastName:string>>>,
Journal:struct<JournalIssue:struct<PubDate:struct<Year:string>>>,PublicationTypeList:struct<PublicationType:array<string>>>,
CommentsCorrectionsList:struct<CommentsCorrections:array<struct<_RefType:string,PMID:string>>>>,
PubmedData:struct<ArticleIdList:struct<ArticleId:array<{_TEXT}>>>>"""
ARXIV_ENTRY = """struct<id:string,title:string,summary:string,updated:string,published:string,doi:string,author:array<struct<name:string>>>"""


def _named(source: str, **cols: Column) -> list[Column]:
    out = {"source": F.lit(source), "status": F.lit("active"), "is_preprint": F.lit(False), **cols}
    empty = {"authors", "related_dois", "update_relations"}
    return [(out[c] if c in out else (F.array() if c in empty else F.lit(None))).cast(TYPES.get(c, "string")).alias(c) for c in COLUMNS]


def _choose(kind: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(kind == key, value).otherwise(out)
    return out


def _highest(statuses: Column) -> Column:
    return st.from_priority(F.coalesce(F.array_max(F.transform(statuses, st.priority)), F.lit(0)))


def _list(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def crossref(pages: DataFrame, item: str = "item") -> DataFrame:
    """Citations from a column of Crossref work structs; ``update-to`` becomes directed relations."""
    i = F.col(item)
    doi = text.canonical_doi(i["DOI"])
    related = F.transform(F.concat(_list(i["relation"]["is-preprint-of"], "array<struct<id:string>>"),
                                   _list(i["relation"]["has-preprint"], "array<struct<id:string>>")), lambda r: text.canonical_doi(r["id"]))
    notices = F.filter(F.transform(_list(i["update-to"], "array<struct<type:string,DOI:string>>"), lambda u: F.struct(
        u["type"].alias("relation"), F.lit("updates").alias("direction"), _choose(u["type"], CROSSREF_NOTICES).alias("status"),
        text.canonical_doi(u["DOI"]).alias("target_doi"), F.lit(None).cast("string").alias("target_pmid"), F.lit(None).cast("string").alias("target_pmcid"))),
        lambda n: n["status"].isNotNull() & n["target_doi"].isNotNull())
    own = F.transform(F.filter(notices, lambda n: n["target_doi"] == doi), lambda n: n["status"])
    date = F.coalesce(i["published"]["date-parts"], i["issued"]["date-parts"])
    return pages.select(*_named(
        "crossref", source_id=F.coalesce(doi, i["URL"], F.lit("")), doi=doi,
        title=F.coalesce(F.try_element_at(i["title"], F.lit(1)), F.lit("Untitled record")),
        authors=F.transform(i["author"], lambda a: text.person_name(a["given"], a["family"])),
        year=F.try_element_at(F.try_element_at(date, F.lit(1)), F.lit(1)), url=i["URL"], abstract=i["abstract"],
        is_preprint=F.coalesce(i["type"] == "posted-content", F.lit(False)), related_dois=F.array_compact(related),
        updated_at=i["indexed"]["date-time"], status=_highest(own), update_relations=notices))


def crossref_notice_dois(pages: DataFrame, item: str = "item") -> DataFrame:
    """DOIs of records that announce an update to another record."""
    i = F.col(item)
    doi = text.canonical_doi(i["DOI"])
    other = F.exists(i["update-to"], lambda u: text.canonical_doi(u["DOI"]) != doi)
    return pages.where(other).select(doi.alias("doi")).where("doi is not null").distinct()


def openalex(pages: DataFrame, item: str = "item") -> DataFrame:
    i = F.col(item)
    place = i["best_oa_location"]
    return pages.select(*_named(
        "openalex", source_id=i["id"], doi=text.canonical_doi(i["doi"]), title=F.coalesce(F.when(i["display_name"] != "", i["display_name"]), F.lit("Untitled record")),
        year=i["publication_year"], authors=F.transform(i["authorships"], lambda a: a["author"]["display_name"]),
        abstract=text.inverted_abstract(i["abstract_inverted_index"]), url=F.coalesce(i["doi"], i["id"]),
        full_text_url=F.coalesce(place["pdf_url"], place["landing_page_url"]), license=place["license"], version=place["version"],
        is_preprint=F.coalesce(i["type"] == "preprint", F.lit(False)), updated_at=i["updated_date"],
        status=F.when(i["is_retracted"], "retracted").otherwise("active")))


def europepmc(pages: DataFrame, item: str = "item") -> DataFrame:
    i = F.col(item)
    pid, src = i["id"], i["source"]
    free = F.filter(i["fullTextUrlList"]["fullTextUrl"], lambda u: u["availabilityCode"] == "OA")
    pmcid = F.coalesce(F.when(i["pmcid"] != "", i["pmcid"]), F.when(F.startswith(pid, F.lit("PMC")), pid),
                       F.when((src == "PMC") & pid.rlike(r"^\d+$"), F.concat(F.lit("PMC"), pid)))
    return pages.select(*_named(
        "europepmc", source_id=F.concat_ws(":", F.coalesce(src, F.lit("None")), pid), pmid=F.when(src == "MED", pid), pmcid=pmcid,
        doi=text.canonical_doi(i["doi"]), title=F.coalesce(F.when(i["title"] != "", i["title"]), F.lit("Untitled record")),
        authors=F.transform(i["authorList"]["author"], lambda a: F.coalesce(a["fullName"], F.lit(""))), abstract=i["abstractText"],
        year=i["pubYear"].try_cast("int"), url=F.concat(F.lit("https://europepmc.org/article/"), F.coalesce(src, F.lit("MED")), F.lit("/"), pid),
        full_text_url=F.try_element_at(free, F.lit(1))["url"], license=i["license"], version=F.when(i["versionNumber"] != "", i["versionNumber"]),
        is_preprint=F.coalesce(src == "PPR", F.lit(False)), status=F.when(i["isRetracted"] == "Y", "retracted").otherwise("active")))


def europepmc_dates(pages: DataFrame, item: str = "item") -> DataFrame:
    """First index and publication dates per record; the update date stays unknown."""
    i = F.col(item)
    return pages.select(F.concat_ws(":", i["source"], i["id"]).alias("record_id"), i["firstIndexDate"].alias("first_indexed_at"),
                        i["firstPublicationDate"].alias("first_published_at"), F.lit(None).cast("string").alias("metadata_updated_at"))


def scopus(pages: DataFrame, item: str = "item") -> DataFrame:
    i = F.col(item)
    return pages.select(*_named(
        "scopus", source_id=F.coalesce(F.when(i["eid"] != "", i["eid"]), i["dc:identifier"], F.lit("")), doi=text.canonical_doi(i["prism:doi"]),
        title=F.coalesce(F.when(i["dc:title"] != "", i["dc:title"]), F.lit("Untitled record")),
        authors=F.array_compact(F.array(F.when(i["dc:creator"] != "", i["dc:creator"]))),
        year=F.substring(i["prism:coverDate"], 1, 4).try_cast("int"), abstract=i["dc:description"], url=i["prism:url"]))


def pubmed(pages: DataFrame, article: str = "article") -> DataFrame:
    """Citations from a column of PubMed article structs (XML source or ``from_xml``)."""
    a = F.col(article)
    m, art = a["MedlineCitation"], a["MedlineCitation"]["Article"]
    ids = _list(a["PubmedData"]["ArticleIdList"]["ArticleId"], f"array<{_TEXT}>")
    of = lambda kind: F.transform(F.filter(ids, lambda x: x["_IdType"] == kind), lambda x: text.strip(x["_VALUE"]))
    links = _list(m["CommentsCorrectionsList"]["CommentsCorrections"], "array<struct<_RefType:string,PMID:string>>")
    incoming = F.array_compact(F.transform(links, lambda x: _choose(x["_RefType"], PUBMED_INCOMING)))
    types = F.transform(_list(art["PublicationTypeList"]["PublicationType"], "array<string>"), lambda x: F.lower(text.strip(x)))
    relations = F.filter(F.transform(links, lambda x: F.struct(
        x["_RefType"].alias("relation"), F.when(_choose(x["_RefType"], PUBMED_INCOMING).isNotNull(), "updated_by").otherwise("updates").alias("direction"),
        F.coalesce(_choose(x["_RefType"], PUBMED_INCOMING), _choose(x["_RefType"], PUBMED_OUTGOING)).alias("status"), F.lit(None).cast("string").alias("target_doi"),
        text.strip(x["PMID"]).alias("target_pmid"), F.lit(None).cast("string").alias("target_pmcid"))),
        lambda r: r["status"].isNotNull() & (F.coalesce(r["target_pmid"], F.lit("")) != ""))
    r = m["DateRevised"]
    revised = F.when((F.coalesce(r["Year"], F.lit("")) != "") & (F.coalesce(r["Month"], F.lit("")) != "") & (F.coalesce(r["Day"], F.lit("")) != ""),
                     F.concat_ws("-", r["Year"], r["Month"], r["Day"]))
    year = art["Journal"]["JournalIssue"]["PubDate"]["Year"]
    doi = F.transform(F.slice(of("doi"), 1, 1), text.canonical_doi)
    return pages.select(*_named(
        "pubmed", source_id=m["PMID"], pmid=m["PMID"], doi=F.try_element_at(doi, F.lit(1)), pmcid=F.try_element_at(of("pmc"), F.lit(1)),
        title=F.coalesce(art["ArticleTitle"], F.lit("")), authors=F.transform(art["AuthorList"]["Author"], lambda x: text.person_name(x["ForeName"], x["LastName"])),
        abstract=F.array_join(_list(art["Abstract"]["AbstractText"], "array<string>"), "\n"), year=F.when(year.rlike(r"^\d+$"), year.try_cast("int")),
        url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), m["PMID"], F.lit("/")),
        status=F.when(F.array_contains(types, "retracted publication"), "retracted").otherwise(_highest(incoming)),
        is_preprint=F.array_contains(types, "preprint"), update_relations=relations, updated_at=revised))


def arxiv(pages: DataFrame, entry: str = "entry") -> DataFrame:
    e = F.col(entry)
    return pages.select(*_named(
        "arxiv", source_id=text.strip(e["id"]), doi=text.canonical_doi(e["doi"]), title=text.strip(e["title"]), abstract=text.strip(e["summary"]),
        authors=F.transform(e["author"], lambda a: text.strip(a["name"])), url=text.strip(e["id"]), is_preprint=F.lit(True), updated_at=text.strip(e["updated"]),
        year=F.substring(text.strip(e["published"]), 1, 4).try_cast("int")))


def read_json_pages(spark, path: str, item: str, items: str) -> DataFrame:
    """One row per item of landed JSON pages; ``items`` is the dotted path of the item array."""
    ddl = f"array<{item}>"
    for part in reversed(items.split(".")):
        ddl = f"struct<`{part}`:{ddl}>"
    return spark.read.schema(T.DataType.fromDDL(ddl)).option("multiLine", "true").json(path).select(F.explode(items).alias("item"))


def read_xml_records(spark, path: str, record: str, row_tag: str, name: str) -> DataFrame:
    """One row per XML record, from files of any size."""
    schema = T.DataType.fromDDL(record)
    df = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(path)
    return df.select(F.struct(*df.columns).alias(name))


def union_citations(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def id_conversions(records: DataFrame) -> DataFrame:
    """(requested_id, pmcid) of live, well-formed conversion records."""
    ok = F.col("pmcid").rlike(r"^PMC\d+\z") & F.coalesce(F.col("live"), F.lit(True))
    return records.where(ok).select("requested_id", "pmcid")


def unpaywall_locations(records: DataFrame) -> DataFrame:
    """https locations of landed Unpaywall records (doi, oa_locations)."""
    from evloom.functions.urls import https_url
    loc = records.select(text.canonical_doi(F.col("doi")).alias("doi"), F.explode("oa_locations").alias("l"))
    pdf = F.when(F.col("l.url_for_pdf") != "", F.col("l.url_for_pdf"))
    return loc.select("doi", https_url(F.coalesce(pdf, F.col("l.url"))).alias("url"), F.when(pdf.isNotNull(), "pdf").otherwise("landing_page").alias("kind"),
                      F.col("l.license").alias("license"), F.col("l.version").alias("version")).where("url is not null")


def pmc_versions(records: DataFrame) -> DataFrame:
    """Well-formed distributed versions: pmcid, version, doi, retracted, manuscript, license."""
    yes = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit(""))).isin("yes", "true", "y")
    named = records.withColumn("pmcid", F.upper("pmcid"))
    ok = F.col("pmcid").rlike(r"^PMC\d+\z") & F.col("version").rlike(r"^PMC\d+\.\d+\z") & F.startswith("version", F.concat("pmcid", F.lit(".")))
    return named.where(ok).select("pmcid", "version", text.canonical_doi(F.col("doi")).alias("doi"), yes(F.col("is_retracted")).alias("retracted"),
                                  yes(F.col("is_manuscript")).alias("manuscript"), "license_code", "xml_url", "pdf_url", "text_url", "media_urls")


def pmc_locations(records: DataFrame, host: str) -> DataFrame:
    """One row per file of each version that lies on ``host`` under the version's own folder."""
    from evloom.functions.urls import https_url
    v = pmc_versions(records)
    urls = F.concat(F.array(*[F.struct(F.col(f"{k}_url").alias("url"), F.lit(k).alias("kind")) for k in ("xml", "pdf", "text")]),
                    F.transform(F.coalesce("media_urls", F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit("media_or_supplement").alias("kind"))))
    flat = v.select("pmcid", "version", "manuscript", F.col("license_code").alias("license"), F.explode(urls).alias("u")).select("*", "u.url", "u.kind").drop("u")
    here = https_url(F.col("url")).isNotNull() & (F.try_parse_url("url", F.lit("HOST")) == host) & \
        F.startswith(F.try_parse_url("url", F.lit("PATH")), F.concat(F.lit("/"), "version", F.lit("/")))
    return flat.where(here).withColumn("md5", F.try_parse_url("url", F.lit("QUERY"), F.lit("md5")))


def pmc_publication_status(records: DataFrame) -> DataFrame:
    """A publication is flagged when any of its versions is."""
    return pmc_versions(records).groupBy("pmcid").agg(F.when(F.max("retracted"), "retracted").otherwise("active").alias("publication_status"))
