"""Citation identity: exact identifiers and stated version relations, never titles.

Lists that can grow with the data (members, related DOIs, relations) come back as long tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.functions import status as st
from evloom.functions.text import canonical_doi, fingerprint
from evloom.operators.primitives import connected_components, dense_index
from evloom.session import cut, written


class Reconciled(NamedTuple):
    records: DataFrame   # one row per work: the surviving record
    members: DataFrame   # input_pos -> component, same_version
    related: DataFrame   # component, related_doi
    relations: DataFrame  # component, relation, direction, status, target ids


def citation_key(source: Column, source_id: Column, doi: Column) -> Column:
    """``doi:…`` or ``source:id``; an arXiv id loses its version suffix and its scheme."""
    arxiv = F.regexp_replace(F.regexp_replace(source_id, r"v\d+\z", ""), r"^http://", "")
    arxiv = F.regexp_replace(arxiv, r"^https://", "")
    canonical = canonical_doi(doi)
    return F.when(canonical.isNotNull(), F.concat(F.lit("doi:"), canonical)).otherwise(
        F.concat_ws(":", source, F.when(source == "arxiv", arxiv).otherwise(source_id)))


def batches(keys: DataFrame, column: str, size: int) -> DataFrame:
    """``keys`` with a batch number such that every batch but the last holds exactly ``size`` of them."""
    return dense_index(keys, [F.col(column)], "__i").withColumn("batch", F.floor(F.col("__i") / size).cast("bigint")).drop("__i")


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def identifiers(doi: Column, pmid: Column, pmcid: Column, source: Column, source_id: Column) -> Column:
    """Array of the identifiers under which a record may be found."""
    canonical = canonical_doi(doi)
    return F.array_distinct(F.array_compact(F.array(
        F.concat(F.lit("doi:"), canonical), F.concat(F.lit("pmid:"), _nonempty(pmid)),
        F.concat(F.lit("pmcid:"), _nonempty(pmcid)), F.concat(source, F.lit(":"), _nonempty(source_id)))))


def _node(doi: Column, pmid: Column, pmcid: Column, source: Column, source_id: Column) -> Column:
    return F.coalesce(doi, F.concat(F.lit("pmid:"), _nonempty(pmid)), F.concat(F.lit("pmcid:"), _nonempty(pmcid)),
                      F.concat_ws(":", source, source_id))


def _once(relations: DataFrame) -> DataFrame:
    """Relations of a work without repeats: equal in whole content, nested values and maps included; the first one stays.

    The content is compared through a digest of its JSON, since maps and deep nests are no grouping keys.
    """
    content = [x for x in relations.columns if x not in ("input_pos", "component")]
    digest = fingerprint(*[F.col(x) for x in content], length=64)
    return (relations.withColumn("__digest", digest).groupBy("component", "__digest")
            .agg(F.min_by(F.struct(*content), "input_pos").alias("r")).select("component", "r.*"))


def reconcile(citations: DataFrame, relations: DataFrame | None = None) -> Reconciled:
    """Resolve citations to works.

    Columns of ``citations``: input_pos, source, source_id, doi, pmid, pmcid, related_dois (array),
    is_preprint, abstract, license, full_text_url, status and any payload. ``relations`` holds the
    update relations as rows keyed by input_pos.

    Edges run from a record's own key to each identifier it names, so a shared identifier costs one
    edge per record and no pairs. Survivor and fill-ins are ``min_by`` style aggregates, which
    combine before the shuffle: a work with a third of all records needs no sort in one task.
    """
    c = F.col
    clean = citations.withColumn("doi", canonical_doi(c("doi"))).withColumn(
        "__key", _node(c("doi"), c("pmid"), c("pmcid"), c("source"), c("source_id")))
    named = F.array_compact(F.concat(
        F.array(F.concat(F.lit("pmid:"), _nonempty(c("pmid"))), F.concat(F.lit("pmcid:"), _nonempty(c("pmcid")))),
        F.transform(F.coalesce(c("related_dois"), F.array().cast("array<string>")), canonical_doi)))
    edges = clean.select("__key", F.explode(named).alias("__id"))
    component = connected_components(edges, "__key", "__id")
    placed = (clean.join(component.withColumnRenamed("node", "__key"), "__key", "left")
              .withColumn("component", F.coalesce("component", "__key")).drop("__key"))

    rank = F.struct(c("is_preprint").alias("p"), c("doi").isNull().alias("d"),
                    (F.coalesce(c("abstract"), F.lit("")) == "").alias("a"), c("input_pos").alias("pos"))
    best = placed.groupBy("component").agg(F.min(F.struct(rank.alias("rank"), c("doi").alias("doi"))).alias("b")).select(
        "component", c("b.rank.pos").alias("__chosen"), c("b.doi").alias("__doi"))
    # read three times below, and by up to four results: written once instead of derived again
    placed = cut(placed.join(best, "component"))

    # Records without a DOI belong to the survivor's version if a chain of shared PMIDs or PMCIDs,
    # not passing through a record with another DOI, leads to a record with the survivor's DOI.
    inside = placed.where(c("doi").isNull() & c("__doi").isNotNull())
    anchor = placed.where(c("doi") == c("__doi"))
    ids = lambda df, tag: df.select(
        "component", tag.alias("__tag"), F.explode(F.array_compact(F.array(
            F.concat_ws("|", "component", F.concat(F.lit("pmid:"), _nonempty(c("pmid")))),
            F.concat_ws("|", "component", F.concat(F.lit("pmcid:"), _nonempty(c("pmcid"))))))).alias("__id"))
    record_tag = F.concat(F.lit("~record:"), c("input_pos").cast("string"))
    links = ids(inside.where("pmid <> '' or pmcid <> ''"), record_tag).where(c("__id") != c("component"))
    anchors = ids(anchor.where("pmid <> '' or pmcid <> ''"), F.concat(F.lit("!anchor:"), c("component"))).where(
        c("__id") != c("component"))
    reach = connected_components(links.unionByName(anchors).select("__tag", "__id"), "__tag", "__id")
    joined = (reach.where(F.startswith("component", F.lit("!anchor:")) & F.startswith("node", F.lit("~record:")))
              .select(F.substring("node", 9, 40).cast("bigint").alias("input_pos"), F.lit(True).alias("__joined")))
    placed = placed.join(joined, "input_pos", "left").withColumn(
        "same_version", c("doi").eqNullSafe(c("__doi")) | F.coalesce(c("__joined"), F.lit(False)))

    def fill(name: str, scope: Column | None = None) -> Column:
        """The survivor's own value, else the first non-empty one in scope by input order."""
        value = _nonempty(c(name)) if dict(citations.dtypes)[name] == "string" else c(name)
        usable = value.isNotNull() if scope is None else value.isNotNull() & scope
        first = F.struct((c("input_pos") != c("__chosen")).alias("late"), c("input_pos").alias("pos"), value.alias("v"))
        return F.min(F.when(usable, first))["v"].alias(name)

    own = lambda name: F.max(F.when(c("input_pos") == c("__chosen"), c(name))).alias(name)
    version = c("same_version")
    shared = {"pmid": version, "pmcid": version, "license": version, "full_text_url": version, "abstract": None}
    payload = [x for x in citations.columns if x not in shared and x not in ("input_pos", "status", "related_dois")]
    records = placed.groupBy("component").agg(
        F.max("__chosen").alias("input_pos"), *[own(x) for x in payload], *[fill(x, s) for x, s in shared.items()],
        st.from_priority(F.max(F.when(version, st.priority(c("status"))))).alias("status"), F.count("*").alias("members"))
    members = placed.select("input_pos", "component", "same_version", (c("input_pos") == c("__chosen")).alias("survivor"))
    others = placed.select("component", "__doi", F.explode(F.array_compact(F.concat(
        F.array(c("doi")), F.coalesce(c("related_dois"), F.array().cast("array<string>"))))).alias("related_doi"))
    related = others.where(~c("related_doi").eqNullSafe(c("__doi"))).select("component", "related_doi").distinct()
    kept = None
    if relations is not None:
        kept = _once(relations.join(members.where("same_version").select("input_pos", "component"), "input_pos"))
    return Reconciled(records, members, related, kept)


def family_components(publications: DataFrame, related: DataFrame) -> DataFrame:
    """(doi, family): DOIs tied by stated version relations, named after their smallest DOI.

    ``related`` has doi and related_doi rows of the given publications.
    """
    known = publications.select(canonical_doi(F.col("doi")).alias("doi")).where("doi is not null").distinct()
    edges = (related.select(canonical_doi(F.col("doi")).alias("doi"), canonical_doi(F.col("related_doi")).alias("other"))
             .where("doi is not null and other is not null").join(known, "doi", "left_semi"))
    joined = connected_components(edges, "doi", "other").select(F.col("node").alias("doi"), F.col("component").alias("family"))
    # a DOI related only to itself is a family of one
    alone = edges.where(F.col("doi") == F.col("other")).select("doi").distinct().join(joined, "doi", "left_anti")
    return joined.unionByName(alone.withColumn("family", F.col("doi")))


def relabel_families(experiments: DataFrame, families: DataFrame) -> DataFrame:
    """Experiments with the family of their DOI where the DOI is part of a version relation."""
    return (experiments.withColumn("__doi", canonical_doi(F.col("doi")))
            .join(families.withColumnRenamed("doi", "__doi"), "__doi", "left")
            .withColumn("study_family", F.coalesce("family", "study_family"))
            .withColumn("family_basis", F.when(F.col("family").isNotNull(), "stated version relation"))
            .drop("__doi", "family"))


def status_by_doi(updates: DataFrame) -> DataFrame:
    """Highest status ever seen per canonical DOI."""
    return (updates.select(canonical_doi(F.col("doi")).alias("doi"), "status").where("doi is not null")
            .groupBy("doi").agg(st.max_status(F.col("status")).alias("status")))


def linked_keys(links: DataFrame, key: str, identifier: str) -> DataFrame:
    """(key, component) of the keys that a chain of shared identifiers ties to another key; ``links`` has distinct pairs.

    The graph has keys as its only nodes: an identifier under one key alone, as a record's own number is, makes no
    edge, and one under several keys makes an edge from the smallest to each other one. Components never see the rest.
    """
    shared = links.groupBy(identifier).agg(F.min(key).alias("__low"), F.max(key).alias("__high")).where("__low < __high")
    edges = links.join(shared.select(identifier, "__low"), identifier).select("__low", key)
    return connected_components(edges, "__low", key).withColumnRenamed("node", key)


def merge_publications(existing: DataFrame, incoming: DataFrame, carried: list[str]) -> dict[str, DataFrame]:
    """Merge incoming citations into known publications that share any identifier.

    ``existing``: publication_id, position, identifiers (array), status, state, carried columns.
    ``incoming``: input_pos, identifiers (array), status, carried columns; ``notice`` (boolean) says
    that the record only announces an update to another one. Per carried column the last non-null
    incoming value wins, else the first existing one. Identifiers and id aliases are long tables.
    """
    c = F.col
    rows = existing.select(
        F.lit(0).alias("__new"), c("position").cast("bigint").alias("__pos"), "publication_id", "identifiers", "status", "state",
        F.coalesce(c("notice"), F.lit(False)).alias("notice") if "notice" in existing.columns else F.lit(False).alias("notice"),
        *carried).unionByName(incoming.select(
            F.lit(1).alias("__new"), c("input_pos").cast("bigint").alias("__pos"),
            F.lit(None).cast("string").alias("publication_id"), "identifiers", "status",
            F.lit(None).cast("string").alias("state"), F.coalesce(c("notice"), F.lit(False)).alias("notice"), *carried))
    # both the links and the merged rows read this, so it is derived once; a row is known by its first identifier
    alone = F.concat_ws("#", F.lit("~row"), c("__new").cast("string"), c("__pos").cast("string"))
    rows = written(rows.withColumn("__key", F.coalesce(F.get("identifiers", F.lit(0)), alone)), "merging")
    links = written(rows.select("__key", F.explode("identifiers").alias("identifier")).distinct(), "links")
    component = linked_keys(links, "__key", "identifier")
    placed = rows.join(component, "__key", "left").withColumn("component", F.coalesce("component", "__key"))
    old, new = c("__new") == 0, c("__new") == 1
    keep = lambda name: F.coalesce(
        F.max_by(c(name), F.when(new & c(name).isNotNull(), c("__pos"))),
        F.min_by(c(name), F.when(old & c(name).isNotNull(), c("__pos")))).alias(name)
    first_new = F.min(F.when(new, F.struct(c("__pos").alias("pos"), F.array_min("identifiers").alias("id"))))
    touched = F.max(new)
    records = placed.groupBy("component").agg(
        F.coalesce(F.min_by("publication_id", F.when(old, c("__pos"))), first_new["id"]).alias("publication_id"),
        F.max(old).alias("known"), touched.alias("touched"),
        st.max_status(c("status")).alias("status"),
        F.when(F.max(c("notice")), "publication_notice").otherwise(
            F.coalesce(F.min_by("state", F.when(old, c("__pos"))), F.lit("pending_extraction"))).alias("state"),
        *[keep(x) for x in carried])
    aliases = (placed.where(old).select("component", c("publication_id").alias("alias")).distinct()
               .join(records.select("component", "publication_id"), "component").where("alias <> publication_id")
               .select("publication_id", "alias"))
    found = (links.join(component, "__key", "left")
             .withColumn("component", F.coalesce("component", "__key")).select("component", "identifier").distinct()
             .join(records.select("component", "publication_id"), "component").select("publication_id", "identifier"))
    return {"records": records.drop("component"), "aliases": aliases, "identifiers": found}


def apply_notices(publications: DataFrame, identifiers_long: DataFrame, notices: DataFrame) -> DataFrame:
    """Raise the status of every publication an outgoing notice names by DOI, PMID or PMCID.

    ``notices``: direction, status, target_doi, target_pmid, target_pmcid (any may be absent).
    The notices are reduced to one status per target identifier before they meet the publications.
    """
    c = F.col
    targets = [F.concat(F.lit(f"{k}:"), _nonempty(c(f"target_{k}"))) for k in ("doi", "pmid", "pmcid")
               if f"target_{k}" in notices.columns]
    raised = (notices.where("direction = 'updates'")
              .select(F.explode(F.array_compact(F.array(*targets))).alias("identifier"), st.priority(c("status")).alias("rank"))
              .groupBy("identifier").agg(F.max("rank").alias("rank")))
    hit = (identifiers_long.join(raised, "identifier").groupBy("publication_id").agg(F.max("rank").alias("__rank")))
    return (publications.join(hit, "publication_id", "left")
            .withColumn("status", st.from_priority(F.greatest(st.priority(c("status")), F.coalesce("__rank", F.lit(0))))).drop("__rank"))
