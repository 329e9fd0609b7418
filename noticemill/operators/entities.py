"""Attribute notices to entities by phrase dictionary, and settle their region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import STRICT_BID_ID, alias_key, notice_ids, present
from ..functions.patterns import java, let, matches, once
from ..functions.text import field_between, product_evidence

OPENING_WORDS = 3


def phrase_table(
    entities: DataFrame,
    id_col: str = "id",
    phrases: list[str] = ("name", "short_name"),
    alias_col: str | None = "aliases",
) -> DataFrame:
    """(entity_id, phrase, words): every normalised name of every entity."""
    names = F.array(*[F.col(p) for p in phrases]) if phrases else F.array().cast("array<string>")
    if alias_col:
        names = F.concat(names, F.coalesce(F.col(alias_col), F.array().cast("array<string>")))
    keyed = entities.select(F.col(id_col).alias("entity_id"), F.explode(names).alias("name")).select(
        "entity_id", alias_key(F.col("name")).alias("phrase")
    )
    return (
        keyed.filter(F.col("phrase") != "")
        .distinct()
        .withColumn("words", F.size(F.split("phrase", " ")))
    )


# The index source of each region, and the source every entity shares.
REGION_SOURCES = {
    "Chandigarh": "gem-direct",
    "Punjab": "gem-direct-punjab",
    "Himachal Pradesh": "gem-direct-himachal",
    "Jammu and Kashmir": "gem-direct-jammu-kashmir",
    "Uttarakhand": "gem-direct-uttarakhand",
    "Haryana": "gem-direct-haryana",
}
SHARED_SOURCE = "gem-priority-keywords"


def with_region_sources(
    entities: DataFrame, region_sources: dict[str, str] = REGION_SOURCES, shared: str | None = SHARED_SOURCE
) -> DataFrame:
    """Directory rows with their region's index source and the shared source appended once."""
    own = F.lit(None).cast("string")
    for region, source in region_sources.items():
        own = F.when(F.col("region") == region, source).otherwise(own)
    extra = F.array_compact(F.array(own, F.lit(shared).cast("string")))
    listed = F.coalesce("source_ids", F.array().cast("array<string>"))
    return entities.withColumn("source_ids", F.array_union(listed, extra))


def match_phrases(
    texts: DataFrame, phrases: DataFrame, key: str = "notice_key", text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """(key, entity_id and the columns to carry) for every phrase that occurs on word boundaries in the text.

    Each position of a text meets the dictionary by its first word, first two and first three words; a phrase's key is
    its first words up to three, so a row survives only where some phrase can start, and longer phrases are then
    compared with the words that follow.  Spark decides how the dictionary side of the join travels: it broadcasts
    under its size threshold and shuffles with skew handling above it.
    """
    carry = carry or []
    openings = phrases.select(
        F.substring_index("phrase", " ", OPENING_WORDS).alias("__opening"), F.split("phrase", " ").alias("__phrase"), "entity_id"
    )
    longest = phrases.agg(F.coalesce(F.max("words"), F.lit(1)).alias("__longest"))  # one row
    words = texts.select(key, *carry, F.split(alias_key(F.col(text)), " ").alias("__words")).crossJoin(longest)
    at = words.select(key, *carry, "__words", "__longest", F.explode(F.sequence(F.lit(1), F.size("__words"))).alias("__i"))

    def opening(n: int) -> Column:
        return F.when(F.col("__i") + n - 1 <= F.size("__words"), F.array_join(F.slice("__words", F.col("__i"), n), " "))

    # Only generated code runs up to the join, so that the words that follow are put together for the few rows that meet.
    opened = at.select("*", F.explode(F.array(*[opening(n) for n in range(1, OPENING_WORDS + 1)])).alias("__opening"))
    following = F.slice("__words", F.col("__i"), F.col("__longest")).alias("__next")
    starts = opened.filter("__opening IS NOT NULL").select(key, *carry, "__opening", following)
    met = starts.join(openings, "__opening").filter(
        F.slice("__next", F.lit(1), F.size("__phrase")) == F.col("__phrase")
    )
    return met.select(key, *carry, "entity_id").distinct()


# Sources matched without a region, and locations that move an item
# of one source from the parent entity to a satellite.
REGION_FREE_SOURCES = ["cppp-pgimer"]
SATELLITES = [
    ("cppp-pgimer", r"ferozepur|firozpur|ferozpur", "pgi-ferozepur"),
    ("cppp-pgimer", r"\bsangrur\b", "pgi-sangrur"),
    ("cppp-pgimer", r"\buna\b", "pgi-una"),
]
SATELLITE_PARENT = "pgimer"
MATCHED = "array<struct<ordinal:int,id:string,short_name:string,name:string,region:string>>"


def _joined_text(df: DataFrame, names: list[str]) -> Column:
    parts: list[Column] = []
    for n in names:
        if n in df.columns:
            parts.append(present(F.col(n)))
        if n == "organisation" and "organisation_chain" in df.columns:
            parts.append(F.array_join("organisation_chain", " "))
    if "consignees" in df.columns:
        parts.append(F.array_join(F.transform("consignees", lambda c: c["name"]), " "))
    return F.concat_ws(" ", *parts)


TEXT_FIELDS = ["title", "description", "organisation", "department", "reference_number", "location"]


def assign_entities(
    notices: DataFrame,
    entities: DataFrame,
    key: str = "notice_key",
    out: str = "matched",
    region_free_sources: list[str] = REGION_FREE_SOURCES,
    satellites: list = SATELLITES,
    parent: str = SATELLITE_PARENT,
) -> DataFrame:
    """Add ``out``: the matched entities in directory order.

    A known explicit ``institution_id`` wins; otherwise names found in the notice
    text within its region.  Satellite locations replace the parent.
    """
    dim = entities.select(
        F.struct(
            F.col("ordinal").cast("int").alias("ordinal"), "id", "short_name", "name", "region"
        ).alias("entity"),
        F.col("id").alias("entity_id"),
    )
    explicit = dim.select(F.col("entity_id").alias("institution_id"), F.col("entity").alias("__explicit"))
    work = notices.join(explicit, "institution_id", "left")
    free = F.coalesce(F.col("source_id").isin(list(region_free_sources)), F.lit(False))
    texts = work.filter(F.col("__explicit").isNull()).select(
        key, _joined_text(work, TEXT_FIELDS).alias("text"), F.when(~free, F.col("region")).alias("__region")
    )
    named = match_phrases(texts, phrase_table(entities), key, carry=["__region"]).join(dim, "entity_id")
    in_region = F.col("__region").isNull() | (F.col("__region") == "") | (
        F.col("entity.region") == F.col("__region")
    )
    found = (
        named.filter(in_region)
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("entity")).alias("__found"))
    )
    work = work.join(found, key, "left")
    base = F.when(F.col("__explicit").isNotNull(), F.array("__explicit")).otherwise(
        F.coalesce(F.col("__found"), F.array().cast(MATCHED))
    )
    work = work.withColumn("__base", base)
    place = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "location")])
    chosen = F.lit(None).cast("string")
    for source, pattern, entity_id in reversed(satellites):
        chosen = F.when((F.col("source_id") == source) & matches(place, pattern), entity_id).otherwise(chosen)
    satellite = dim.select(F.col("entity_id").alias("__sat_id"), F.col("entity").alias("__sat"))
    work = work.withColumn("__sat_id", chosen).join(satellite, "__sat_id", "left")
    ids = [s[2] for s in satellites]
    return (
        work.withColumn(
            "__base", F.when(F.col("__sat").isNotNull(), F.array("__sat")).otherwise(F.col("__base"))
        )
        .withColumn(
            out,
            F.when(
                F.exists("__base", lambda e: e["id"].isin(ids)),
                F.filter("__base", lambda e: e["id"] != parent),
            ).otherwise(F.col("__base")),
        )
        .drop("__explicit", "__found", "__base", "__sat_id", "__sat")
    )


def procurement_scope(matched: Column) -> Column:
    n = F.size(matched)
    return F.when(n > 1, "multi-institution").when(n == 1, "institution").otherwise("statewide")


def attributed(matched: Column, scope: Column) -> Column:
    """Attribution filter: some entity, or a declared statewide purchase."""
    return (F.size(matched) > 0) | F.coalesce(scope == "statewide", F.lit(False))


# --- regions -------------------------------------------------------------------

# Monitored regions, location wording per region, places elsewhere.
REGIONS = ["Chandigarh", "Punjab", "Himachal Pradesh", "Jammu and Kashmir", "Uttarakhand", "Haryana"]
REGION_WORDING = [
    ("Punjab", r"\bpunjab\b|\b(?:new chandigarh|mullanpur)\b", None),
    ("Himachal Pradesh", r"\bhimachal(?: pradesh)?\b|\bh\.?p\.?\b", None),
    ("Chandigarh", r"\bchandigarh\b", r"\bnew chandigarh\b"),
    ("Jammu and Kashmir", r"\bjammu(?:\s*(?:and|&)\s*kashmir)?\b|\bkashmir\b|\bj\s*&\s*k\b", None),
    ("Uttarakhand", r"\buttarakhand\b|\buttaranchal\b", None),
    ("Haryana", r"\bharyana\b", None),
]
OUTSIDE_REGION = (
    r"\b(?:new delhi|delhi|uttar pradesh|rajasthan|gujarat|chhattisgarh|maharashtra|tamil nadu|karnataka"
    r"|kerala|west bengal|bihar|odisha|assam|jharkhand|madhya pradesh|telangana|andhra pradesh)\b"
)
UNMONITORED_REGION = r"\bladakh\b"
DELIVERY_ELSEWHERE = (
    r"\b(?:delhi|maharashtra|gujarat|chhattisgarh|uttar pradesh|ladakh|assam|bihar|tamil nadu|kerala"
    r"|karnataka|telangana|andhra pradesh|west bengal|odisha|madhya pradesh|rajasthan|jharkhand)\b"
)
NEAR_CHANDIGARH = (
    r"\b(?:new chandigarh|mohali|sas nagar|sahibzada ajit singh nagar|panchkula|chandimandir|haryana|punjab)\b"
)
PUNJAB_TOWNS = r"\b(?:new chandigarh|mullanpur|mohali|sas nagar)\b"


def stated_regions(location: Column) -> Column:
    """Regions a location names, as an array."""
    found = [
        F.when(matches(location, p) & (~matches(location, unless) if unless else F.lit(True)), F.lit(r))
        for r, p, unless in REGION_WORDING
    ]
    return F.array_compact(F.array(*found))


def resolve_region(notices: DataFrame, entities: DataFrame, key: str = "notice_key", out: str = "resolved_region") -> DataFrame:
    """One region per notice: its location, else the single region of its named entities."""
    place = F.coalesce(F.col("location"), F.lit(""))
    blocked = matches(place, OUTSIDE_REGION) | matches(place, UNMONITORED_REGION)
    work = notices.withColumn("__stated", stated_regions(place)).withColumn("__blocked", blocked)
    open_rows = work.filter(~F.col("__blocked") & (F.size("__stated") == 0))
    consignees = (
        F.array_join(F.transform("consignees", lambda c: c["name"]), " ") if "consignees" in work.columns else F.lit("")
    )
    chain = F.array_join("organisation_chain", " ") if "organisation_chain" in work.columns else F.lit(None)
    delivery = open_rows.select(key, F.concat_ws(" ", F.col("location"), consignees).alias("text"))
    buyer = open_rows.select(
        key, F.concat_ws(" ", "title", present(F.col("description")), present(F.col("organisation")), chain).alias("text")
    )
    phrases = phrase_table(entities)
    region = entities.select(F.col("id").alias("entity_id"), F.col("region").alias("__r"))

    def single(texts: DataFrame, name: str) -> DataFrame:
        hits = match_phrases(texts, phrases, key).join(region, "entity_id")
        return hits.groupBy(key).agg(
            F.min("__r").alias(f"__{name}_min"), F.max("__r").alias(f"__{name}_max")
        )

    work = work.join(single(delivery, "d"), key, "left").join(single(buyer, "b"), key, "left")

    def agreed(name: str) -> Column:
        return F.when(F.col(f"__{name}_min") == F.col(f"__{name}_max"), F.col(f"__{name}_min"))

    by_entity = F.when(F.col("__d_min").isNotNull(), agreed("d")).otherwise(agreed("b"))
    value = (
        F.when(F.col("__blocked"), F.lit(None))
        .when(F.size("__stated") == 1, F.get("__stated", F.lit(0)))
        .when(F.size("__stated") == 0, by_entity)
    )
    return work.withColumn(out, value).drop("__stated", "__blocked", "__d_min", "__d_max", "__b_min", "__b_max")


def names_region(text: Column, region: Column) -> Column:
    """The text names the region; neighbours of Chandigarh do not count as Chandigarh."""

    def check(t: Column) -> Column:
        named = F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), alias_key(region), F.lit(" ")))
        return named & ~((region == "Chandigarh") & matches(t, NEAR_CHANDIGARH))

    return F.coalesce(let(alias_key(text), check), F.lit(False))


# --- public buyers -------------------------------------------------------------

# Buyer wording.
EXCLUDED_BUYER = r"\b(?:private|pvt|charitable|trust|veterinary|animal husbandry|animal health|horticulture)\b"
HEALTH_AUTHORITY = (
    r"\b(?:department (?:of )?health|health (?:and family welfare|department|services|systems?)|medical education"
    r"|national health mission|state health society|medical services corporation"
    r"|directorate of (?:health|medical)|civil surgeon|chief medical officer)\b"
)
HEALTH_FACILITY = (
    r"\b(?:(?:government|govt|civil|district|regional|zonal|sub divisional|sub district)\s+"
    r"(?:(?:medical|dental|ayurvedic|ayush|mental|general|multi specialty|multi speciality)\s+)*hospital"
    r"|(?:government|govt)\s+(?:medical|dental|ayurvedic|ayush|pharmaceutical|public health)\s+(?:college|institute)"
    r"|community health cent(?:re|er)|primary health cent(?:re|er)|health sub cent(?:re|er)|ayushman arogya mandir"
    r"|aam aadmi clinic|esi[cs]? (?:model )?hospital)\b"
)
DIRECT_AUTHORITY = (
    r"\b(?:department (?:of )?health|health department|directorate of (?:health|medical)|director (?:of )?health"
    r"|national health mission|state health society|health systems? corporation|medical services corporation"
    r"|civil surgeon|chief medical officer)\b"
)
STATE_BODY = r"\b(?:ministry|department|directorate|government|administration)\b"
SERVICE_HOSPITAL = r"\b(?:military|army|railway|air force)\s+hospital\b"
SERVICE_MINISTRY = (
    r"\b(?:ministry of defence|department of military affairs|ministry of railways|indian railways)\b"
)
CHAIN_EXCLUDED = (
    r"veterinary|animal husbandry|public health engineering|private|charitable|maharaja agrasen|\bpvt\b"
)
CHAIN_HEALTH = (
    r"health(?: and | & )?(?:family welfare|medical education)?|medical (?:education|college|services)|hospital"
    r"|civil surgeon|chief medical officer|national health mission|aiims|skims|esic|pgims"
)
CONSIGNEE_BLOCK = (
    r"Consignees\s*/\s*Reporting Officer and Quantity([\s\S]*?)(?=Technical Specifications|Buyer Added Bid Specific"
    r"|Consignees\s*/\s*Reporting Officer and Quantity|\z)"
)
CENTRAL_ROOT = r"\b(?:post graduate institute of medical education and research|pgimer)\b"
TEACHING_BODY = r"\b(?:medical college|institute of medical scien(?:ce|ces)|university of health sciences)\b"
PINNED_ORGANISATION = r"^Punjab Health Systems? Corporation$"
FULL_NAME_OF_AIIMS = r"All India Institute Of Medical Sciences"


def buyer_chain(organisation: Column, chain: Column, matched: Column) -> Column:
    """Government healthcare buyer: wording of the chain, or a matched entity."""
    text = F.concat_ws(" ", organisation, F.array_join(chain, " "))
    return ~matches(text, CHAIN_EXCLUDED) & (matches(text, CHAIN_HEALTH) | (F.size(matched) > 0))


def regional_health_department(department: Column, region: Column) -> Column:
    d = F.coalesce(department, F.lit(""))
    return ~matches(d, EXCLUDED_BUYER) & matches(d, HEALTH_AUTHORITY) & names_region(d, region)


def document_buyer(documents: DataFrame, text: str = "text") -> DataFrame:
    """Buyer fields of bid documents: organisation, office, authority and delivery text."""
    t = F.col(text)
    consignees = F.regexp_replace(
        F.array_join(
            F.regexp_extract_all(t, F.lit(java(CONSIGNEE_BLOCK)), F.lit(1)), " "
        ),
        java(r"\s+", ""),
        " ",
    )
    authority = F.concat_ws(
        " ",
        present(field_between(t, "Ministry/State Name", "Department Name")),
        present(field_between(t, "Department Name", "Organisation Name")),
    )
    return documents.withColumns(
        {
            "buyer_organisation": field_between(t, "Organisation Name", "Office Name"),
            "buyer_office": field_between(t, "Office Name", "Contact details"),
            "buyer_authority": authority,
            "delivery_text": consignees,
        }
    )


def locate_delivery(documents: DataFrame, entities: DataFrame, key: str = "notice_key", text: str = "text") -> DataFrame:
    """(key, regions): regions of the delivery block, else of the buyer's office.

    Delivery elsewhere gives no region.  Entity names only count when they are long
    and contain their own city.
    """
    docs = document_buyer(documents, text)
    names = phrase_table(entities).join(
        entities.select(F.col("id").alias("entity_id"), alias_key(F.col("city")).alias("__city")), "entity_id"
    )
    specific = names.filter((F.length("phrase") > 10) & F.contains(F.col("phrase"), F.col("__city"))).select(
        "entity_id", "phrase", "words"
    )
    region = entities.select(F.col("id").alias("entity_id"), F.col("region").alias("__r"))

    def named(value: Column) -> Column:
        stated = F.array_compact(
            F.array(*[F.when(names_region(value, F.lit(r)), F.lit(r)) for r in REGIONS])
        )
        punjab = F.when(matches(value, PUNJAB_TOWNS), F.array(F.lit("Punjab"))).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_union(stated, punjab)

    docs = docs.withColumn("__office", F.concat_ws(" ", "buyer_organisation", "buyer_office"))
    docs = docs.withColumns({"__d": named(F.col("delivery_text")), "__b": named(F.col("__office"))})

    def by_entity(column: str, out: str) -> DataFrame:
        hits = match_phrases(docs.select(key, F.col(column).alias("text")), specific, key)
        return hits.join(region, "entity_id").groupBy(key).agg(F.sort_array(F.collect_set("__r")).alias(out))

    docs = docs.join(by_entity("delivery_text", "__de"), key, "left").join(by_entity("__office", "__be"), key, "left")
    none = F.array().cast("array<string>")

    def place(stated: str, entity: str) -> Column:
        return F.when(F.size(stated) > 0, F.col(stated)).otherwise(F.coalesce(F.col(entity), none))

    regions = (
        F.when(F.size(place("__d", "__de")) > 0, place("__d", "__de"))
        .when(matches(F.col("delivery_text"), DELIVERY_ELSEWHERE), none)
        .otherwise(place("__b", "__be"))
    )
    return docs.select(key, regions.alias("regions"))


def fan_out_regions(notices: DataFrame, regions: DataFrame, key: str = "notice_key") -> DataFrame:
    """One row per destination region of a national notice."""
    return (
        notices.drop("region")
        .join(regions, key)
        .withColumn("region", F.explode("regions"))
        .drop("regions")
    )


def enrich_buyer(
    notices: DataFrame, documents: DataFrame, entities: DataFrame, key: str = "notice_key", text: str = "text"
) -> DataFrame:
    """Apply a matching bid document: buyer, consignees, scope text and statewide evidence.

    ``documents`` has one text per notice.  Rows get ``document_checked``; a document
    that does not name the notice is ignored.
    """
    docs = document_buyer(documents.select(key, F.col(text).alias("__text")), "__text")
    joined = notices.join(docs, key, "left").withColumn(
        "document_checked",
        F.coalesce(
            F.array_contains(notice_ids(F.col("__text"), STRICT_BID_ID), F.upper(F.col("tender_id"))), F.lit(False)
        ),
    )
    buyer = F.regexp_replace(
        F.concat_ws(" ", "buyer_organisation", "buyer_office"), r"(?i)\(aiims\)", " "
    )
    short_name = F.when(
        matches(F.col("buyer_organisation"), FULL_NAME_OF_AIIMS), F.concat_ws(" ", F.lit("AIIMS"), F.col("buyer_office"))
    )
    checked = joined.filter("document_checked")
    texts = checked.select(key, "region", F.concat_ws(" ", buyer, F.col("delivery_text")).alias("text")).unionByName(
        checked.select(key, "region", short_name.alias("text")).filter(F.col("text").isNotNull())
    )
    dim = entities.select(
        F.col("id").alias("entity_id"),
        F.col("region").alias("__er"),
        F.struct(F.col("ordinal").cast("int").alias("ordinal"), F.col("id").alias("id"), "short_name").alias("__e"),
    )
    hits = (
        match_phrases(texts, phrase_table(entities), key)
        .join(dim, "entity_id")
        .join(checked.select(key, "region"), key)
        .filter(F.col("__er") == F.col("region"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("__e")).alias("__hits"))
    )
    work = joined.join(hits, key, "left")
    consignees = F.transform(
        F.col("__hits"),
        lambda e: F.struct(e["id"].alias("institution_id"), e["short_name"].alias("name")),
    )
    none = F.array().cast("array<struct<institution_id:string,name:string>>")
    public = unlisted_public_buyer(work)
    scope = F.left(product_evidence(F.col("__text")), F.lit(28000))
    ok = F.col("document_checked")
    no_match = ok & F.col("__hits").isNull()
    old = {c: (F.col(c) if c in notices.columns else F.lit(None).cast("string")) for c in
           ("organisation", "location", "institution_id", "procurement_scope", "buyer", "description", "document_product_scope")}
    return work.withColumns(
        {
            "organisation": F.when(ok, F.col("buyer_organisation")).otherwise(old["organisation"]),
            "location": F.when(ok, present(F.left("buyer_office", F.lit(160)))).otherwise(old["location"]),
            "consignees": F.when(ok, F.coalesce(consignees, none)).otherwise(
                F.col("consignees") if "consignees" in notices.columns else none
            ),
            "institution_id": F.when(ok & (F.size("__hits") == 1), F.get("__hits", F.lit(0))["id"]).otherwise(
                old["institution_id"]
            ),
            "procurement_scope": F.when(no_match & public, "statewide").otherwise(old["procurement_scope"]),
            "buyer": F.when(
                no_match & public,
                F.left(F.concat_ws(" — ", present(F.col("buyer_organisation")), present(F.col("buyer_office"))), F.lit(400)),
            ).otherwise(old["buyer"]),
            "description": F.when(ok, F.coalesce(present(scope), old["description"])).otherwise(old["description"]),
            "document_product_scope": F.when(ok, F.coalesce(present(scope), old["document_product_scope"])).otherwise(
                old["document_product_scope"]
            ),
        }
    ).drop("__text", "__hits", "buyer_organisation", "buyer_office", "buyer_authority", "delivery_text")


def unlisted_public_buyer(df: DataFrame) -> Column:
    """Authority, facility or defence-service evidence plus regional evidence."""
    buyer = F.concat_ws(" ", "buyer_organisation", "buyer_office")
    authority = F.concat_ws(
        " ",
        F.col("buyer_authority"),
        F.col("department") if "department" in df.columns else F.lit(None),
        F.array_join("organisation_chain", " ") if "organisation_chain" in df.columns else F.lit(None),
    )
    structured = matches(authority, HEALTH_AUTHORITY) & matches(authority, STATE_BODY)
    healthcare = (
        matches(buyer, DIRECT_AUTHORITY)
        | matches(buyer, HEALTH_FACILITY)
        | (structured & matches(buyer, HEALTH_AUTHORITY))
    )
    service = matches(buyer, SERVICE_HOSPITAL) & matches(authority, SERVICE_MINISTRY)
    regional = (
        (matches(authority, HEALTH_AUTHORITY) & names_region(authority, F.col("region")))
        | names_region(F.col("buyer_office"), F.col("region"))
        | names_region(F.col("delivery_text"), F.col("region"))
    )
    excluded = matches(F.concat_ws(" ", buyer, authority), EXCLUDED_BUYER)
    return ~excluded & (healthcare | service) & regional


def retain_regional(notices: DataFrame) -> DataFrame:
    """Rows kept after buyer enrichment; kept rows without an entity become statewide.

    Needs ``document_checked``, ``has_document_text``, ``consignees``, ``procurement_scope``,
    ``department`` and ``region``.
    """
    entity = F.size(F.coalesce(F.col("consignees"), F.array().cast("array<struct<institution_id:string,name:string>>"))) > 0
    department = ~F.col("has_document_text") & regional_health_department(F.col("department"), F.col("region"))
    keep = entity | F.coalesce(F.col("procurement_scope") == "statewide", F.lit(False)) | department
    return notices.filter(keep).withColumn(
        "procurement_scope", F.when(entity, F.col("procurement_scope")).otherwise("statewide")
    )


def select_organisations(names: DataFrame, entities: DataFrame, region: str, state_scoped: bool, name: str = "name") -> DataFrame:
    """Returned organisation names worth a query: distinct, human-health or monitored, monitored first."""
    keyed = names.select(F.col(name).alias("name"), F.col("ordinal")).withColumn("__k", F.lower(F.trim("name")))
    ok = (F.col("__k") != "") & ~matches(F.col("name"), EXCLUDED_BUYER) & ~matches(F.col("name"), r"\banimal\b")
    here = entities.filter(F.col("region") == region)
    hits = match_phrases(keyed.filter(ok).select("__k", F.col("name").alias("text")), phrase_table(here), "__k")
    work = keyed.filter(ok).join(hits.select("__k").distinct().withColumn("listed", F.lit(True)), "__k", "left")
    listed = F.coalesce(F.col("listed"), F.lit(False))
    if state_scoped:
        wanted = (
            listed
            | matches(F.col("name"), HEALTH_AUTHORITY)
            | matches(F.col("name"), HEALTH_FACILITY)
            | matches(F.col("name"), TEACHING_BODY)
        )
        if region == "Punjab":
            wanted = wanted | matches(F.trim("name"), PINNED_ORGANISATION)
    elif region == "Chandigarh":
        wanted = matches(F.col("name"), CENTRAL_ROOT) & matches(F.col("name"), r"\bchandigarh\b")
    else:
        wanted = F.lit(False)
    first = (
        work.filter(wanted)
        .groupBy("__k")
        .agg(
            F.min_by("name", "ordinal").alias("name"),
            F.min("ordinal").alias("ordinal"),
            F.max(listed).alias("monitored"),
        )
    )
    return first.select("name", "monitored", "ordinal").orderBy(F.desc("monitored"), "ordinal")


