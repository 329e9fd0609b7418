"""Text classification against rule tables: categories, brands and priority groups.

A ``RuleBook`` is plain data.  Every operator takes a DataFrame and returns it
with extra columns; rules become native regex columns in one projection, so there
is no rule join, no Python on the rows and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import first_present, present
from ..functions.patterns import any_of, java, let, matches, occurrences, once, position, without_lookaheads, word_gate
from ..functions.text import product_evidence, without_clinical_context, without_marks
from ..sources import medical_rules as rules

# Scope wording used by the product/infrastructure decision.
ADMISSION_SCOPE = (
    r"\b(?:admission (?:notices?|forms?|applications?|results?)|examination results?|course fees)\b"
)
INFRASTRUCTURE_CATEGORY = (
    r"\b(?:works?|civil|construction|building|electrical|plumbing|roads?|drainage|painting|renovation"
    r"|carpentry|hvac|fire safety|fire fighting|lifts?|elevators?|generators?|dg|transformers?|cabling"
    r"|water supply|sewage|public works)\b"
)
PROCUREMENT_ACTION = (
    r"\b(?:supply|procurement|purchase|installation|commissioning|repair|servic(?:e|ing)|maintenance"
    r"|cmc|camc|amc|replacement)\b"
)
# A hybrid modality that is not evidence for the plain one.
HYBRID_SCANNER = r"\bpet\s*[/-]?\s*ct(?:\s+scanner)?"
# Wording that needs context before it counts.
CONTEXT_RULE = {
    "category": "PATIENT_MONITORING",
    "keyword": "central monitor",
    "pattern": r"\bcentral monitors?\b",
    "product_category": r"^Medical Equipments/Waste$",
    "context": r"\b(?:patient|bedside|icu|ecg|nibp|spo2|vital signs?)\b",
    "unless": r"\b(?:computer|network|cctv|security|industrial|water quality)\b",
}
OFFICIAL = ["tender_category", "product_category", "procurement_category", "work_category"]


@dataclass(frozen=True)
class RuleBook:
    """Rule tables for one domain. ``strip_before`` maps a category to text removed first."""

    taxonomy: list = field(default_factory=list)
    non_product: str | None = None
    portfolios: list = field(default_factory=list)
    context_rule: dict | None = None
    strip_before: dict = field(default_factory=dict)
    clean_text: bool = True

    @property
    def any_category(self) -> str:
        return any_of([p for _, p in self.taxonomy])

    @property
    def gate(self) -> str:
        """Superset of all rules, cheap enough to run on every row."""
        return any_of([without_lookaheads(p) for _, p in self.taxonomy])

    @property
    def words(self) -> str | None:
        """Found in every text whose evidence can match a rule: what evidence leaves out are whole words.

        Text that a category strips first may be less, so its own words count too.
        """
        context = [self.context_rule["pattern"]] if self.context_rule else []
        return word_gate([p for _, p in self.taxonomy] + context + list(self.strip_before.values()))


MEDICAL = RuleBook(
    taxonomy=rules.TAXONOMY,
    non_product=rules.NON_PRODUCT_SCOPE,
    portfolios=rules.PORTFOLIOS,
    context_rule=CONTEXT_RULE,
    strip_before={"CT": HYBRID_SCANNER},
)


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def evidence_text(text: Column) -> Column:
    return without_clinical_context(product_evidence(text))


def _object_first(text: Column, book: RuleBook) -> Column:
    """A product is named before any infrastructure wording."""
    product = position(text, book.any_category)
    return F.coalesce(product < F.coalesce(position(text, book.non_product), F.lit(2**31 - 1)), F.lit(False))


def _action_then_object(text: Column, book: RuleBook) -> Column:
    """In one clause: an action word, then the product, then any infrastructure."""
    return F.exists(
        F.split(text, r"[\n;.]"),
        lambda clause: _object_first(clause, book)
        & F.coalesce(position(clause, PROCUREMENT_ACTION) < position(clause, book.any_category), F.lit(False)),
    )


def non_product_scope(text: Column, scope: Column, official: Column, book: RuleBook) -> Column:
    """True when the notice buys works or services rather than a product."""
    if book.non_product is None:
        return F.lit(False)
    infrastructure = matches(scope, book.non_product)
    return (
        F.when(matches(scope, ADMISSION_SCOPE), True)
        .when(
            matches(official, INFRASTRUCTURE_CATEGORY),
            ~(_object_first(scope, book) | (~infrastructure & _action_then_object(text, book))),
        )
        .when(infrastructure, ~_object_first(scope, book))
        .otherwise(~matches(scope, book.any_category) & matches(text, book.non_product))
    )


def official_text(df: DataFrame) -> Column:
    return F.concat_ws(" ", *[present(_column(df, c)) for c in OFFICIAL])


def classification(
    text: Column, scope: Column | None, official: Column, product_category: Column, book: RuleBook, brands: bool = False
) -> Column:
    """One struct column per row: categories, matched_keywords, confidence, is_relevant[, brand_matches].

    Every shared step is bound once with ``let``: a filter on the result that Spark
    pushes below the projection repeats the scan once, not once per rule.
    """
    clean = evidence_text if book.clean_text else (lambda c: c)
    empty = F.lit("")

    def prepare(t: Column, s: Column) -> Column:
        if scope is None:
            return let(clean(t), lambda e: F.struct(e.alias("t"), e.alias("s"), official.alias("o")))

        def combine(both: Column) -> Column:
            whole = F.when(t != s, F.concat_ws("\n", present(both["s"]), present(both["t"]))).otherwise(both["t"])
            return F.struct(whole.alias("t"), both["s"].alias("s"), official.alias("o"))

        return let(F.struct(clean(t).alias("t"), clean(s).alias("s")), combine)

    def scan(x: Column) -> Column:
        def rule_text(category: str) -> Column:
            strip = book.strip_before.get(category)
            return F.regexp_replace(x["t"], java(strip), "") if strip else x["t"]

        # One cheap alternation first: rows without any hit skip the per-rule scans.
        per_rule = F.array(*[occurrences(rule_text(c), p) for c, p in book.taxonomy])
        in_context = _in_context(x["s"], product_category, book.context_rule)
        wanted = matches(x["t"], book.gate) | in_context
        found = let(F.when(wanted, per_rule), lambda hits: decide(x, hits, in_context))
        return found

    def decide(x: Column, hits: Column, in_context: Column) -> Column:
        listed = F.array_compact(
            F.array(*[F.when(F.size(F.get(hits, F.lit(i))) > 0, F.lit(c)) for i, (c, _) in enumerate(book.taxonomy)])
        )
        words = F.coalesce(F.flatten(hits), _no_strings())
        if book.context_rule:
            rule = book.context_rule
            listed = F.when(in_context, F.array_union(listed, F.array(F.lit(rule["category"])))).otherwise(listed)
            words = F.when(in_context, F.concat(words, F.array(F.lit(rule["keyword"])))).otherwise(words)

        def judge(cats: Column) -> Column:
            ok = F.when(F.size(cats) > 0, ~non_product_scope(x["t"], x["s"], x["o"], book)).otherwise(False)
            return let(ok, lambda good: result(cats, good))

        def result(cats: Column, good: Column) -> Column:
            score = F.least(F.lit(0.98), F.lit(0.72) + F.size(cats) * F.lit(0.04))
            fields = [
                F.when(good, cats).otherwise(_no_strings()).alias("categories"),
                F.when(good, F.array_distinct(F.transform(words, F.lower))).otherwise(_no_strings()).alias("matched_keywords"),
                F.when(good, score).otherwise(F.lit(0.0)).alias("confidence"),
                good.alias("is_relevant"),
            ]
            if brands:
                fields.append(
                    F.when(good, _brand_matches(x["t"], cats, hits, book))
                    .otherwise(F.array().cast(BRAND_MATCHES))
                    .alias("brand_matches")
                )
            return F.struct(*fields)

        return let(listed, judge)

    both = F.struct(
        F.coalesce(text, empty).alias("t"), F.coalesce(text if scope is None else scope, empty).alias("s")
    )

    def judged(b: Column) -> Column:
        full = let(prepare(b["t"], b["s"]), scan)
        if book.words is None:
            return full
        worded = matches(without_marks(b["t"]), book.words)
        if scope is not None:
            worded = worded | matches(without_marks(b["s"]), book.words)
        # Texts without any of the rules' words have no hit, and their evidence need not be found.
        return F.when(worded, full).otherwise(no_match(brands))

    return let(both, judged)


def no_match(brands: bool) -> Column:
    fields = [
        _no_strings().alias("categories"), _no_strings().alias("matched_keywords"), F.lit(0.0).alias("confidence"),
        F.lit(False).alias("is_relevant"),
    ]
    return F.struct(*fields, *([F.array().cast(BRAND_MATCHES).alias("brand_matches")] if brands else []))


def _in_context(scope: Column, product_category: Column, rule: dict | None) -> Column:
    if not rule:
        return F.lit(False)
    return (
        matches(scope, rule["pattern"])
        & (matches(product_category, rule["product_category"]) | matches(scope, rule["context"]))
        & ~matches(scope, rule["unless"])
    )


def classify(
    df: DataFrame,
    text: Column,
    scope: Column | None = None,
    book: RuleBook = MEDICAL,
    out: str = "classification",
    brands: bool = False,
) -> DataFrame:
    """Add ``out``: struct<categories, matched_keywords, confidence, is_relevant[, brand_matches]>.

    ``scope`` is the declared purchase (usually the title); official category
    columns are read when present.
    """
    column = classification(text, scope, official_text(df), _column(df, "product_category"), book, brands)
    return df.withColumn(out, once(column))


BRAND_MATCHES = "array<struct<brand:string,match_type:string,terms:array<string>>>"


def _brand_matches(text: Column, categories: Column, hits: Column, book: RuleBook) -> Column:
    """Per portfolio: an explicit brand beats an explicit model beats a category match."""
    return F.array_compact(F.array(*[_portfolio_match(p, text, categories, hits, book) for p in book.portfolios]))


def _portfolio_match(p: dict, text: Column, categories: Column, hits: Column, book: RuleBook) -> Column:
    index = {c: i for i, (c, _) in enumerate(book.taxonomy)}
    pattern = dict(book.taxonomy)

    def match(kind: str, terms: Column) -> Column:
        return F.struct(
            F.lit(p["brand"]).alias("brand"),
            F.lit(kind).alias("match_type"),
            F.array_distinct(terms).alias("terms"),
        )

    shares = F.arrays_overlap(categories, F.array(*[F.lit(c) for c in p["categories"]]))
    models = occurrences(text, p["models"]) if p["models"] else _no_strings()
    if p["models"] and p["ambiguous_models"]:
        models = F.filter(models, lambda m: ~matches(m, p["ambiguous_models"]) | shares)
    terms = occurrences(text, p["clinical_terms"]) if p["clinical_terms"] else _no_strings()

    def evidence(c: str) -> Column:
        keep = F.array_contains(categories, c)
        if c in p["evidence"]:
            keep = keep & matches(text, p["evidence"][c])
        if c in p["exclusions"]:
            keep = keep & ~matches(text, p["exclusions"][c])
        if c in p["needs_clinical_term"]:
            keep = keep & matches(text, p["clinical_terms"])
        own = occurrences(text, pattern[c]) if c in book.strip_before else F.get(hits, F.lit(index[c]))
        return F.when(keep, F.coalesce(own, _no_strings()))

    in_rule_order = sorted((c for c in p["categories"] if c in index), key=index.get)
    kept = F.array_compact(F.array(*[evidence(c) for c in in_rule_order]))

    def by_category(k: Column) -> Column:
        return F.when(
            (F.size(k) > 0) | (F.size(terms) > 0), match("portfolio", F.concat(F.flatten(k), terms))
        )

    def by_model(m: Column) -> Column:
        return F.when(F.size(m) > 0, match("explicit-model", m)).otherwise(let(kept, by_category))

    return F.when(
        matches(text, p["aliases"]), match("explicit-brand", occurrences(text, p["aliases"]))
    ).otherwise(let(models, by_model))


# --- priority groups -----------------------------------------------------------

# Wording removed or required before a group is accepted.
LASER_DOPPLER = r"\blaser[ -]?doppler\b"
COMPATIBLE_DEVICE = (
    r"\b(?:c[ -]?arms?|(?:digital )?x[ -]?rays?|(?:mobile|portable) dr|digital radiograph\w*"
    r"|flat[ -]panel detectors?|(?:digital )?mammograph\w*|ultrasound|colou?r doppler)"
    r"(?:\s+(?:systems?|machines?|units?|devices?))?\s+compatib(?:le|ility)\b(?!\s+with\b)"
)
USED_WITH = r"\b(?:compatible with|for use with|usable with|suitable for use with)\b[^\n.;]*"
CASSETTE_HOLDER = r"\b(?:provision of )?x[ -]?ray cassette (?:channel|holder)\b"
LAPAROSCOPIC_USE = r"\b(?:for\s+)?laparoscop(?:ic|y)\s+(?:cases?|procedures?)\b"
LAPAROSCOPY_TITLE = (
    r"\blaparoscopy\b(?!\s+(?:cases?|procedures?)\b)"
    r"|\blaparoscopic\s+(?:instruments?|equipment|systems?|sets?|towers?|scopes?)\b"
)
SIMULATOR = r"\bsimulat(?:or|ion)\b"
LIGHT_ACCESSORY = (
    r"\bot lights?\s+(?:ups\s+)?batter(?:y|ies)\b"
    r"|\b(?:ups|batter(?:y|ies)|backup)\b[^\n.;]*\b(?:for|of)\s+(?:the\s+)?ot lights?\b"
)
NOT_IMAGING_ULTRASOUND = (
    r"\b(?:ultrasound gel|ultrasound ups batteries|ultrasound therapy(?: unit)?"
    r"|ultrasound\s*\(?physiotherapy|(?:therapeutic|physiotherapy) ultrasound|(?:fetal|foetal) doppler)\b"
)
IMAGING_GROUPS = ["ULTRASOUND", "MAMMOGRAPHY", "DIGITAL_RADIOGRAPHY", "C_ARM"]
ALIAS_GROUPS = ["MAMMOGRAPHY", "DIGITAL_RADIOGRAPHY", "INFUSION_PUMPS", "PATIENT_MONITORS"]


def priority_groups(
    df: DataFrame,
    title: Column | None = None,
    product_scope: Column | None = None,
    out: str = "priority_categories",
    book: RuleBook = MEDICAL,
    groups: list = rules.PRIORITY_GROUPS,
) -> DataFrame:
    """Add the priority groups of each notice, read from its title or document scope only.

    Three derived texts are classified once each: the scope, the scope without
    imaging compatibility phrases, and the scope without laparoscopic use settings.
    """
    title = F.col("title") if title is None else title
    scope_in = title if product_scope is None else first_present(product_scope, title)
    official, product = official_text(df), _column(df, "product_category")

    def judged(text: Column) -> Column:
        return classification(text, None, official, product, book)

    def no_use_setting(c: Column) -> Column:
        return F.regexp_replace(c, java(LAPAROSCOPIC_USE), " ")

    def derive(x: Column) -> Column:
        imaging = x["s"]
        for phrase in (LASER_DOPPLER, COMPATIBLE_DEVICE, USED_WITH, CASSETTE_HOLDER):
            imaging = F.regexp_replace(imaging, java(phrase), " ")
        titled = F.when(matches(x["t"], LAPAROSCOPY_TITLE), no_use_setting(x["t"]))
        return F.struct(
            x["t"].alias("t"),
            x["s"].alias("s"),
            imaging.alias("i"),
            F.concat_ws("\n", present(no_use_setting(x["s"])), present(titled)).alias("e"),
        )

    def scan(x: Column) -> Column:
        return let(judged(x["s"]), lambda m: F.when(m["is_relevant"], variants(x, m)).otherwise(_no_strings()))

    def variants(x: Column, m: Column) -> Column:
        # Most scopes have no phrase to remove; their classification is reused.
        both = F.struct(
            F.when(x["i"] == x["s"], m).otherwise(judged(x["i"])).alias("i"),
            F.when(x["e"] == x["s"], m).otherwise(judged(x["e"])).alias("e"),
        )
        return let(both, lambda v: choose(x, m, v["i"], v["e"]))

    def choose(x: Column, m: Column, imaging: Column, endoscopy: Column) -> Column:
        def has(result: Column, names: list) -> Column:
            return F.arrays_overlap(result["categories"], F.array(*[F.lit(n) for n in names]))

        chosen = []
        for group, _label, categories, aliases in groups:
            source, result = (
                (x["i"], imaging) if group in IMAGING_GROUPS else (x["e"], endoscopy) if group == "ENDOSCOPY" else (x["s"], m)
            )
            ok = has(result, categories)
            if group in ALIAS_GROUPS:
                ok = ok & matches(source, aliases)
            if group == "VENTILATORS":
                ok = ok | (has(m, ["RESPIRATORY"]) & matches(x["s"], aliases))
            if group == "ENDOSCOPY":
                ok = ok | (has(endoscopy, ["ENT_AIRWAY"]) & matches(x["e"], aliases))
            if group == "OT_LIGHTS":
                ok = ok & ~matches(x["t"], LIGHT_ACCESSORY)
            if group == "ULTRASOUND":
                ok = ok & ~matches(x["s"], NOT_IMAGING_ULTRASOUND)
            chosen.append(F.when(ok, F.lit(group)))
        listed = F.array_compact(F.array(*chosen))
        return F.when(matches(x["s"], SIMULATOR), _no_strings()).otherwise(listed)

    start = F.struct(F.coalesce(title, F.lit("")).alias("t"), product_evidence(F.coalesce(scope_in, F.lit(""))).alias("s"))
    return df.withColumn(out, once(let(let(start, derive), scan)))


# --- candidates for inspection -------------------------------------------------

# Broad titles, the one exact buyer chain and its title shapes.
BARE_CENTRAL_MONITOR = r"^central monitor$"
CIVIL_CATEGORY = r"\b(?:civil|construction|building|plumbing|hvac)\b"
OPAQUE_SOURCE, OPAQUE_REGION = "punjab-phsc", "Punjab"
OPAQUE_BUYER = r"^Punjab Health Systems? Corporation$"
OPAQUE_WING = r"^Medical Wing$"
OPAQUE_BUYER_EXCLUDED = r"\b(?:private|trust|engineering wing)\b"
OPAQUE_SCOPE_EXCLUDED = (
    r"\b(?:consumables?|drugs?|medicines?|pharmaceuticals?|reagents?|vaccines?|implants?|syringes?|manpower"
    r"|staffing|recruitment|outsourcing|empanelment|civil|construction|engineering|buildings?|plumbing|hvac)\b"
)
OPAQUE_REFERENCE_TITLE = r"^(?:e[ -]?tender[\s/: -]*)?PHSC\s*\/[\w\s./()&+-]+$"
OPAQUE_GENERIC_TITLE = (
    r"^(?:(?:supply|procurement|purchase)(?:\s+(?:and|&)\s+installation)?\s+of\s+)?"
    r"(?:various\s+(?:items?|equipment|equipments|instruments)"
    r"|(?:medical\s+)?(?:equipment|equipments|instruments)(?:\s*[,/&]\s*(?:equipment|equipments|instruments))?"
    r"(?:\s+for\s+(?:BLS|ALS)\s+ambulances?)?)(?:\s*\([^)]*\))?$"
)
OPAQUE_MAINTENANCE_TITLE = (
    r"^(?:CMC|AMC|CAMC)(?:\s+(?:of|for)\s+(?:medical\s+)?(?:equipment|equipments|instruments))?(?:\s*\([^)]*\))?$"
)


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, java(r"\s+", ""), " "))


def opaque_candidate(df: DataFrame, book: RuleBook = MEDICAL) -> Column:
    """A title that hides its product, published by one exact buyer chain."""
    names = F.transform(
        F.flatten(
            F.transform(
                F.concat(
                    F.array(F.coalesce(_column(df, "organisation"), F.lit(""))),
                    F.coalesce(
                        F.col("organisation_chain") if "organisation_chain" in df.columns else F.lit(None),
                        _no_strings(),
                    ),
                ),
                lambda v: F.split(v, r"\|\|"),
            )
        ),
        _squeezed,
    )
    buyer = (
        F.coalesce((F.col("source_id") == OPAQUE_SOURCE) & (F.col("region") == OPAQUE_REGION), F.lit(False))
        & F.exists(names, lambda n: matches(n, OPAQUE_BUYER))
        & F.exists(names, lambda n: matches(n, OPAQUE_WING))
        & ~F.exists(names, lambda n: matches(n, OPAQUE_BUYER_EXCLUDED))
    )
    title = _squeezed(F.col("title"))
    scope = F.concat_ws(
        "\n", title, *[present(_column(df, c)) for c in ("description", "product_category", "work_category")]
    )
    shape = any_of([OPAQUE_REFERENCE_TITLE, OPAQUE_GENERIC_TITLE, OPAQUE_MAINTENANCE_TITLE])
    clean_scope = ~matches(scope, OPAQUE_SCOPE_EXCLUDED) & ~matches(scope, book.non_product)
    return buyer & matches(title, shape) & clean_scope


def generic_candidate(df: DataFrame, book: RuleBook = MEDICAL) -> Column:
    """A broad title worth inspecting; never product evidence by itself."""
    civil = F.concat_ws(" ", present(_column(df, "product_category")), present(_column(df, "work_category")))
    broad = (
        (matches(F.col("title"), rules.GENERIC_SCOPE) | matches(F.trim(F.col("title")), BARE_CENTRAL_MONITOR))
        & ~matches(F.col("title"), book.non_product)
        & ~matches(civil, CIVIL_CATEGORY)
    )
    if {"source_id", "region"} <= set(df.columns):
        return opaque_candidate(df, book) | broad
    return broad
