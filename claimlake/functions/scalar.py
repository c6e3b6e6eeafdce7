"""Scalar functions of the claim model as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- strings ---------------------------------------------------------------------------------------------------


def sanitize_identifier(name: str, most: int = 64) -> str:
    """Letters, digits and underscores, at most ``most``; ``x`` if nothing is left."""
    return re.sub(r"[^0-9A-Za-z_]+", "_", name).strip("_")[:most] or "x"


def sanitize(name: Column, most: int = 64) -> Column:
    kept = F.substring(F.btrim(F.regexp_replace(name, "[^0-9A-Za-z_]+", "_"), F.lit("_")), 1, most)
    return F.when(kept == "", "x").otherwise(kept)


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def newlines(text: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def header_predicate(header: Column) -> Column:
    return F.replace(F.lower(header), F.lit(" "), F.lit("_"))


def strip_tags(markup: Column) -> Column:
    """Tags become spaces, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"\s+", " "))


def summary(answer: Column, most: int = 200) -> Column:
    return F.replace(F.left(answer, F.lit(most)), F.lit("\n"), F.lit(" "))


def clean_topic(topic: str) -> str:
    return topic.strip().rstrip("?.,;:").strip()


def is_safe_path(path: Column) -> Column:
    """Relative, and never up."""
    return ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)") & (path != "")


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping; an empty needle occurs nowhere."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))  # in bytes: lengths are known
    return F.when(needle == "", 0).otherwise((gone / F.octet_length(needle)).cast("int"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int"))


def byte_exact(text: Column, start: Column, end: Column, evidence: Column) -> Column:
    inside = (start >= 0) & (end >= start) & (end <= F.octet_length(text))
    return F.coalesce(inside & (byte_slice(text, start, end) == evidence.cast("binary")), F.lit(False))


# --- fixed values: patterns of money, dates and object types ------------------------------------------------------
MONEY = r"(\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"
DATE = r"\b(\d{4}-\d{2}-\d{2}|\w+\s+\d{1,2},\s+\d{4})\b"
BOOLEAN = r"(?i)^(?:true|false|yes|no)$"
INTEGER = r"^-?\d{1,15}$"
DECIMAL = r"^-?\d+\.\d+$"
QUANTITY = r"(?i)^-?\d[\d,.]*\s*(?:%|mg|kg|g|ml|l|mm|cm|m|km|lb|oz|ft|in|hr|min|sec|days?|weeks?|months?|years?|mph|km/h|kph|psi|mmHg|°[CF]|USD|EUR|GBP|\$)s?$"
DATE_VALUE = r"(?i)^(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2},?\s+\d{4})$"
ACRONYM = r"(?:(?:The|A|An)\s+)?([A-Z][a-zA-Z]+(?:\s+[a-zA-Z]+){0,4})\s+\(([A-Z][A-Z0-9]{1,5})\)"


def money(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MONEY), F.lit(1))


def dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), F.lit(1))


def object_type(obj: Column) -> Column:
    s = F.trim(obj)
    return (
        F.when(s == "", "entity")
        .when(s.rlike(BOOLEAN), "literal:boolean")
        .when(s.rlike(INTEGER), "literal:integer")
        .when(s.rlike(DECIMAL), "literal:decimal")
        .when(s.rlike(QUANTITY) | s.rlike(DATE_VALUE), "literal:string")
        .otherwise("entity")
    )


def typed(claims):
    """Typed readings of ``object``; null where it does not read as its type."""
    return claims.withColumns(
        {
            "object_int": F.when(F.col("object_type") == "literal:integer", F.expr("try_cast(object as bigint)")),
            "object_dec": F.when(F.col("object_type") == "literal:decimal", F.expr("try_cast(object as decimal(38, 9))")),
            "object_bool": F.when(F.col("object_type") == "literal:boolean", F.lower("object").isin("true", "yes")),
        }
    )


#: Labels that are no entity on their own.
STOP_LABELS = (
    "it", "its", "they", "them", "he", "she", "this", "that", "these", "those", "which", "what", "who", "whom",
    "the",
    "significantly", "approximately", "generally", "typically", "usually", "often", "sometimes", "rarely", "very", "highly", "extremely",
    "however", "therefore", "moreover", "furthermore", "additionally", "also", "thus", "hence",
    "the study", "the results", "the data", "the authors", "the patient", "the above", "the following", "the same",
    "as described above", "as mentioned", "as noted", "as shown",
    "in the control group", "in this case", "in this study",
    "not recommended", "not applicable", "unknown", "various", "other", "several", "many", "some", "all", "none", "most", "both",
)


def is_garbage_entity(label: Column) -> Column:
    s = F.trim(F.coalesce(label, F.lit("")))
    upper = s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}")
    return F.when(s == "", True).when((F.length(s) == 1) & ~upper, True).when(upper & (F.length(s) <= 6), False).otherwise(F.lower(s).isin(*STOP_LABELS))


# --- dates -------------------------------------------------------------------------------------------------------
#: Words that make a predicate temporal, and the shapes that make an object so, in order of trial.
TIME_LABELS = ("date", "time", "timestamp", "as of", "period", "quarter", "year", "effective", "expires", "valid")
DATE_SHAPES = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}/\d{2}/\d{2}")
DATE_SEARCH = "|".join(f"(?:{s})" for s in DATE_SHAPES)
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_iso(text: Column) -> Column:
    """ISO instant of a date or date-time; a yyyy-mm-dd shape is taken as it stands; null if nothing fits."""
    s = F.trim(text)
    formats = ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy")
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00Z"))).otherwise(F.date_format(parsed, ISO))


def extract_date(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), f"({DATE_SEARCH})", 1)
    return F.when(found != "", parse_iso(found))


def is_temporal(predicate: Column, obj: Column) -> Column:
    named = reduce(Column.__or__, [F.lower(predicate).contains(w) for w in TIME_LABELS])
    return named | F.coalesce(obj, F.lit("")).rlike(DATE_SEARCH)


def epoch_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), ISO)


def normal_timestamp(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(".000000+00:00"), F.lit("Z")), F.lit("+00:00"), F.lit("Z"))


def within_validity(now: Column, valid_from: Column, valid_until: Column) -> Column:
    """Null and empty bounds are open; a bound that does not parse is too."""

    def instant(c: Column) -> Column:
        return F.try_to_timestamp(F.regexp_replace(F.nullif(c, F.lit("")), "Z$", ""))

    at = instant(now)
    return F.coalesce(instant(valid_from) <= at, F.lit(True)) & F.coalesce(at <= instant(valid_until), F.lit(True))


# --- semantic coordinates of labels: fixed values, by priority -------------------------------------------------------
CONCEPTS = {
    "assets": (7, 1, 1), "currentassets": (7, 1, 2), "cash": (7, 1, 3), "cashandcashequivalents": (7, 1, 3), "inventory": (7, 1, 4), "accountsreceivable": (7, 1, 5),
    "liabilities": (7, 1, 10), "currentliabilities": (7, 1, 11), "longtermdebt": (7, 1, 12), "accountspayable": (7, 1, 13),
    "stockholdersequity": (7, 1, 20), "retainedearnings": (7, 1, 21),
    "revenues": (7, 2, 1), "revenue": (7, 2, 1), "costofrevenue": (7, 2, 10), "grossprofit": (7, 2, 11), "operatingincome": (7, 2, 13), "netincome": (7, 2, 20),
}
TIME_WORDS = ("date", "time", "year", "month", "quarter", "period", "timestamp", "duration", "interval", "fiscal")
QUANTITY_WORDS = (
    "amount", "total", "count", "number", "rate", "ratio", "percent", "revenue", "cost", "price", "earnings", "income", "loss", "profit",
    "dosage", "dose", "volume", "weight", "measure", "score",
)
QUANTITY_TEXT = r"\$|%|usd|eur|\d+\s*(mg|kg|ml|g|lb)"
LOCATION_WORDS = (
    "city", "country", "region", "area", "zone", "sector", "district", "location", "address", "coordinate", "grid", "position", "site",
    "hospital", "facility", "base", "installation", "france", "paris", "london", "berlin", "tokyo", "beijing", "moscow", "usa", "uk", "germany",
    "japan", "china", "russia", "canada", "australia", "street", "avenue", "road", "highway", "port", "harbor", "airport",
)
ACTION_WORDS = (
    "event", "operation", "attack", "procedure", "treatment", "process", "transaction", "transfer", "payment", "purchase", "sale", "decision",
    "announcement", "mandate", "requirement",
)
ABSTRACT_WORDS = (
    "claim", "fact", "statement", "concept", "theory", "opinion", "belief", "narrative", "hypothesis", "assertion", "conclusion", "policy",
    "doctrine", "rule", "constraint", "roe",
)
PERSON_WORDS = ("person", "individual", "personnel", "officer", "soldier", "patient")
ENTITY_WORDS = (
    "organization", "company", "corp", "inc", "llc", "ltd", "agency", "department", "ministry", "bureau", "unit", "force", "command", "person",
    "individual", "personnel", "officer", "soldier", "patient", "dr", "mr", "mrs", "ms", "gen", "col", "maj", "sgt", "pvt", "lt", "product",
    "drug", "medication", "device", "system", "platform", "document", "report", "manual", "regulation", "directive", "order",
)
MAJOR_NAMES = {1: "Entity", 2: "Action", 3: "Property", 4: "Relation", 5: "Location", 6: "Time", 7: "Quantity", 8: "Abstract"}
TYPE_NAMES = {
    (1, 1): "Organization", (1, 2): "Person", (1, 3): "Product", (1, 4): "Service", (1, 5): "Document", (1, 6): "System",
    (2, 1): "Event", (2, 2): "Transaction", (2, 3): "Process", (2, 4): "Announcement", (2, 5): "Decision",
    (3, 1): "Attribute", (3, 2): "State", (3, 3): "Feature",
    (5, 1): "Address", (5, 2): "City", (5, 3): "Region", (5, 4): "Country",
    (6, 1): "Date", (6, 2): "Period", (6, 3): "Timestamp",
    (7, 1): "Financial", (7, 2): "Revenue", (7, 3): "Count", (7, 4): "Measure",
    (8, 1): "Claim", (8, 2): "Opinion", (8, 3): "Narrative", (8, 4): "Concept",
}


def _coordinates(major: int, kind: int, subtype: int) -> Column:
    return F.struct(F.lit(major).alias("major"), F.lit(kind).alias("type"), F.lit(subtype).alias("subtype"))


def coordinates(label: Column) -> Column:
    """Struct (major, type, subtype) of a label: known financial concepts, else the first kind of word that it has."""
    norm = F.lower(F.trim(label))
    words = F.split(norm, r"(?U)\W+")

    def has(known: list[str]) -> Column:
        return F.arrays_overlap(words, F.array(*map(F.lit, known)))

    concepts = F.create_map(*[c for name, at in CONCEPTS.items() for c in (F.lit(name), _coordinates(*at))])
    known = F.try_element_at(concepts, F.regexp_replace(norm, "[^a-z]", ""))
    found = (
        F.when(has(TIME_WORDS), _coordinates(6, 1, 1))
        .when(has(QUANTITY_WORDS) | norm.rlike(QUANTITY_TEXT), _coordinates(7, 3, 1))
        .when(has(LOCATION_WORDS), _coordinates(5, 3, 1))
        .when(has(ACTION_WORDS), _coordinates(2, 1, 1))
        .when(has(ABSTRACT_WORDS), _coordinates(8, 1, 1))
        .when(has(PERSON_WORDS), _coordinates(1, 2, 1))
        .when(has(ENTITY_WORDS), _coordinates(1, 1, 1))
        .otherwise(_coordinates(8, 4, 1))
    )
    return F.coalesce(known, found)


#: The classification that a colour stands for.
CLASSIFICATIONS = {"Green": "UNCLASSIFIED", "Yellow": "CUI", "Red": "SECRET", "Black": "TOP SECRET"}


def classification(colour: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CLASSIFICATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, colour), F.lit("UNCLASSIFIED"))


def tag_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def context_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean of equal domain, equal scenario and, where both have tags, their overlap."""
    base = (a["domain"] == b["domain"]).cast("double") + (a["scenario"] == b["scenario"]).cast("double")
    tagged = (F.size(a["tags"]) > 0) & (F.size(b["tags"]) > 0)
    return F.when(tagged, (base + tag_jaccard(a["tags"], b["tags"])) / 3).otherwise(base / 2)


def improvement_pct(baseline: Column, improved: Column) -> Column:
    return F.coalesce(F.try_divide(improved - baseline, baseline) * 100, F.lit(0.0))


def chunk_estimate(lines: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(lines * 2 / 20)).cast("long")
