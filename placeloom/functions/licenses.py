"""License stamps: canonical names, and what may enter a bundle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of licenses and their canonical names, and kinds that never enter a bundle.
ALIASES = {
    "apache-2.0": "Apache-2.0", "apache-license-2.0": "Apache-2.0", "apache2.0": "Apache-2.0", "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc0": "CC0-1.0", "cc0-1.0": "CC0-1.0",
    "cdla-permissive-2.0": "CDLA-Permissive-2.0", "lgpl-3.0": "LGPL-3.0", "lgpl-3.0-only": "LGPL-3.0", "lgpl-3.0-or-later": "LGPL-3.0", "lgpl-as-dependency": "LGPL-3.0", "mit": "MIT", "odbl": "ODbL-1.0",
    "odbl-1.0": "ODbL-1.0", "ofl": "OFL-1.1", "ofl-1.1": "OFL-1.1", "pd": "PD", "public-domain": "PD",
}
NEVER_KINDS = ("open_web", "review_provider")
# Trust of source kinds, least first; unknown kinds come last.
TRUST = {"overture": 0, "wikidata": 0, "wikivoyage": 1, "wikipedia": 1, "commons": 1, "osm": 2, "opening_hours_js": 2, "user": 3, "review_provider": 4, "open_web": 4}


def canonical(license_id: Column) -> Column:
    """The canonical name, or null for licenses that are not allowed."""
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.try_element_at(names, F.lower(F.regexp_replace(license_id, r"\s+", "")))


def bundleable(kind: Column, license_id: Column) -> Column:
    return ~F.coalesce(kind.isin(*NEVER_KINDS), F.lit(False)) & canonical(license_id).isNotNull()


def trust_rank(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TRUST.items() for x in pair)), kind), F.lit(max(TRUST.values()) + 1))


def canonical_sql(column: str) -> str:
    """The same for the oracle."""
    whens = " ".join(f"when '{a}' then '{c}'" for a, c in ALIASES.items())
    return f"case lower(regexp_replace({column}, '\\s+', '', 'g')) {whens} end"


def bundleable_sql(kind: str, license_id: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in NEVER_KINDS)
    return f"({kind} not in ({kinds}) and {canonical_sql(license_id)} is not null)"


def trust_sql(kind: str) -> str:
    return f"case {kind} " + " ".join(f"when '{k}' then {r}" for k, r in TRUST.items()) + f" else {max(TRUST.values()) + 1} end"
