"""Configuration checks that tell every problem at once, and a readiness list."""

from __future__ import annotations

import codecs
import re

from veldmark.functions.filters import OPERATORS, RecordFilter
from veldmark.functions.transforms import KINDS, FieldMapping, Settings
from veldmark.operators.screening import IDENTITY, Profile
from veldmark.sources.delimited import Structure


def structure_problems(s: Structure) -> list[str]:
    out = []
    try:
        codecs.lookup(s.charset)
    except LookupError:
        out.append("CONFIG_CHARSET_UNKNOWN")
    if not s.delimiter:
        out.append("CONFIG_DELIMITER_MISSING")
    elif len(s.delimiter) != 1 or s.delimiter in "\r\n":
        out.append("CONFIG_DELIMITER_INVALID")
    if s.quote is not None and (len(s.quote) != 1 or s.quote == s.delimiter):
        out.append("CONFIG_QUOTE_INVALID")
    if s.header_line < 0 or (s.header_line == 0 and not s.by_index):
        out.append("CONFIG_HEADER_LINE_INVALID")
    if s.column_count is not None and s.column_count < 1:
        out.append("CONFIG_COLUMN_COUNT_INVALID")
    if not s.fields or len({f.strip().lower() for f in s.fields}) != len(s.fields):
        out.append("CONFIG_FIELD_REFERENCE_INVALID")
    elif s.by_index and not all(re.fullmatch("[1-9][0-9]*", f) for f in s.fields):
        out.append("CONFIG_FIELD_REFERENCE_INVALID")
    return out


def filter_problems(filters: list[RecordFilter], s: Structure) -> list[str]:
    known = {f.strip().lower() for f in s.fields}
    out = []
    for f in filters:
        if f.operator not in OPERATORS or f.action not in ("INCLUDE", "EXCLUDE", "REJECT"):
            out.append(f"CONFIG_FILTER_INVALID:{f.column}")
        if f.column.strip().lower() not in known and f.on_missing == "BLOCK":
            out.append(f"FILTER_COLUMN_MISSING:{f.column}")
    return out


def mapping_problems(targets: list[tuple[str, str]], catalogue: dict[str, str], s: Structure) -> list[str]:
    """targets: (target field, source field); catalogue: target field to type."""
    known, seen, out = {f.strip().lower() for f in s.fields}, set(), []
    for target, source in targets:
        if target not in catalogue:
            out.append(f"CONFIG_MAPPING_TARGET_UNKNOWN:{target}")
        if target in seen:
            out.append(f"CONFIG_MAPPING_DUPLICATE_TARGET:{target}")
        seen.add(target)
        if source.strip().lower() not in known:
            out.append(f"CONFIG_MAPPING_SOURCE_UNRESOLVED:{target}")
    return out


def transform_problems(mappings: tuple[FieldMapping, ...], s: Structure) -> list[str]:
    """Kinds, settings and columns of transforms; a mapping with an unknown kind is told once, its settings are not looked at."""
    known, out = {f.strip().lower() for f in s.fields}, []
    for m in mappings:
        if m.kind not in KINDS:
            out.append(f"CONFIG_TRANSFORM_INVALID:{m.target}")
            continue
        try:
            given = Settings.parse(m.settings)
            given.check_used(KINDS[m.kind])
            if m.kind == "MAP":
                given.table("values")
        except ValueError:
            out.append(f"CONFIG_TRANSFORM_INVALID:{m.target}")
            continue
        v = given.values
        alternatives = [k for k in ("operand", "operandField", "base", "baseField") if k in KINDS[m.kind]]
        lacking = sorted(KINDS[m.kind] - set(v) - {"separator", "caseSensitive", "scale", *alternatives} | ({"separator"} - set(v) if m.kind == "SPLIT" else set()))
        number = [v[k] for k in ("index", "scale") if k in v]
        if lacking or (alternatives and sum(k in v for k in alternatives) != 1) or not all(re.fullmatch("[0-9]+", n) for n in number):
            out.append(f"CONFIG_TRANSFORM_INVALID:{m.target}")
        columns = given.items("sources") + [v[k] for k in ("operandField", "baseField") if k in v]
        out += [f"CONFIG_MAPPING_SOURCE_UNRESOLVED:{m.target}" for c in columns if c.strip().lower() not in known]
    return out


def profile_problems(profile: Profile, price_model: str = "DEVIATION") -> dict[str, list[str]]:
    """Every problem of a screening profile by check. Checks that build on a sound structure are skipped where it isn't."""
    found = {"structure": structure_problems(profile.structure)}
    if found["structure"]:
        return found | {"skipped": ["INFO_CONFIG_CHECKS_SKIPPED"]}
    targets = [m.target for m in profile.mappings]
    types = dict.fromkeys([*IDENTITY, "discount", "description", "currency", *profile.reference_types], "TEXT") | {"base_price": "DECIMAL"}
    free = {*profile.article_fields, *(c.target for c in profile.components), *(c.currency for c in profile.components)}
    types |= {m.target: m.type for m in profile.mappings if m.target in free}
    found["filters"] = filter_problems(list(profile.filters), profile.structure)
    found["mappings"] = mapping_problems([(m.target, m.source or profile.structure.fields[0]) for m in profile.mappings], types, profile.structure)
    found["mappings"] += [f"CONFIG_MAPPING_TYPE_INCOMPATIBLE:{m.target}" for m in profile.mappings if types.get(m.target, m.type) != m.type]
    found["transforms"] = transform_problems(profile.mappings, profile.structure)
    found["identity"] = [f"CONFIG_IDENTITY_FIELD_MISSING:{t}" for t in IDENTITY if t not in targets]
    found["prices"] = ([] if "base_price" in targets else ["CONFIG_PRICE_FIELD_MISSING"]) + ([] if price_model == "DEVIATION" else ["CONFIG_PRICE_CONTROL_MODEL_UNSUPPORTED"])
    found["references"] = [f"CONFIG_FIELD_NOT_RESOLVED:{t}" for t in profile.reference_types if t not in targets]
    link = profile.link_currency
    found["currency"] = [] if link is None or re.fullmatch("[A-Z]{3}", link) else ["CONFIG_LINK_CURRENCY_INVALID"]
    found["criticality"] = [f"CONFIG_FIELD_CRITICALITY_INVALID:{c}" for c in profile.critical_fields if c not in targets]
    found["version"] = [] if profile.version in (1, 2) else ["CONFIG_CANONICALISATION_VERSION_UNSUPPORTED"]
    return found


def readiness(checks: dict[str, list[str]], linked: dict[str, bool] | None = None) -> list[tuple[str, str]]:
    """(check, READY or its problems) in order, then whether what a link needs is there (a source, a schedule, an owner ...), and READY for the link if all is."""
    rows = [(name, "READY" if not found else ", ".join(found)) for name, found in checks.items()]
    rows += [(name, "READY" if there else "MISSING") for name, there in (linked or {}).items()]
    return [*rows, ("link", "READY" if all(state == "READY" for _, state in rows) else "NOT_READY")]
