"""Registry of consumer contracts, catalog of source families, and the ownership matrix."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

from ..plans.contracts import CONSUMERS, DOMAINS, FAMILIES, families_of_domain, family_record, known_consumers, required_fields
from ..sources.files import sha256_file
from . import documents as D


def _contract(consumer: str) -> dict[str, Any]:
    return {
        "consumer": consumer,
        "canonical_input": D.DERIVED,
        "required_indicator_fields_by_symbol": {s: list(f) for s, f in sorted(required_fields(consumer).items())},
    }


def registry(consumers: Iterable[str] | None = None) -> dict[str, Any]:
    names = known_consumers() if consumers is None else list(consumers)
    return {"schema_version": D.REGISTRY, "canonical_input": D.DERIVED, "contracts": [_contract(c) for c in names]}


def registry_digest(document: Mapping[str, Any]) -> str:
    """SHA-256 of the registry with its contracts by consumer, in compact sorted JSON."""
    ordered = dict(document) | {"contracts": sorted(document["contracts"], key=lambda c: c["consumer"])}
    return hashlib.sha256(json.dumps(ordered, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def validate_registry(document: Mapping[str, Any], complete: bool = False) -> dict[str, Any]:
    """Each contract is known, comes once and equals the local one."""
    D.schema(document, D.REGISTRY)
    D.check(document.get("canonical_input") == D.DERIVED, f"canonical_input must be {D.DERIVED}")
    contracts = document.get("contracts")
    D.check(isinstance(contracts, list) and contracts, "a registry needs contracts")
    names = D.texts([c.get("consumer") for c in contracts], "consumers")
    for c in contracts:
        D.check(D.json_safe(c) == _contract(c["consumer"]), f"the contract of {c['consumer']} has drifted")
    D.no_sensitive_keys(document, "registry")
    missing = sorted(set(CONSUMERS) - set(names))
    D.check(not (complete and missing), f"the registry lacks {', '.join(missing)}")
    mine, local = registry_digest(document), registry_digest(registry(names))
    return {
        "schema_version": D.REGISTRY, "canonical_input": D.DERIVED, "consumer_count": len(names), "consumers": names, "known_consumer_count": len(CONSUMERS),
        "missing_known_consumers": missing, "all_known_consumers_present": not missing, "canonical_registry_payload_sha256": mine,
        "local_registry_payload_sha256": local, "local_contract_registry_verified": mine == local,
    }


def coverage(record: Mapping[str, Any]) -> dict[str, list[str]]:
    """By consumer of a family: required `symbol.field` that the family lacks."""
    fields, symbols = {f.lower() for f in record["derived_indicator_fields"]}, set(record["symbols"])
    return {
        c: [f"{s}.{f}" for s, need in required_fields(c).items() for f in need if s not in symbols or f.lower() not in fields]
        for c in record["compatible_profiles"]
    }


def runtime_coverage(records: Iterable[Mapping[str, Any]]) -> dict[str, Any]:
    """Which families serve each runtime consumer, and what contradicts that."""
    known = known_consumers(runtime_only=True)
    served: dict[str, list[str]] = {c: [] for c in known}
    unknown, errors, seen = set(), [], set()
    for r in records:
        for c in r["runtime_consumers"]:
            seen.add(c)
            if c.startswith("research:"):
                errors.append(f"{r['family']}:research_consumer_marked_runtime")
            elif c in served:
                served[c].append(r["family"])
            else:
                unknown.add(c)
        errors += [f"{r['family']}:runtime_consumer_marked_research" for c in r["research_consumers"] if not c.startswith("research:")]
        if set(r["runtime_consumers"]) | set(r["research_consumers"]) != set(r["compatible_profiles"]):
            errors.append(f"{r['family']}:consumers_differ_from_compatible_profiles")
    bare = [c for c, families in served.items() if not families]
    return {
        "known_runtime_consumers": known, "runtime_consumers": sorted(seen), "runtime_consumer_source_families": served, "runtime_consumers_without_source_family": bare,
        "unknown_runtime_consumers": sorted(unknown), "consumer_scope_errors": errors, "all_runtime_consumers_covered": not (bare or unknown or errors),
    }


def ownership_matrix(consumers: Iterable[str] | None = None) -> dict[str, Any]:
    records = []
    for c in known_consumers() if consumers is None else consumers:
        need = {f"{s}.{f}" for s, fields in required_fields(c).items() for f in fields}
        owners = [r for r in FAMILIES.values() if c in r["compatible_profiles"]]
        have = {f"{s}.{f}" for r in owners for s in r["symbols"] for f in r["derived_indicator_fields"]}
        records.append({
            "consumer": c, "consumer_kind": "research" if c.startswith("research:") else "runtime", "source_families": sorted(r["family"] for r in owners),
            "publication_lag_policies": list(dict.fromkeys(p["publication_lag_policy"] for r in owners for p in r["source_profiles"])),
            "missing_required_fields": sorted(need - have), "all_required_fields_covered": need <= have,
        })
    runtime = [r for r in records if r["consumer_kind"] == "runtime"]
    return {
        "schema_version": D.OWNERSHIP, "consumer_count": len(records), "runtime_consumer_count": len(runtime), "consumers": records,
        "all_runtime_consumers_have_source_family": all(r["source_families"] for r in runtime),
        "all_runtime_consumers_cover_required_fields": all(r["all_required_fields_covered"] for r in runtime),
    }


def catalog(families: Iterable[str] | None = None, domains: Iterable[str] | None = None) -> dict[str, Any]:
    if families is not None and domains is not None:
        raise ValueError("give families or domains, not both")
    if domains is not None:
        families = dict.fromkeys(f for d in domains for f in families_of_domain(d))
    return {"schema_version": D.CATALOG, "domain_coverage": DOMAINS, "families": [family_record(f) for f in (sorted(FAMILIES) if families is None else families)]}


def validate_domains(document: Mapping[str, Any]) -> dict[str, int]:
    """Domains name known families once each, and plan none that exists."""
    implemented = [f for d in document.values() for f in d["implemented_families"]]
    planned = [f for d in document.values() for f in d["planned_families"]]
    repeated = [f for f, n in Counter(implemented + planned).items() if n > 1]
    D.check(not repeated, f"families in several places: {', '.join(repeated)}")
    D.check(set(implemented) <= set(FAMILIES), f"unknown families: {', '.join(sorted(set(implemented) - set(FAMILIES)))}")
    D.check(set(FAMILIES) <= set(implemented), f"families of no domain: {', '.join(sorted(set(FAMILIES) - set(implemented)))}")
    return {"domain_count": len(document), "implemented_family_count": len(implemented), "planned_family_count": len(planned)}


# What a source profile must say.
_PROFILE_TEXTS = ("source_name", "provider_dataset", "history_frequency", "point_in_time_status", "publication_lag_policy", "research_use_policy")


def profile_summary(record: Mapping[str, Any]) -> dict[str, Any]:
    """Source profiles of a family in short, each checked; an older record has none."""
    if record.get("source_profiles") is None:
        return {"source_profile_count": 0, "source_ids": [], "covered_fields": [], "profiles": []}
    family, profiles = record["family"], record["source_profiles"]
    D.check(isinstance(profiles, list) and profiles and all(isinstance(p, Mapping) for p in profiles), f"{family} needs a list of source profiles")
    known, short = {f.lower() for f in record["derived_indicator_fields"]}, []
    for p in profiles:
        D.required(p, "source_id", *_PROFILE_TEXTS, owner=f"a source profile of {family}")
        fields = D.texts(p.get("produced_fields"), f"produced_fields of {p['source_id']}")
        D.check({f.lower() for f in fields} <= known, f"{p['source_id']} produces fields its family lacks")
        limit = p.get("max_allowed_lag_days")
        D.check(limit is None or isinstance(limit, int) and not isinstance(limit, bool) and limit >= 0, f"{p['source_id']} has a bad lag limit")
        short.append({"source_id": p["source_id"], "produced_fields": fields} | {k: p[k] for k in ("point_in_time_status", "history_frequency", "max_allowed_lag_days") if p.get(k) is not None})
    ids = D.texts([p["source_id"] for p in profiles], f"source ids of {family}")
    return {"source_profile_count": len(ids), "source_ids": ids, "covered_fields": sorted({f for p in short for f in p["produced_fields"]}), "profiles": short}


def validate_catalog(document: Mapping[str, Any], complete: bool = False) -> dict[str, Any]:
    """Records equal the local ones (an older one may lack source profiles) and satisfy their consumers."""
    D.schema(document, D.CATALOG)
    records = document.get("families")
    D.check(isinstance(records, list) and records, "a catalog needs families")
    names = D.texts([r.get("family") for r in records], "families")
    profiles = {}
    for r in records:
        local = family_record(r["family"])
        D.check(D.json_safe(r) in (local, {k: v for k, v in local.items() if k != "source_profiles"}), f"the record of {r['family']} has drifted")
        lacks = {c: x for c, x in coverage(r).items() if x}
        D.check(not lacks, f"{r['family']} doesn't cover {lacks}")
        profiles[r["family"]] = profile_summary(r)
    missing = sorted(set(FAMILIES) - set(names))
    D.check(not (complete and missing), f"the catalog lacks {', '.join(missing)}")
    D.no_sensitive_keys(document, "catalog")
    domains = document.get("domain_coverage")
    found = validate_domains(domains) if domains else {"domain_count": 0, "implemented_family_count": 0, "planned_family_count": 0}
    return found | {
        "schema_version": D.CATALOG, "family_count": len(names), "families": names, "known_family_count": len(FAMILIES), "missing_known_families": missing,
        "all_known_families_present": not missing, "domain_coverage_present": bool(domains), "domains": sorted(domains or ()), "source_profile_count": sum(p["source_profile_count"] for p in profiles.values()), "source_profile_coverage": profiles,
        "all_consumer_contracts_satisfied": True, "all_runtime_consumers_covered": runtime_coverage(records)["all_runtime_consumers_covered"],
    }


_KINDS = {
    "registry": (D.REGISTRY_MANIFEST, "market_signal_consumer_contract_registry", validate_registry, "market_signal_consumers"),
    "catalog": (D.CATALOG_MANIFEST, "market_signal_source_family_catalog", validate_catalog, "signal_source_families"),
}


def write_pinned(kind: str, directory: str | Path, document: Mapping[str, Any]) -> dict[str, Any]:
    """The registry or catalog and a manifest that pins it; the manifest's summary."""
    version, artifact, validate, stem = _KINDS[kind]
    root = Path(directory)
    summary = validate(document)
    D.write(root / f"{stem}.json", document)
    manifest = {"schema_version": version, "artifact_type": artifact, f"{kind}_size_bytes": (root / f"{stem}.json").stat().st_size, f"{kind}_schema_version": document["schema_version"]}
    manifest |= D.pins(root, **{kind: root / f"{stem}.json"}) | {k: v for k, v in summary.items() if k != "schema_version"}
    D.write(root / f"{stem}.manifest.json", manifest)
    return validate_pinned(kind, root / f"{stem}.manifest.json")


def validate_pinned(kind: str, path: str | Path, complete: bool = False) -> dict[str, Any]:
    """The manifest and what it pins; a summary with both paths and hashes."""
    version, artifact, validate, _ = _KINDS[kind]
    m = D.read(path)
    D.schema(m, version)
    D.check(m.get("artifact_type") == artifact, f"artifact_type must be {artifact}")
    target = D.pinned(Path(path).parent, m, kind)
    summary = {k: v for k, v in validate(D.read(target), complete).items() if k != "schema_version"}
    D.same(m, summary | {f"{kind}_size_bytes": target.stat().st_size}, (*summary, f"{kind}_size_bytes"), f"manifest and {kind}")
    return summary | {"manifest_path": str(path), "manifest_sha256": sha256_file(path), f"{kind}_path": str(target), f"{kind}_sha256": m[f"{kind}_sha256"]}
