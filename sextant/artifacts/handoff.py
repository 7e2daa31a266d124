"""Handoffs, audits, injection plans, adapter configs, and their publication.

A platform handoff pins a bundle manifest, the catalog's and the registry's; a research handoff
pins a research export instead of the bundle. An audit recomputes all of it for one
consumer; a plan says where a runtime puts the payload; an adapter config ties them to a strategy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from ..plans.contracts import known_consumers
from ..sources.files import sha256_file
from . import bundles as B
from . import documents as D
from .commits import commit
from . import governance as G

_STATE = (
    "all_known_source_families_present", "all_consumer_contracts_satisfied", "all_runtime_consumers_covered", "consumer_contract_count", "consumer_contracts",
    "all_known_consumers_present", "canonical_registry_payload_sha256", "local_registry_payload_sha256", "local_contract_registry_verified",
)
_LINKS = ("source_family_catalog_manifest", "consumer_contract_registry_manifest")


@dataclass(frozen=True)
class Gates:
    """What a handoff must satisfy beyond holding together."""

    families: bool = False
    consumers: bool = False
    runtime: bool = False
    accepted: tuple[str, ...] = (D.FRESH,)


def _governed(catalog_manifest: str | Path, registry_manifest: str | Path, gates: Gates) -> tuple[dict[str, Any], list[dict]]:
    """State of catalog and registry, and the catalog's records."""
    c = G.validate_pinned("catalog", catalog_manifest, gates.families)
    r = G.validate_pinned("registry", registry_manifest, gates.consumers)
    D.check(c["all_runtime_consumers_covered"] or not gates.runtime, "the catalog doesn't cover all runtime consumers")
    state = {
        "all_known_source_families_present": c["all_known_families_present"], "all_consumer_contracts_satisfied": c["all_consumer_contracts_satisfied"],
        "all_runtime_consumers_covered": c["all_runtime_consumers_covered"], "consumer_contract_count": r["consumer_count"], "consumer_contracts": r["consumers"],
        "all_known_consumers_present": r["all_known_consumers_present"],
    } | {k: r[k] for k in _STATE[-3:]}
    return state, D.read(c["catalog_path"])["families"]


def matching_families(records: Iterable[Mapping[str, Any]], bundle: Mapping[str, Any], consumer: str | None) -> list[str]:
    """Families of the bundle's transform and policy that list the consumer as runtime and
    hold all symbols and fields of the bundle."""
    symbols = {s.upper().removesuffix(".US") for s in bundle["symbols"]}
    fields = {f.lower() for x in bundle["indicator_fields_by_symbol"].values() for f in x}
    return [
        r["family"]
        for r in records
        if r["transform"] == bundle["transform"]
        and r["freshness_policy"] == bundle["freshness_policy"]
        and (not consumer or consumer in r["runtime_consumers"])
        and symbols <= set(r["symbols"])
        and fields <= {f.lower() for f in r["derived_indicator_fields"]}
    ]


def research_families(records: Iterable[Mapping[str, Any]], transform: str, consumer: str | None) -> list[str]:
    """Families of the export's transform that are compatible with the consumer."""
    return [r["family"] for r in records if r["transform"] == transform and (not consumer or consumer in r["compatible_profiles"])]


def _platform(root: Path, bundle: str | Path, catalog: str | Path, registry: str | Path, consumer: str | None, gates: Gates) -> dict[str, Any]:
    """The handoff document that these files make."""
    b = B.validate_manifest(bundle, consumer, gates.accepted)
    state, records = _governed(catalog, registry, gates)
    D.check(not consumer or consumer in state["consumer_contracts"], f"the registry has no contract of {consumer}")
    matched = matching_families(records, b, consumer)
    D.check(matched, f"no source family matches transform {b['transform']} for {consumer or 'any consumer'}")
    links = D.pins(root, signal_bundle_manifest=bundle, source_family_catalog_manifest=catalog, consumer_contract_registry_manifest=registry)
    return state | links | {
        "schema_version": D.HANDOFF, "artifact_type": "market_signal_platform_handoff", "consumer": consumer or "", "canonical_input": b["canonical_input"],
        "bundle_id": b["bundle_id"], "as_of": b["as_of"], "freshness_status": b["freshness_status"], "source_family_count": len(records),
        "source_families": [r["family"] for r in records], "matched_source_family_count": len(matched), "matched_source_families": matched,
    }


def _research(root: Path, export: str | Path, catalog: str | Path, registry: str | Path, consumer: str | None, gates: Gates) -> dict[str, Any]:
    e = B.validate_export(export)
    state, records = _governed(catalog, registry, gates)
    D.check(not consumer or consumer in state["consumer_contracts"], f"the registry has no contract of {consumer}")
    matched = research_families(records, e["transform"], consumer)
    D.check(matched, f"no source family matches transform {e['transform']} for {consumer or 'any consumer'}")
    links = D.pins(root, research_export_manifest=export, source_family_catalog_manifest=catalog, consumer_contract_registry_manifest=registry)
    return state | links | {
        "schema_version": D.RESEARCH_HANDOFF, "artifact_type": "market_signal_research_handoff", "consumer": consumer or "", "research_artifact_type": e["artifact_type"],
        "research_transform": e["transform"], "research_as_of": e["as_of"], "research_output_csv_sha256": e["output_csv_sha256"],
        "research_quality_report_sha256": e["quality_report_sha256"], "source_families": matched, "source_family_count": len(matched),
    }


_MADE = {D.HANDOFF: (_platform, "signal_bundle_manifest"), D.RESEARCH_HANDOFF: (_research, "research_export_manifest")}


def write_handoff(path: str | Path, main: str | Path, catalog: str | Path, registry: str | Path, consumer: str | None = None, gates: Gates = Gates(), research: bool = False) -> dict[str, Any]:
    """A platform (or research) handoff beside or above the files it pins, read again once written."""
    version = D.RESEARCH_HANDOFF if research else D.HANDOFF
    consumer = (consumer or "").strip() or None
    D.write(path, _MADE[version][0](Path(path).parent, main, catalog, registry, consumer, gates))
    return validate_handoff(path, consumer, gates)


def validate_handoff(path: str | Path, consumer: str | None = None, gates: Gates = Gates()) -> dict[str, Any]:
    """Everything a handoff pins, recomputed and equal to what it says; links become full paths."""
    h = D.read(path)
    D.check(h.get("schema_version") in _MADE, f"{path} is no handoff")
    make, main = _MADE[h["schema_version"]]
    D.no_sensitive_keys(h, "handoff")
    files = [D.pinned(Path(path).parent, h, name) for name in (main, *_LINKS)]
    own = h.get("consumer") or None
    D.check(not consumer or own in (None, consumer), f"the handoff is for {own}, not {consumer}")
    made = make(Path(path).parent, *files, consumer or own, gates)
    D.same(h, made, [k for k in made if k != "consumer" and not (consumer and not own and "matched" in k)], "handoff and its files")
    full = {f"{name}_path": str(f) for name, f in zip((main, *_LINKS), files, strict=True)}
    return D.with_file(path, made | full | {"summary_verified": True})


# ---- index of handoffs

_ENTRY = (
    "consumer", "canonical_input", "bundle_id", "as_of", "freshness_status", "source_families", "matched_source_families", "matched_source_family_count", *_STATE[:3],
    *_STATE[4:],
)


def _index_entry(root: Path, handoff: str | Path, gates: Gates) -> dict[str, Any]:
    summary = validate_handoff(handoff, None, gates)
    return D.pins(root, handoff_manifest=handoff) | {k: summary[k] for k in _ENTRY}


def write_handoff_index(path: str | Path, handoffs: Iterable[str | Path], generated_at: str | None = None, gates: Gates = Gates(), keep: Iterable[dict] = ()) -> dict[str, Any]:
    path = Path(path)
    index = _handoffs([*keep, *(_index_entry(path.parent, h, gates) for h in handoffs)], generated_at)
    commit(path, lambda _: index)
    return _indexed(path, index)


def _handoffs(entries: list[dict[str, Any]], generated_at: str | None) -> dict[str, Any]:
    D.check(entries, "an index needs a handoff")
    entries = sorted(entries, key=lambda e: (e["as_of"], e["bundle_id"], e["consumer"], e["handoff_manifest_path"]))
    latest = max(e["as_of"] for e in entries)
    return {"schema_version": D.HANDOFF_INDEX, "artifact_type": "market_signal_platform_handoff_index", "generated_at": generated_at or f"{latest}T00:15:00Z", "handoffs": entries}


def _indexed(path: Path, index: dict[str, Any]) -> dict[str, Any]:
    return D.with_file(path, {"handoff_count": len(index["handoffs"]), "generated_at": index["generated_at"]})


def upsert_handoff(path: str | Path, handoff: str | Path, generated_at: str | None = None, gates: Gates = Gates(), per_consumer: bool = False) -> dict[str, Any]:
    """Put a handoff in place of the one of the same bundle, date and input. Consumers share that
    identity unless ``per_consumer``. Writers may do so at once (``commits``)."""
    fields = ("bundle_id", "as_of", "canonical_input", *(["consumer"] if per_consumer else []))
    identity = lambda e: [e[f] for f in fields]
    path = Path(path)
    new = _index_entry(path.parent, handoff, gates)

    def put(index: dict[str, Any] | None) -> dict[str, Any]:
        return _handoffs([*(e for e in (index or {}).get("handoffs", []) if identity(e) != identity(new)), new], generated_at)

    return _indexed(path, commit(path, put)[1])


def validate_handoff_index(path: str | Path, consumer: str | None = None, as_of: str | None = None, gates: Gates = Gates(), canonical: str = D.DERIVED) -> dict[str, Any]:
    """The newest handoff that serves the consumer by ``as_of``, validated."""
    index = D.read(path)
    D.schema(index, D.HANDOFF_INDEX)

    def fits(e: dict) -> bool:
        serves = not consumer or consumer == e.get("consumer") or consumer in e.get("consumer_contracts", ())
        return serves and e.get("canonical_input") == canonical and (as_of is None or str(e.get("as_of")) <= as_of) and str(e.get("freshness_status")).lower() in gates.accepted

    entry = D.newest(index.get("handoffs") or [], fits, ("as_of", "bundle_id", "consumer", "handoff_manifest_path"), "handoff of the index")
    handoff = D.pinned(Path(path).parent, entry, "handoff_manifest")
    summary = validate_handoff(handoff, consumer, gates)
    D.same(entry, summary, [k for k in _ENTRY if k != "consumer"], "index entry and handoff")
    return summary | {"index_path": str(path), "index_handoff_count": len(index["handoffs"])}


# ---- audits, plans, adapter configs


def audit(consumer: str, *, handoff: str | None = None, index: str | None = None, research: str | None = None, as_of: str | None = None, gates: Gates = Gates()) -> dict[str, Any]:
    """What a consumer would read from exactly one source, and that it may."""
    D.check(sum(x is not None for x in (handoff, index, research)) == 1, "give exactly one of handoff, index and research handoff")
    runtime = research is None
    if index is not None:
        s, source = validate_handoff_index(index, consumer, as_of, gates), "platform_handoff_index"
    else:
        s, source = validate_handoff(handoff or research, consumer, gates), "platform_handoff_manifest" if runtime else "research_handoff_manifest"
        D.check((s["schema_version"] == D.HANDOFF) == runtime, "the handoff is of the other kind")
    D.check(consumer.startswith("research:") != runtime, f"{consumer} doesn't consume from {source}")
    D.check(runtime or s["research_as_of"], "a research export without as_of can't be audited")
    skip = ("schema_version", "artifact_type", "path", "sha256", "size_bytes", "consumer", "summary_verified")
    head = {
        "schema_version": D.AUDIT, "artifact_type": "market_signal_consumption_audit", "consumption_mode": "runtime_platform" if runtime else "offline_research",
        "handoff_source": source, "consumer": consumer, "consumer_role": "runtime" if runtime else "research", "ready_for_consumption": True,
        "ready_for_runtime_injection": runtime, "ready_for_research_consumption": not runtime, "runtime_injection_allowed": runtime,
        "research_csv_runtime_injection_allowed": False, "handoff_manifest_path": s["path"], "handoff_manifest_sha256": s["sha256"],
        "linked_manifest_sha256s_verified": True, "consumer_contract_verified": True, "source_catalog_verified": True,
    }
    keys: dict[str, Any] = {"summary_verified": True}
    if runtime:
        key = s["canonical_input"]
        keys = {
            "runtime_market_data_key": key, "runtime_payload_field": key, "index_path": s.get("index_path", ""),
            "index_handoff_count": s.get("index_handoff_count", 0), "lookup_as_of": as_of or "",
        }
    return {k: v for k, v in s.items() if k not in skip} | head | keys


def validate_audit(document: Mapping[str, Any]) -> dict[str, Any]:
    D.schema(document, D.AUDIT)
    D.no_sensitive_keys(document, "audit")
    D.required(document, "consumer", "consumption_mode", "handoff_manifest_path", "handoff_manifest_sha256", owner="audit")
    for flag in ("ready_for_consumption", "linked_manifest_sha256s_verified", "consumer_contract_verified", "source_catalog_verified"):
        D.check(document.get(flag) is True, f"{flag} must be true")
    runtime = document["consumption_mode"] == "runtime_platform"
    D.check(document.get("runtime_injection_allowed") is runtime and document.get("research_csv_runtime_injection_allowed") is False, "injection flags contradict the mode")
    D.required(document, *(("bundle_id", "as_of", "runtime_market_data_key") if runtime else ("research_transform", "research_as_of")), owner="audit")
    digests = ("canonical_registry_payload_sha256", "local_registry_payload_sha256", "local_contract_registry_verified")
    D.check(len({d in document for d in digests}) == 1, "registry digests come together or not at all")
    if digests[0] in document:
        for d in digests[:2]:
            D.digest_text(document[d], d)
        D.check(document[digests[2]] is True, "the registry isn't the local one")
    return {k: document[k] for k in ("consumer", "consumption_mode", "ready_for_runtime_injection")}


# Fields of a plan and their names in the audit.
_PLAN = (
    "consumer", "canonical_input", "bundle_id", "as_of", "freshness_status", "signal_bundle_manifest_path", "signal_bundle_manifest_sha256", "handoff_manifest_path",
    "handoff_manifest_sha256", "source_family_catalog_manifest_sha256", "consumer_contract_registry_manifest_sha256", "canonical_registry_payload_sha256",
    "local_registry_payload_sha256", "local_contract_registry_verified", ("market_data_key", "runtime_market_data_key"), ("payload_field", "runtime_payload_field"),
    "source_families", "matched_source_families", "consumer_contracts",
)


def injection_plan(audited: Mapping[str, Any]) -> dict[str, Any]:
    """Where a runtime puts the payload; only from an audit that allows it."""
    D.schema(audited, D.AUDIT)
    D.check(audited.get("ready_for_runtime_injection") is True and audited.get("runtime_injection_allowed") is True, "the audit doesn't allow injection")
    pairs = [(f, f) if isinstance(f, str) else f for f in _PLAN]
    D.required(audited, *(a for _, a in pairs), owner="audit")
    return {"schema_version": D.PLAN, "artifact_type": "market_signal_runtime_injection_plan", "injection_allowed": True, "target_path": f"market_data.{audited['runtime_market_data_key']}"} | {p: audited[a] for p, a in pairs}


def validate_plan(document: Mapping[str, Any]) -> dict[str, Any]:
    D.schema(document, D.PLAN)
    D.no_sensitive_keys(document, "plan")
    D.required(document, *(f if isinstance(f, str) else f[0] for f in _PLAN), owner="plan")
    D.check(document.get("injection_allowed") is True, "injection_allowed must be true")
    D.check(document.get("target_path") == f"market_data.{document['market_data_key']}", "target_path doesn't fit market_data_key")
    return {"consumer": document["consumer"], "target_path": document["target_path"]}


def plan_matches(plan: Mapping[str, Any], audited: Mapping[str, Any]) -> None:
    """Both are valid and agree on all fields of the plan."""
    validate_plan(plan)
    validate_audit(audited)
    D.same(plan, audited, _PLAN, "plan and audit")


def audits_agree(saved: Mapping[str, Any], now: Mapping[str, Any]) -> None:
    """All fields of the current audit but its paths are as saved."""
    D.same(saved, now, [k for k in now if k not in _AUDIT_PATHS], "saved and current audit")


def validate_plan_matches_audit(plan: str | Path, audited: str | Path) -> dict[str, Any]:
    p, a = D.read(plan), D.read(audited)
    plan_matches(p, a)
    return {"schema_version": D.PLAN_MATCH, "consumer": p["consumer"], "plan_sha256": sha256_file(plan), "audit_sha256": sha256_file(audited), "matched_field_count": len(_PLAN)}


def _gates(config: Mapping[str, Any]) -> Gates:
    flags = []
    for name in ("require_all_known_families", "require_all_known_consumers", "require_runtime_consumer_coverage"):
        D.check(isinstance(config.get(name, False), bool), f"{name} must be true or false")
        flags.append(config.get(name, False))
    return Gates(*flags, accepted=tuple(D.texts(config.get("accepted_freshness_statuses", [D.FRESH]), "accepted_freshness_statuses")))


def validate_adapter(config: Mapping[str, Any]) -> dict[str, Any]:
    """One strategy's config: a runtime consumer and exactly one place to look."""
    D.schema(config, D.ADAPTER)
    D.no_sensitive_keys(config, "adapter_config")
    D.required(config, "strategy", "signal_consumer", owner="adapter config")
    D.check(not config["signal_consumer"].startswith("research:"), "a runtime adapter can't consume research signals")
    places = [k for k in ("signal_handoff_index", "signal_handoff_manifest") if str(config.get(k) or "").strip()]
    D.check(len(places) == 1, "give exactly one of signal_handoff_index and signal_handoff_manifest")
    D.check(places[0] != "signal_handoff_index" or str(config.get("signal_as_of") or "").strip(), "a lookup by index needs signal_as_of")
    D.check(not config.get("saved_runtime_plan_json") or config.get("saved_consumption_audit_json"), "a saved plan needs a saved audit")
    _gates(config)
    return {"strategy": config["strategy"], "consumer": config["signal_consumer"], "handoff_source": places[0]}


def _beside(config: str | Path, path: str) -> Path:
    return Path(path) if Path(path).is_absolute() else Path(config).parent / path


_AUDIT_PATHS = ("handoff_manifest_path", "signal_bundle_manifest_path", "source_family_catalog_manifest_path", "consumer_contract_registry_manifest_path", "index_path")


def validate_deployment(path: str | Path) -> dict[str, Any]:
    """Config, saved audit and saved plan agree with an audit made afresh."""
    config = D.read(path)
    summary = validate_adapter(config)
    D.required(config, "saved_consumption_audit_json", "saved_runtime_plan_json", owner="deployed config")
    place = {"signal_handoff_index": "index", "signal_handoff_manifest": "handoff"}[summary["handoff_source"]]
    where = str(_beside(path, config[summary["handoff_source"]]))
    now = audit(config["signal_consumer"], **{place: where}, as_of=config.get("signal_as_of") or None, gates=_gates(config))
    saved_path, plan_path = (_beside(path, config[k]) for k in ("saved_consumption_audit_json", "saved_runtime_plan_json"))
    saved = D.read(saved_path)
    validate_audit(saved)
    audits_agree(saved, now)
    for k in _AUDIT_PATHS:
        same = str(Path(str(saved.get(k, ""))).expanduser().resolve()) == str(Path(str(now.get(k, ""))).resolve())
        D.check(same or not now.get(k), f"saved and current audit differ on {k}")
    match = validate_plan_matches_audit(plan_path, saved_path)
    return summary | {"schema_version": D.DEPLOYMENT, "path": str(path), "as_of": now["as_of"], "bundle_id": now["bundle_id"], "plan_audit_match": match, "current_audit_verified": True}


def validate_adapter_set(paths: Iterable[str | Path], complete: bool = False, deployed: bool = False) -> dict[str, Any]:
    """Configs of different consumers; ``complete``: of every runtime consumer."""
    found = [validate_deployment(p) if deployed else validate_adapter(D.read(p)) for p in paths]
    D.check(found, "a set needs a config")
    twice = [c for c, n in Counter(f["consumer"] for f in found).items() if n > 1]
    D.check(not twice, f"several configs of {', '.join(twice)}")
    missing = sorted(set(known_consumers(runtime_only=True)) - {f["consumer"] for f in found})
    D.check(not (complete and missing), f"no config of {', '.join(missing)}")
    return {"schema_version": D.DEPLOYMENT_SET if deployed else D.ADAPTER_SET, "config_count": len(found), "consumers": sorted(f["consumer"] for f in found), "missing_runtime_consumers": missing, "configs": found}


# ---- publication


def consumer_stem(consumer: str) -> str:
    return consumer.translate(str.maketrans(":/\\", "___"))


def publish(
    directory: str | Path, bundle_manifest: str | Path, consumer: str, *, index: str | Path | None = None, as_of: str | None = None, strategy: str | None = None,
    gates: Gates = Gates(True, True, True),
) -> dict[str, Any]:
    """Registry, catalog, handoff, index, audit, plan and adapter config for one consumer, each read
    again once written, all inside ``directory`` but the index, which by default lies beside it."""
    root = Path(directory).resolve()
    D.inside(root, bundle_manifest)
    registry = G.write_pinned("registry", root, G.registry())
    catalog = G.write_pinned("catalog", root, G.catalog())
    stem = consumer_stem(consumer)
    handoff_path, index_path = root / f"{stem}.handoff.json", Path(index).resolve() if index else root.parent / "index.json"
    # Entries are relative to the index, which therefore lies in the publication's folder or above it.
    D.check(index_path.parent == root or index_path.is_relative_to(root) or root.is_relative_to(index_path.parent), f"{index_path} must lie in {root} or above it")
    handoff = write_handoff(handoff_path, bundle_manifest, catalog["manifest_path"], registry["manifest_path"], consumer, gates)
    indexed = upsert_handoff(index_path, handoff_path, gates=gates)
    as_of = as_of or handoff["as_of"]
    audited = audit(consumer, index=str(index_path), as_of=as_of, gates=gates)
    audit_path, plan_path, config_path = (root / f"{stem}.{x}.json" for x in ("audit", "plan", "adapter"))
    validate_audit(audited)
    D.write(audit_path, audited)
    plan = injection_plan(audited)
    validate_plan(plan)
    D.write(plan_path, plan)
    D.write(config_path, {
        "schema_version": D.ADAPTER, "strategy": strategy or consumer.split(":", 1)[-1], "signal_consumer": consumer, "signal_handoff_index": str(index_path), "signal_as_of": as_of,
        "accepted_freshness_statuses": list(gates.accepted), "require_all_known_families": gates.families, "require_all_known_consumers": gates.consumers,
        "require_runtime_consumer_coverage": gates.runtime, "saved_consumption_audit_json": str(audit_path), "saved_runtime_plan_json": str(plan_path),
    })
    return {
        "schema_version": D.PUBLICATION, "artifact_type": "market_signal_platform_publication", "publication_dir": str(root), "consumer": consumer, "as_of": handoff["as_of"],
        "lookup_as_of": as_of, "signal_bundle_manifest_path": str(bundle_manifest), "consumer_contract_registry_manifest_path": registry["manifest_path"],
        "source_family_catalog_manifest_path": catalog["manifest_path"], "platform_handoff_manifest_path": str(handoff_path), "platform_handoff_index_path": str(index_path),
        "consumption_audit_path": str(audit_path), "runtime_plan_path": str(plan_path), "runtime_adapter_config_path": str(config_path), "handoff": handoff, "index": indexed,
        "audit": audited, "runtime_plan": plan, "runtime_adapter_deployment": validate_deployment(config_path),
    }
