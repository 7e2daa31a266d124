"""The engine's functions under one name each."""

from .artifacts.bundles import (
    bundle,
    bundle_summary,
    context_availability,
    cycle_payloads,
    family_bundle,
    public_context_availability,
    quality_report,
    rotation_payloads,
    technical_payloads,
    upsert_index,
    validate_bundle,
    validate_export,
    validate_for_consumer,
    validate_index,
    validate_manifest,
    validate_quality,
    write_bundle,
    write_export,
    write_index,
)
from .artifacts.documents import ValidationError
from .artifacts.governance import catalog, ownership_matrix, registry, runtime_coverage, validate_catalog, validate_pinned, validate_registry, write_pinned
from .artifacts.handoff import (
    Gates,
    audit,
    injection_plan,
    publish,
    upsert_handoff,
    validate_adapter,
    validate_adapter_set,
    validate_audit,
    validate_deployment,
    validate_handoff,
    validate_handoff_index,
    validate_plan,
    validate_plan_matches_audit,
    write_handoff,
    write_handoff_index,
)
from .operators.indicators import (
    RotationParams,
    cycle_base,
    cycle_frame,
    expanding_percentile,
    latest,
    price_proxy,
    public_context,
    rotation_frame,
    rotation_latest,
    technical_frame,
)
from .operators.joins import as_of_join, same_day_join
from .operators.normalize import context, cycle, metric, ohlcv, technical
from .operators.quality import context_report, gap_stats, ohlcv_report, staleness
from .plans.contracts import ContractError, families_of_domain, family_record, known_consumers, required_fields
from .sources.files import csv_provenance, load_ohlcv, resolve_as_of, sha256_file, sha256_files, write_csv

__all__ = [name for name in dir() if not name.startswith("_")]
