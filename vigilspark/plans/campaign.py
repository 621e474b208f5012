"""Campaign descriptions in YAML: what is wrong with one, and its phases' timing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark import domains as D

#: Default timing profiles as (label, share of the phase).
PROFILES = {
    "constant": [("constant", 1.0)],
    "accelerating": [("slow", 0.3), ("medium", 0.4), ("fast", 0.3)],
    "decelerating": [("fast", 0.3), ("medium", 0.4), ("slow", 0.3)],
}


def segments_of(profile: str, phases: list[dict] | None = None) -> list[tuple[str, float]]:
    """Segments of a named profile, or of phases (label, fraction) given; their shares must add up to 1 within 0.01."""
    found = [(str(p["label"]), float(p["fraction"])) for p in phases] if phases else PROFILES.get(profile)
    if found is None:
        raise ValueError(f"no profile {profile!r} without phases; there are {sorted(PROFILES)}")
    if abs(sum(share for _, share in found) - 1) > 0.01:
        raise ValueError("the segments' shares must add up to 1")
    return found


def campaign_errors(text: str) -> list[str]:
    """What makes a campaign's YAML invalid; an empty list if nothing does."""
    import yaml

    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return [f"not YAML: {e}"]
    campaign = raw.get("campaign") if isinstance(raw, dict) else None
    if not isinstance(campaign, dict):
        return ["missing key: campaign"]
    errors = [f"missing key: {key}" for key in ("name", "target", "phases") if key not in campaign]
    if "target" in campaign and "host" not in (campaign["target"] or {}):
        errors.append("missing key: host")
    if "phases" in campaign and not isinstance(campaign["phases"], list):
        errors.append("phases must be a list")
    for k, phase in enumerate(campaign.get("phases") or [] if isinstance(campaign.get("phases"), list) else []):
        errors += [f"phase {k}: {e}" for e in _phase_errors(phase)]
    for k, source in enumerate((campaign.get("collection") or {}).get("log_sources") or []):
        if "name" not in source:
            errors.append(f"log source {k}: missing key: name")
        if source.get("remote_path") is None and source.get("remote_command") is None:
            errors.append(f"log source {k}: remote_path or remote_command is needed")
    return errors


#: What a phase has to name, how its addresses are made.
PHASE_KEYS = ("name", "module", "mitre_technique", "mitre_tactic", "attack_type", "attack_stage", "severity", "ip_source", "timing")
IP_STRATEGIES = ("aliased", "spoofed")


def _phase_errors(phase: object) -> list[str]:
    if not isinstance(phase, dict):
        return ["must be a mapping"]
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    errors = [f"missing key: {key}" for key in PHASE_KEYS if key not in phase]
    for key, known in (("attack_type", D.ATTACK_TYPES), ("attack_stage", D.ATTACK_STAGES)):
        if key in phase and phase[key] not in known:
            errors.append(f"unknown {key}: {phase[key]!r}")
    if "severity" in phase and not (number(phase["severity"]) and 0 <= phase["severity"] <= D.MAX_SEVERITY):
        errors.append(f"severity must be between 0 and {D.MAX_SEVERITY}")
    source = phase.get("ip_source", {})
    if not isinstance(source, dict):
        errors.append("ip_source must be a mapping")
    elif "ip_source" in phase:
        errors += [f"missing key: {key}" for key in ("strategy", "count", "subnet") if key not in source]
        if "strategy" in source and source["strategy"] not in IP_STRATEGIES:
            errors.append(f"unknown strategy: {source['strategy']!r}")
        if "count" in source and not (number(source["count"]) and source["count"] >= 1):
            errors.append("count must be 1 or more")
    timing = phase.get("timing", {})
    if not isinstance(timing, dict):
        return [*errors, "timing must be a mapping"]
    if "timing" in phase:
        if "duration_seconds" not in timing:
            errors.append("missing key: duration_seconds")
        errors += _timing_errors(timing.get("profile", "constant"), (timing.get("profile_params") or {}).get("phases"), number)
    return errors


def _timing_errors(profile: object, parts: list[dict] | None, number: Callable[[object], bool]) -> list[str]:
    if profile not in (*PROFILES, "custom"):
        return [f"unknown profile: {profile!r}"]
    if profile == "constant":
        return []
    errors = []
    for k, part in enumerate(parts or []):
        if missing := [key for key in ("label", "fraction", "jitter_ms") if key not in part]:
            errors += [f"segment {k}: missing key: {key}" for key in missing]
            continue
        if not (number(part["fraction"]) and 0 < part["fraction"] <= 1):
            errors.append(f"segment {k}: fraction must be above 0 and at most 1")
        jitter = part["jitter_ms"]
        if not (isinstance(jitter, list) and len(jitter) == 2 and all(map(number, jitter)) and 0 <= jitter[0] <= jitter[1]):
            errors.append(f"segment {k}: jitter_ms must be a low and a high number")
    if not errors:
        try:
            segments_of(profile, parts)
        except ValueError as e:
            errors.append(str(e))
    return errors


def timing_segment(progress: Column, segments: list[tuple[str, float]]) -> Column:
    """Label of the segment that holds progress, clamped to 0..1; a segment's end belongs to it, what is beyond all to the last."""
    at, end = F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress)), 0.0
    label = F.when(progress.isNull(), F.lit(None).cast("string"))
    for name, share in segments:
        end += share
        label = label.when(at <= end, name)
    return label.otherwise(segments[-1][0])
