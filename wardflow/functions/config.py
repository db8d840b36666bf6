"""Settings as a plain object: defaults, YAML files merged over them, nested access."""

from __future__ import annotations

import copy
from typing import Any

#: The settings that hold where a file says nothing else.
DEFAULTS: dict[str, Any] = {
    "risk_weights": {
        "intent_classifier": 0.30,
        "houyi_pattern_detector": 0.20,
        "semantic_threat_detector": 0.12,
        "hidden_content_analyzer": 0.08,
        "prompt_injection_detector": 0.12,
        "exfiltration_detector": 0.08,
        "agentic_intent_detector": 0.08,
        "content_deobfuscator": 0.02,
    },
    "other_weight": 0.05,
    "decision_thresholds": {"block": 0.75, "require_approval": 0.40, "sanitize": 0.20, "allow": 0.15},
    "intent_risk_floors": {"malicious": 0.95, "conditional_instructional": 0.70, "instructional": 0.50, "ambiguous": 0.30, "descriptive": 0.0},
    "baseline_risks": {"ocr_extracted": 0.25, "decoded_content": 0.20, "hidden_elements": 0.15, "conditional_language": 0.35},
    "semantic_analysis": {"enabled": True, "similarity_threshold": 0.65},
    "deobfuscation": {"max_recursion_depth": 3, "max_decode_size": 1_000_000, "min_pattern_length": 20},
    "ocr_analysis": {"enabled": True, "baseline_risk": 0.25},
    "enforcement": {"fail_closed": True, "strict_intent_enforcement": True, "require_approval_for_agentic": True},
    "features": {"semantic_detection": True, "active_deobfuscation": True, "ocr_analysis": True, "houyi_detection": True},
}


def _merged(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Config:
    """Immutable settings; ``load`` falls back to the defaults if a file can't be read or is no mapping."""

    def __init__(self, over: dict | None = None) -> None:
        self.values = _merged(DEFAULTS, over or {})

    @classmethod
    def load(cls, path: str | None) -> Config:
        if not path:
            return cls()
        try:
            import yaml

            with open(path, encoding="utf-8") as f:
                read = yaml.safe_load(f)
        except Exception:
            read = None
        return cls(read if isinstance(read, dict) else None)

    def get(self, *keys: str, default: Any = None) -> Any:
        at: Any = self.values
        for k in keys:
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at

    def weight(self, module: str) -> float:
        return self.get("risk_weights", module, default=self.get("other_weight"))

    def threshold(self, name: str) -> float:
        return self.values["decision_thresholds"][name]

    def floor(self, intent: str) -> float:
        return self.get("intent_risk_floors", intent, default=0.0)

    def baseline(self, name: str) -> float:
        return self.get("baseline_risks", name, default=0.0)

    def enabled(self, feature: str) -> bool:
        return bool(self.get("features", feature, default=True))
