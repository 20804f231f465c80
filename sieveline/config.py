"""Configuration: frozen dataclasses with defaults that are behaviour, read from YAML and checked. Unknown keys are errors."""

from __future__ import annotations

import dataclasses
import types
import typing
from dataclasses import dataclass, field
from urllib.parse import urlsplit

# Hosts that count as local, and below the keys and defaults of the configuration format.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1", "0.0.0.0")


@dataclass(frozen=True)
class Source:
    backend: str
    root: str
    manifest: str


@dataclass(frozen=True)
class Inference:
    provider: str = "mock"
    model_version: str = "mock-0"
    approval_written: bool = False
    is_local: bool = True
    base_url: str | None = None
    api_key_env: str | None = None
    hash_key_env: str | None = None
    mock_hints: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.base_url and self.is_local and urlsplit(self.base_url).hostname not in LOCAL_HOSTS:
            raise ValueError("inference.is_local is set, but base_url names another host")


@dataclass(frozen=True)
class Extract:
    engine: str = "decode"
    docling_url: str | None = None
    tika_url: str | None = None


@dataclass(frozen=True)
class OcrGate:
    min_text_density: float = 0.15
    min_printable_ratio: float = 0.85
    max_image_coverage: float = 0.5


@dataclass(frozen=True)
class Ocr:
    provider: str = "stub"
    url: str | None = None


@dataclass(frozen=True)
class Recogniser:
    """literal: characters that every match holds; texts without them are not searched. Empty: all are."""

    rule_id: str
    category: str
    pattern: str
    reason_code: str = ""
    literal: str = ""


@dataclass(frozen=True)
class Detect:
    engine: str = "regex"
    recognisers: tuple[Recogniser, ...] = ()
    presidio_language: str = "en"
    presidio_score_threshold: float = 0.35
    presidio_url: str | None = None
    detector_version: str = "detect-presidio-0.1"
    category_map: dict[str, str] = field(default_factory=dict)
    deterministic_entities: tuple[str, ...] = ()


@dataclass(frozen=True)
class Taxonomy:
    version: str = "tax-0"
    categories: tuple[str, ...] = ()


@dataclass(frozen=True)
class Semantic:
    enabled: bool = False
    model: str = "sentence-transformers/all-MiniLM-L6-v2"
    route_threshold: float = 0.35
    threshold_version: str = "sem-0"
    examples: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Calibration:
    artefact: str | None = None
    version: str = "cal-0"
    min_positives: int = 100
    max_holdout_error: float = 5.0
    method: str = "sigmoid"


@dataclass(frozen=True)
class Scoring:
    flag_threshold: float = 40.0
    band_high: float = 80.0
    band_medium: float = 60.0
    calibration: Calibration = field(default_factory=Calibration)


@dataclass(frozen=True)
class Output:
    result_dir: str = "results"
    format: str = "jsonl"


@dataclass(frozen=True)
class Config:
    source: Source
    config_version: str = "0"
    seed: int = 0
    inference: Inference = field(default_factory=Inference)
    extract: Extract = field(default_factory=Extract)
    ocr_gate: OcrGate = field(default_factory=OcrGate)
    ocr: Ocr = field(default_factory=Ocr)
    detect: Detect = field(default_factory=Detect)
    taxonomy: Taxonomy = field(default_factory=Taxonomy)
    semantic: Semantic = field(default_factory=Semantic)
    scoring: Scoring = field(default_factory=Scoring)
    output: Output = field(default_factory=Output)


def _build(kind, value, at: str):
    origin = typing.get_origin(kind)
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ValueError(f"{at}: a mapping is expected")
        hints = typing.get_type_hints(kind)
        if unknown := set(value) - set(hints):
            raise ValueError(f"{at}: unknown keys {sorted(unknown)}")
        required = {f.name for f in dataclasses.fields(kind) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
        if missing := required - set(value):
            raise ValueError(f"{at}: missing keys {sorted(missing)}")
        return kind(**{k: _build(hints[k], v, f"{at}.{k}") for k, v in value.items()})
    if origin is tuple:
        return tuple(_build(typing.get_args(kind)[0], v, at) for v in value)
    if origin is dict:
        return {str(k): _build(typing.get_args(kind)[1], v, at) for k, v in value.items()}
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if origin in (types.UnionType, typing.Union):
        return None if value is None else _build(next(k for k in typing.get_args(kind) if k is not type(None)), value, at)
    if isinstance(kind, type) and not isinstance(value, kind):
        raise ValueError(f"{at}: {kind.__name__} is expected")
    return value


def from_mapping(value: object) -> Config:
    if not isinstance(value, dict):
        raise ValueError("the configuration is not a mapping")
    return _build(Config, value, "config")


def load(path: str) -> Config:
    """Reads a YAML file on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f))


def ensure_egress_allowed(crosses_boundary: bool, approval_written: bool) -> None:
    """Run before a plan with a remote provider, and again in its workers: text leaves only with a written approval."""
    if crosses_boundary and not approval_written:
        raise PermissionError("the provider is outside the boundary and no written approval is recorded")
