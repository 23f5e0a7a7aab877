"""Strict configuration: unknown and missing keys are errors."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints


def strict(kind: type, data: dict[str, Any], where: str = "config") -> Any:
    """A dataclass from a mapping, with nested dataclasses; each key must be known and each required one there."""
    known = {f.name: f for f in fields(kind)}
    if extra := sorted(set(data) - set(known)):
        raise ValueError(f"{where}: unknown keys {', '.join(extra)}")
    if missing := sorted(n for n, f in known.items() if n not in data and f.default is MISSING and f.default_factory is MISSING):
        raise ValueError(f"{where}: missing keys {', '.join(missing)}")
    hints = get_type_hints(kind)
    return kind(**{k: strict(hints[k], v, f"{where}.{k}") if is_dataclass(hints[k]) and isinstance(v, dict) else v for k, v in data.items()})


@dataclass(frozen=True)
class RewardConfig:
    correctness: float = 1.0
    format: float = 0.0
    length_penalty: float = 0.0


@dataclass(frozen=True)
class MetricsConfig:
    expected_group_size: int
    pass_at: tuple[int, ...] = (1,)


@dataclass(frozen=True)
class RunConfig:
    name: str
    dataset: str
    num_samples: int
    metrics: MetricsConfig
    reward: RewardConfig = field(default_factory=RewardConfig)

    def __post_init__(self) -> None:
        if self.num_samples < 1 or any(k < 1 or k > self.num_samples for k in self.metrics.pass_at):
            raise ValueError("pass_at needs numbers from 1 to num_samples")


@dataclass(frozen=True)
class Correction:
    """How off-policy data are corrected: importance weights, rejection, both or none."""

    weights: str | None = None  # token or sequence
    upper: float | None = 2.0
    band: tuple[float, float] | None = None
    rejection: str | None = None  # a mode of functions.arrays.rejection_mask
    threshold: str | float | None = None
    bypass: bool = False  # the rollout policy stands in for the old one
    loss: str = "ppo_clip"


def _presets() -> dict[str, Correction]:
    """Every preset by name: what is weighed, what is rejected, and whether the old policy is bypassed."""
    # Weights and rejections by their part of the names, with their thresholds.
    token, sequence, banded = {"weights": "token"}, {"weights": "sequence"}, {"weights": "token", "upper": None, "band": (0.5, 5.0)}
    geometric, k3, ratio = {"rejection": "seq_mean_k1", "threshold": "0.999_1.001"}, {"rejection": "seq_mean_k3", "threshold": 0.01}, {"rejection": "seq_sum_k1", "threshold": "0.5_2.0"}
    decoupled = {
        "token_is": token, "seq_is": sequence, "token_icepop": banded, "seq_is_rs": sequence | ratio, "geo_rs": geometric, "geo_rs_seq_tis": geometric | sequence, "geo_rs_token_tis": geometric | token, "k3_rs": k3, "k3_rs_seq_tis": k3 | sequence,
        "k3_rs_token_tis": k3 | token}
    clipped = {"": {}, "_geo_rs": geometric, "_k3_rs": k3}
    gradient = {"is": sequence, "token_icepop": banded, "geo_rs": geometric, "geo_rs_seq_tis": geometric | sequence, "geo_rs_token_tis": geometric | token}
    out = {f"decoupled_{k}": Correction(**v) for k, v in decoupled.items()}
    out |= {f"bypass_ppo_clip{k}": Correction(**v, bypass=True) for k, v in clipped.items()}
    out |= {f"bypass_pg_{k}": Correction(**v, bypass=True, loss="reinforce") for k, v in gradient.items()}
    return out | {"disabled": Correction()}


PRESETS = _presets()
