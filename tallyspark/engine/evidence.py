"""Evidence envelopes: what a result was computed from, so that it can be checked."""

from __future__ import annotations

import hashlib
import time
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Evidence:
    """How an operator reached its result."""

    operator: str
    method: str
    plan: list[str] = field(default_factory=list)
    rows_scanned: int | None = None
    rows_used: int | None = None
    nulls_dropped: int | None = None
    duration_ms: float = 0.0
    caveats: list[str] = field(default_factory=list)
    parameters: dict[str, Any] = field(default_factory=dict)
    assumptions: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    truncated: bool = False
    causal_claim: bool = False

    @property
    def query_sha256(self) -> str:
        return hashlib.sha256("\n".join(self.plan).encode()).hexdigest()

    def as_dict(self) -> dict[str, Any]:
        return asdict(self) | {"query_sha256": self.query_sha256}


class Recorder:
    """Times an operator and keeps the plans of the frames it ran."""

    def __init__(self, operator: str, method: str, **parameters: Any) -> None:
        self.evidence = Evidence(operator, method, parameters=parameters)
        self._began = time.perf_counter()

    def ran(self, df: DataFrame) -> DataFrame:
        self.evidence.plan.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    def done(self, **known: Any) -> Evidence:
        for k, v in known.items():
            setattr(self.evidence, k, v)
        self.evidence.duration_ms = (time.perf_counter() - self._began) * 1000
        return self.evidence
