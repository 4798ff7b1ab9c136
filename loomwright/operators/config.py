"""Settings: fixed defaults, global ones, and what a project overrides, field by field."""

from __future__ import annotations

from typing import Any

#: Defaults, limits and the names of fields.
EMBEDDING = {"provider": "candle", "modelId": "sentence-transformers/all-MiniLM-L6-v2", "dimension": 384}
INDEX = {"backend": "simple_file", "metric": "cosine"}
BACKENDS, METRICS = ("simple_file", "lancedb"), ("cosine", "dot", "l2")
RETRIEVAL = {
    "reranker": {"enabled": True, "topK": 30, "finalK": 5},
    "hybrid": {"enabled": True, "rrfK": 60.0, "denseWeight": 0.5, "sparseWeight": 0.5, "denseTopK": 50, "sparseTopK": 50},
}
PERFORMANCE = {"embeddingBatchSize": 32, "maxFileSizeBytes": 1_000_000, "maxFileLines": 10_000}

Settings = dict[str, Any]


def _part(settings: Settings, *names: str) -> Settings:
    for n in names:
        settings = settings.get(n) or {}
    return settings


def _first(settings: Settings, section: str, base: str, fixed: Settings) -> Settings:
    """A base's own settings, else the default ones, else the fixed ones; fields that a section leaves out are the fixed ones."""
    found = _part(settings, section, "bases").get(base) or _part(settings, section).get("default") or {}
    return {k: fixed[k] if found.get(k) is None else found[k] for k in fixed}


def embedding_of(base: str, settings: Settings, project: Settings | None = None) -> Settings:
    """The model of a base: the project's for it, the project's default, the global one for it, the global default, the fixed one."""
    for own in (project or {}, settings):
        if _part(own, "embeddings", "bases").get(base) or _part(own, "embeddings").get("default"):
            return _first(own, "embeddings", base, EMBEDDING)
    return dict(EMBEDDING)


def index_of(base: str, settings: Settings, project: Settings | None = None) -> Settings:
    """backend, metric, dimension of a base's vectors; unknown names mean the fixed ones."""
    own = next((s for s in (project or {}, settings) if _part(s, "indexes", "bases").get(base) or _part(s, "indexes").get("default")), {})
    out = _first(own, "indexes", base, INDEX)
    out["backend"] = out["backend"] if out["backend"] in BACKENDS else INDEX["backend"]
    out["metric"] = out["metric"] if out["metric"] in METRICS else INDEX["metric"]
    return out | {"dimension": embedding_of(base, settings, project)["dimension"]}


def retrieval_of(settings: Settings, project: Settings | None = None) -> Settings:
    """Fusion and rerank settings, each field the project's, else the global one, else the fixed one."""
    out = {}
    for part, fixed in RETRIEVAL.items():
        layers = [_part(project or {}, "retrieval", part), _part(settings, "retrieval", part)]
        out[part] = {k: next((s[k] for s in layers if s.get(k) is not None), v) for k, v in fixed.items()}
    return out


def performance_of(settings: Settings) -> Settings:
    own = _part(settings, "performance")
    return {k: v if own.get(k) is None else own[k] for k, v in PERFORMANCE.items()}


def resolved(settings: Settings, project: Settings | None = None, bases: tuple[str, ...] = ("code", "docs", "memory")) -> Settings:
    """All settings as they hold."""
    return {
        "embeddings": {b: embedding_of(b, settings, project) for b in bases}, "indexes": {b: index_of(b, settings, project) for b in bases},
        "retrieval": retrieval_of(settings, project), "performance": performance_of(settings), "projectOverrides": _part(project or {}, "retrieval"),
    }


def _retrieval_problems(r: Settings) -> tuple[list[str], list[str]]:
    errors, warnings = [], []
    rerank, hybrid = r["reranker"], r["hybrid"]
    errors += [f"retrieval.reranker.{k} cannot be 0" for k in ("topK", "finalK") if rerank[k] == 0]
    if rerank["finalK"] > rerank["topK"]:
        warnings.append(f"retrieval.reranker.finalK ({rerank['finalK']}) > topK ({rerank['topK']}): topK counts")
    if rerank["topK"] > 1000:
        warnings.append(f"retrieval.reranker.topK ({rerank['topK']}) is very large")
    if hybrid["enabled"]:
        if hybrid["rrfK"] <= 0:
            errors.append("retrieval.hybrid.rrfK must be positive")
        errors += [f"retrieval.hybrid.{k} cannot be negative" for k in ("denseWeight", "sparseWeight") if hybrid[k] < 0]
        errors += [f"retrieval.hybrid.{w}TopK cannot be 0 when {w}Weight > 0" for w in ("dense", "sparse") if hybrid[f"{w}TopK"] == 0 and hybrid[f"{w}Weight"] > 0]
        total = hybrid["denseWeight"] + hybrid["sparseWeight"]
        if abs(total - 1) > 0.01:
            warnings.append(f"retrieval.hybrid weights sum to {total:g}")
    return errors, warnings


def validate(settings: Settings, project: Settings | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of the settings as they hold."""
    errors, warnings = _retrieval_problems(retrieval_of(settings, project))
    p = performance_of(settings)
    if p["embeddingBatchSize"] == 0:
        errors.append("performance.embeddingBatchSize cannot be 0")
    if p["embeddingBatchSize"] > 512:
        warnings.append(f"performance.embeddingBatchSize ({p['embeddingBatchSize']}) is very large")
    if p["maxFileSizeBytes"] < 1024:
        warnings.append(f"performance.maxFileSizeBytes ({p['maxFileSizeBytes']}) leaves most files out")
    if p["maxFileSizeBytes"] > 100 * 1024 * 1024:
        warnings.append(f"performance.maxFileSizeBytes ({p['maxFileSizeBytes']}) is very large")
    if p["maxFileLines"] < 10:
        warnings.append(f"performance.maxFileLines ({p['maxFileLines']}) leaves most files out")
    return errors, warnings
