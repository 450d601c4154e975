"""Names of retrieval conditions and their checks (driver side)."""

from __future__ import annotations

from collections.abc import Iterable

# Condition names and the words composite names are built from.
BASE_CONDITIONS = ("text", "actual_gaze", "mean_gaze", "shuffled_gaze", "actual_skip_hard", "predicted_trt_gaze")
DEFAULT_EMBEDDED = ("text", "actual_gaze", "mean_gaze", "shuffled_gaze")
GAIN_CONDITIONS = ("actual_gaze", "mean_gaze", "shuffled_gaze")
HYBRID_HEAD = "hybrid_gaze_alpha_"
RERANK_HEAD, RERANK_TAIL = "text_top", "_gaze_rerank"
POOL_MAXSIM = "actual_gaze_pool_maxsim"
BARE_MODEL = "bare_model"


def hybrid_name(alpha: float) -> str:
    return HYBRID_HEAD + format(alpha, ".6g").replace(".", "p")


def is_hybrid(name: str) -> bool:
    return name.startswith(HYBRID_HEAD)


def hybrid_alpha(name: str) -> float:
    """Alpha as the label carries it: six significant digits."""
    if not is_hybrid(name):
        raise ValueError(f"{name} is no hybrid condition")
    return float(name[len(HYBRID_HEAD):].replace("p", "."))


def rerank_name(candidates: int) -> str:
    return f"{RERANK_HEAD}{candidates}{RERANK_TAIL}"


def is_rerank(name: str) -> bool:
    return name.startswith(RERANK_HEAD) and name.endswith(RERANK_TAIL)


def rerank_candidates(name: str) -> int:
    if not is_rerank(name):
        raise ValueError(f"{name} is no rerank condition")
    return int(name[len(RERANK_HEAD):-len(RERANK_TAIL)])


def is_pool(name: str) -> bool:
    return name == POOL_MAXSIM


def is_composite(name: str) -> bool:
    return is_hybrid(name) or is_rerank(name) or is_pool(name)


def check_alpha(alpha: float) -> float:
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("hybrid alpha must lie in [0, 1]")
    return alpha


def check_candidates(candidates: int, top_k: int) -> int:
    if candidates <= 0:
        raise ValueError("the number of rerank candidates must be positive")
    if candidates < top_k:
        raise ValueError("the number of rerank candidates must be at least top_k")
    return candidates


def requested(
    conditions: Iterable[str], alphas: Iterable[float] = (), candidates: Iterable[int] = (), top_k: int = 3
) -> list[str]:
    """All requested conditions once, in order, each checked."""
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    names = [*conditions]
    names += [hybrid_name(check_alpha(a)) for a in alphas]
    names += [rerank_name(check_candidates(n, top_k)) for n in candidates]
    names = list(dict.fromkeys(names))
    unknown = sorted({n for n in names if n not in BASE_CONDITIONS and not is_composite(n)})
    if unknown:
        raise ValueError(f"unsupported conditions: {unknown}")
    for name in names:
        if is_hybrid(name):
            check_alpha(hybrid_alpha(name))
        elif is_rerank(name):
            check_candidates(rerank_candidates(name), top_k)
    return names


def stored_conditions(names: Iterable[str]) -> list[str]:
    """Embedding partitions that must be read for the requested conditions."""
    needed = set()
    for name in names:
        if is_pool(name):
            needed.add("actual_gaze")
        elif is_composite(name):
            needed.update(("text", "actual_gaze"))
        else:
            needed.add(name)
    return sorted(needed)
