"""Settings of a run from a YAML file."""

from __future__ import annotations

from typing import Any

# Every setting with its default.
DEFAULTS = {
    "seed": 13,
    "paths.artifacts_dir": "artifacts",
    "paths.onestop_ia_path": "OneStop-Eye-Movements/data/OneStop/osfstorage-archive (1)/ia_Paragraph.csv.zip",
    "paths.onestop_qa_json_path": "OneStop-Eye-Movements/data_preprocessing/onestop_qa.json",
    "data.qa_dataset_name": "malmaud/onestop_qa",
    "data.qa_split": None,
    "data.max_examples": None,
    "data.max_readers_per_example": None,
    "chunking.strategy": "sentence",
    "chunking.max_words": 80,
    "chunking.stride": 0,
    "retrieval.top_k": 5,
    "models.encoder_name": "intfloat/e5-large-v2",
    "models.generator_name": "meta-llama/Meta-Llama-3-8B-Instruct",
    "models.smoke_generator_fallback_name": None,
    "models.device": "auto",
    "models.dtype": "auto",
}

#: What the stages take, by their argument; the rest is for loaders of plugged-in models.
ARGUMENTS = {
    "gaze_path": "paths.onestop_ia_path", "qa_path": "paths.onestop_qa_json_path", "out": "paths.artifacts_dir",
    "max_examples": "data.max_examples", "max_readers": "data.max_readers_per_example", "top_k": "retrieval.top_k",
}


def settings(given: dict[str, Any]) -> dict[str, Any]:
    """Every setting by its dotted name: the given sections over the defaults. An unknown name is an error."""
    flat: dict[str, Any] = {}
    for section, value in given.items():
        flat |= {f"{section}.{k}": v for k, v in value.items()} if isinstance(value, dict) else {section: value} if value is not None else {}
    if unknown := sorted(set(flat) - set(DEFAULTS)):
        raise ValueError(f"unknown settings: {unknown}")
    return DEFAULTS | flat


def read_settings(path: str) -> dict[str, Any]:
    """The settings a YAML file gives."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return settings(yaml.safe_load(f) or {})


def run_arguments(chosen: dict[str, Any]) -> dict[str, Any]:
    """The settings as arguments of ``plans.stages.run_all``."""
    return {name: chosen[key] for name, key in ARGUMENTS.items()}
