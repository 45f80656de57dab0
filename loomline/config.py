"""Settings from a JSON, TOML or YAML file."""

from __future__ import annotations

import json
import tomllib


def load_config(path: str) -> dict:
    """The settings of a file, by its ending. YAML needs the yaml package. An unreadable file raises what its reader raises."""
    with open(path, "rb") as f:
        if path.endswith(".toml"):
            return tomllib.load(f)
        if path.endswith((".yml", ".yaml")):
            import yaml

            return yaml.safe_load(f) or {}
        return json.load(f)
