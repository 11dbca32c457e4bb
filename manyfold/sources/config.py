"""Configuration from a YAML or JSON file, or from the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, MutableMapping
from dataclasses import dataclass
from pathlib import Path


class ConfigError(ValueError):
    """A configuration that can't be run."""


@dataclass(frozen=True)
class Config:
    target_namespace: str
    source_id_column: str
    source_namespaces: tuple[str, ...] = ()
    source_namespace_pattern: str | None = None
    table_workers: int = 8
    source_workers: int = 8

    def __post_init__(self) -> None:
        missing = [k for k in ("target_namespace", "source_id_column") if not getattr(self, k)]
        if missing:
            raise ConfigError(f"required and missing or empty: {', '.join(missing)}")
        if self.source_namespaces and self.source_namespace_pattern:
            raise ConfigError("source_namespaces and source_namespace_pattern are both set; set exactly one")
        if not self.source_namespaces and not self.source_namespace_pattern:
            raise ConfigError("neither source_namespaces nor source_namespace_pattern is set; set exactly one")
        if self.source_namespaces and len(self.source_namespaces) < 2:
            raise ConfigError("source_namespaces needs at least two namespaces")
        if doubled := sorted({n for n in self.source_namespaces if self.source_namespaces.count(n) > 1}):
            raise ConfigError(f"source_namespaces repeats {', '.join(doubled)}")
        if self.target_namespace in self.source_namespaces:
            raise ConfigError("the target namespace can't be a source")
        for k in ("table_workers", "source_workers"):
            if not isinstance(getattr(self, k), int) or getattr(self, k) < 1:
                raise ConfigError(f"{k} must be a positive whole number")


def _parse(text: str) -> dict:
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        return _plain_yaml(text)


def _plain_yaml(text: str) -> dict:
    """The subset of YAML a configuration needs: scalars, and lists of scalars."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not line.strip():
            continue
        if line.lstrip().startswith("- "):
            if key is None:
                raise ConfigError("a list item without a key")
            out[key] = [*(out[key] or []), line.lstrip()[2:].strip().strip("'\"")]
            continue
        key, _, value = (x.strip() for x in line.partition(":"))
        value = value.strip("'\"")
        out[key] = None if not value else int(value) if value.isdigit() else value
    return out


def load_config(path: str | os.PathLike) -> Config:
    """From a YAML or JSON file."""
    if not Path(path).is_file():
        raise ConfigError(f"no configuration file at {path}")
    got = _parse(Path(path).read_text())
    if not isinstance(got, dict):
        raise ConfigError("the configuration must map keys to values")
    known = Config.__dataclass_fields__
    if unknown := sorted(set(got) - set(known)):
        raise ConfigError(f"unknown: {', '.join(unknown)}")
    names = got.get("source_namespaces") or ()
    if not isinstance(names, (list, tuple)):
        raise ConfigError("source_namespaces must be a list")
    got |= {"source_namespaces": tuple(names)}
    return Config(**{"target_namespace": "", "source_id_column": ""} | {k: v for k, v in got.items() if v is not None})


def load_env(path: str | os.PathLike = ".env", env: MutableMapping[str, str] | None = None) -> dict[str, str]:
    """Read a file of KEY=value lines, if it is there: what the environment has already stays. Keys
    that begin with ``spark.`` (a store's credentials, ``spark.hadoop.fs.s3a.access.key``) are
    returned, as settings of the session."""
    env, spark = os.environ if env is None else env, {}
    for line in Path(path).read_text().splitlines() if Path(path).is_file() else ():
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        if not sep or key.startswith("#"):
            continue
        key, value = key.strip(), value.strip()
        if value[:1] in ("'", '"') and value[-1:] == value[:1]:
            value = value[1:-1]
        if key.startswith("spark."):
            spark[key] = value
        else:
            env.setdefault(key, value)
    return spark


def from_environment(env: Mapping[str, str] | None = None) -> Config:
    """From TARGET_NAMESPACE, SOURCE_ID_COLUMN, SOURCE_NAMESPACES (commas between) or
    SOURCE_NAMESPACE_PATTERN, TABLE_WORKERS and SOURCE_WORKERS."""
    env = os.environ if env is None else env
    names = tuple(x.strip() for x in env.get("SOURCE_NAMESPACES", "").split(",") if x.strip())
    try:
        workers = {k: int(env.get(k.upper(), 8)) for k in ("table_workers", "source_workers")}
    except ValueError as e:
        raise ConfigError("TABLE_WORKERS and SOURCE_WORKERS must be whole numbers") from e
    return Config(
        env.get("TARGET_NAMESPACE", "").strip(), env.get("SOURCE_ID_COLUMN", "").strip(), names,
        env.get("SOURCE_NAMESPACE_PATTERN", "").strip() or None, **workers
    )
