"""Configuration: strict validation of a mapping into dataclasses, with defaults."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from symloom.functions.text import DEFAULT_MATCHES
from symloom.functions.yamltext import YamlError, parse_yaml
from symloom.operators.history import RECENT
from symloom.operators.resolve import ATTRIBUTION_MODES


class ConfigError(ValueError):
    """A configuration value is missing, unknown or of the wrong type."""


@dataclass(frozen=True)
class Adrs:
    path: str = "docs/adr"
    format: str = "markdown-frontmatter"
    symbol_field: str = "symbols"


@dataclass(frozen=True)
class Docs:
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Git:
    recent_commits: int = RECENT


@dataclass(frozen=True)
class Index:
    model: str = ""


@dataclass(frozen=True)
class Artifact:
    committed: bool = True
    path: str = ".symloom/artifact.json"
    local_cache: str = ".symloom/tables"


@dataclass(frozen=True)
class Source:
    root: str = "."


@dataclass(frozen=True)
class Extraction:
    budget_warn_usd: float | None = None
    narrow_attribution: str | None = None


@dataclass(frozen=True)
class Serving:
    symbol_context_bm25: bool = False
    default_limit: int = DEFAULT_MATCHES


@dataclass(frozen=True)
class Config:
    version: int = 1
    languages: tuple[str, ...] = ()
    adrs: Adrs = field(default_factory=Adrs)
    docs: Docs = field(default_factory=Docs)
    git: Git = field(default_factory=Git)
    index: Index = field(default_factory=Index)
    artifact: Artifact = field(default_factory=Artifact)
    source: Source = field(default_factory=Source)
    extraction: Extraction = field(default_factory=Extraction)
    serving: Serving = field(default_factory=Serving)


_SECTIONS = {"adrs": Adrs, "docs": Docs, "git": Git, "index": Index, "artifact": Artifact, "source": Source, "extraction": Extraction, "serving": Serving}
LANGUAGES = ("typescript", "python", "go")
# Another name of a section.
OTHER_NAMES = {"atlas": "artifact"}


def _kind(value: Any) -> str:
    return "null" if value is None else "list" if isinstance(value, (list, tuple)) else "mapping" if isinstance(value, dict) else type(value).__name__


def _checked(where: str, value: Any, default: Any, annotation: str) -> Any:
    if "tuple" in annotation:
        if not isinstance(value, (list, tuple)) or any(not isinstance(v, str) or not v for v in value):
            raise ConfigError(f"{where}: a list of non-empty strings is needed, not {_kind(value)}")
        return tuple(value)
    if annotation == "bool":
        fits = isinstance(value, bool)
    elif annotation == "int":
        fits = isinstance(value, int) and not isinstance(value, bool) and value >= 0
    elif annotation.startswith("float"):
        fits = isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0
    else:
        fits = isinstance(value, str) and bool(value)
    if not fits:
        raise ConfigError(f"{where}: {annotation.split(' |')[0]} is needed, not {_kind(value)}")
    return value


def _section(name: str, kind: type, given: Any) -> Any:
    if not isinstance(given, dict):
        raise ConfigError(f"{name}: a mapping is needed, not {_kind(given)}")
    known = {f.name: f for f in fields(kind)}
    if extra := sorted(set(given) - set(known)):
        raise ConfigError(f"{name}: unknown keys {', '.join(extra)}")
    return kind(**{k: _checked(f"{name}.{k}", v, known[k].default, str(known[k].type)) for k, v in given.items()})


def read_config(path: str) -> Config:
    """The configuration of a YAML file; one that is missing or malformed is an error that names it."""
    try:
        with open(path, encoding="utf-8") as file:
            return load_config(parse_yaml(file.read()))
    except FileNotFoundError:
        raise ConfigError(f"{path}: no such file") from None
    except (YamlError, ConfigError) as error:
        raise ConfigError(f"{path}: {error}") from error


READ = "path string, languages array<string>, adr_path string, include array<string>, recent_commits int, committed boolean, attribution string, error string"


def read_configs(files: DataFrame) -> DataFrame:
    """What the configuration files (path, text) of many code bases say, or in ``error`` why one cannot be used."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame.path, frame.text, strict=True):
                try:
                    c = load_config(parse_yaml(text or ""))
                    rows.append((path, list(c.languages), c.adrs.path, list(c.docs.include), c.git.recent_commits, c.artifact.committed, c.extraction.narrow_attribution, None))
                except (YamlError, ConfigError) as error:
                    rows.append((path, *[None] * 6, str(error)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in READ.split(", ")], dtype=object)

    return files.select("path", "text").mapInPandas(run, READ)


def load_config(given: Any) -> Config:
    """A validated configuration; unknown keys anywhere are errors."""
    if not isinstance(given, dict):
        raise ConfigError(f"a mapping is needed, not {_kind(given)}")
    if both := [k for k, own in OTHER_NAMES.items() if k in given and own in given]:
        raise ConfigError(f"{both[0]}: named twice")
    given = {OTHER_NAMES.get(k, k): v for k, v in given.items()}
    if extra := sorted(set(given) - {f.name for f in fields(Config)}):
        raise ConfigError(f"unknown keys {', '.join(extra)}")
    if given.get("version", 1) != 1:
        raise ConfigError("version: 1 is needed")
    languages = _checked("languages", given.get("languages", []), (), "tuple")
    if not languages:
        raise ConfigError("languages: one at least is needed")
    if wrong := [x for x in languages if x not in LANGUAGES]:
        raise ConfigError(f"languages: unknown {', '.join(wrong)}")
    if len(set(languages)) != len(languages):
        raise ConfigError("languages: named twice")
    sections = {k: _section(k, kind, given[k]) for k, kind in _SECTIONS.items() if k in given}
    mode = sections.get("extraction", Extraction()).narrow_attribution
    if mode is not None and mode not in ATTRIBUTION_MODES:
        raise ConfigError(f"extraction.narrow_attribution: one of {', '.join(ATTRIBUTION_MODES)}")
    return Config(languages=languages, **sections)


def setting(*choices: Any) -> Any:
    """The first that is given: command line, then configuration, then default."""
    return next((c for c in choices if c is not None), None)
