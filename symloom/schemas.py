"""Schemas of the engine's tables and nested documents, and checks of their value domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SYMBOLS = "id string not null, name string not null, kind string not null, path string not null, line int not null, signature string, parent_id string, file_sha string, language string"
CLAIMS = "claim_id long not null, source string not null, source_path string not null, source_sha string not null, severity string not null, claim string not null, rationale string, excerpt string"
CLAIM_SYMBOLS = "claim_id long not null, symbol_id string not null"
COMMITS = "sha string not null, date string not null, message string not null, author_email string not null"
FILE_COMMITS = "file_path string not null, commit_sha string not null"
SOURCE_SHAS = "source_path string not null, source_sha string not null"
META = "key string not null, value string not null"
REFS = "ordinal int not null, ref_id string not null, symbol_id string not null, path string not null, line int not null, col int"
TYPE_EDGES = "symbol_id string not null, relation string not null, name string not null, ordinal int not null"
DIAGNOSTICS = "path string not null, line int not null, col int, severity string not null, message string not null"
EXTRACTED_CLAIMS = "source_path string not null, ordinal int not null, symbol_candidates array<string>, claim string not null, severity string not null, rationale string, excerpt string"
FRONTMATTER = "source_path string not null, symbols array<string>"
FILES = "path string not null, sha string not null, bucket string"
ARTIFACT = (
    "version string, generated_at string, extracted_at_sha string, generator map<string, string>, source_shas map<string, string>, "
    "symbols array<struct<id: string, name: string, kind: string, path: string, line: int, signature: string, parent_id: string, file_sha: string>>, "
    "claims array<struct<source: string, source_path: string, source_sha: string, severity: string, claim: string, rationale: string, excerpt: string, symbol_ids: array<string>>>, "
    "git_commits array<struct<sha: string, date: string, message: string, author_email: string, files: array<string>>>"
)

# The domains that artifacts and requests use.
KINDS = ("class", "interface", "function", "method", "type", "enum", "variable", "module", "other")
SEVERITIES = ("hard", "soft", "context")
LANGUAGES = {"ts": "typescript", "py": "python", "go": "go"}
DEPTHS = ("summary", "standard", "deep")
SIGNALS = ("refs", "intent", "git", "types", "tests")
ARTIFACT_VERSIONS = ("1.0", "1.1", "1.2", "1.3")


def outside_domain(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not in the domain."""
    return df.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False)))


def dangling(links: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Links to rows that do not exist."""
    return links.join(targets.select(F.col(key).alias(column)).distinct(), column, "left_anti")
