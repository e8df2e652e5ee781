"""Dependencies declared in manifests of eight formats."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_SPEC = re.compile(r"^\s*([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*([^;#]*)")
SCHEMA = "path string, name string, version string, dependency_group string"


def _spec(text: str) -> tuple[str, str] | None:
    m = _SPEC.match(text)
    return m and (m[1], m[2].strip())


def _version(v: object) -> str:
    return v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else ""


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _json(text: str) -> dict:
    try:
        v = json.loads(text)
    except ValueError:
        return {}
    return v if isinstance(v, dict) else {}


def dependencies(path: str, text: str) -> list[tuple[str, str, str]]:
    """`(name, version, group)` of a manifest; an unknown or broken one has none."""
    name = path.rpartition("/")[2]
    out: list[tuple[str, str, str]] = []
    if name == "pyproject.toml":
        d = _toml(text)
        project = d.get("project", {})
        groups = {"main": project.get("dependencies", [])} | project.get("optional-dependencies", {})
        out += [(*s, g) for g, specs in groups.items() for x in specs if (s := _spec(x))]
        poetry = d.get("tool", {}).get("poetry", {})
        tables = {"main": poetry.get("dependencies", {}), "dev": poetry.get("dev-dependencies", {})} | {g: t.get("dependencies", {}) for g, t in poetry.get("group", {}).items()}
        out += [(n, _version(v), g) for g, t in tables.items() for n, v in t.items() if n.lower() != "python"]
    elif re.fullmatch(r"requirements[\w.\-]*\.txt", name):
        out += [(*s, "main") for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("#", "-")) and (s := _spec(x))]
    elif name == "package.json":
        d = _json(text)
        out += [(n, str(v), g) for key, g in (("dependencies", "main"), ("devDependencies", "dev"), ("peerDependencies", "peer")) for n, v in (d.get(key) or {}).items()]
    elif name == "Cargo.toml":
        d = _toml(text)
        out += [(n, _version(v), g) for key, g in (("dependencies", "main"), ("dev-dependencies", "dev")) for n, v in d.get(key, {}).items()]
    elif name == "go.mod":
        blocks = re.findall(r"(?ms)^require\s*\((.*?)^\)", text)
        single = re.findall(r"(?m)^require\s+([^\s(]+)\s+(\S+)", text)
        out += [(n, v, "main") for n, v in single + [m for b in blocks for m in re.findall(r"(?m)^\s*([^\s/][^\s]*)\s+(v\S+)", b)]]
    elif name == "Gemfile":
        out += [(n, v or "", "main") for n, v in re.findall(r"""(?m)^\s*gem\s+["']([^"']+)["'](?:\s*,\s*["']([^"']+)["'])?""", text)]
    elif name == "composer.json":
        d = _json(text)
        out += [(n, str(v), g) for key, g in (("require", "main"), ("require-dev", "dev")) for n, v in (d.get(key) or {}).items() if n != "php"]
    elif name.endswith(".csproj"):
        try:
            root = ElementTree.fromstring(text)
        except ElementTree.ParseError:
            return []
        out += [(e.get("Include", ""), e.get("Version") or e.findtext("Version") or "", "main") for e in root.iter() if e.tag.rpartition("}")[2] == "PackageReference"]
    return out


def read(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows of SCHEMA of all manifests among files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *d) for p, t in zip(b[path], b[text], strict=True) if p and t for d in dependencies(p, t)], columns=["path", "name", "version", "dependency_group"])

    return files.select(path, text).mapInPandas(run, SCHEMA)
