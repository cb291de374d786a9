"""Configuration: source lists in a subset of YAML, environment files, prompt templates."""

from __future__ import annotations

import dataclasses
import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skyloom.schemas import SOURCE


@dataclasses.dataclass
class Source:
    id: str
    name: str = ""
    url: str = ""
    type: str = "rss"
    language: str = "en"
    region: str = "global"
    perspective: str = "unlabeled"
    weight: float = 1.0
    fetch_interval_minutes: int = 60
    enabled: bool = True

    @classmethod
    def of(cls, values: dict) -> Source:
        """A source of read values: the types of the fields are kept, a missing name is the id."""
        kinds = {"weight": float, "fetch_interval_minutes": int, "enabled": bool}
        given = {f.name: kinds.get(f.name, str)(values[f.name]) for f in dataclasses.fields(cls) if values.get(f.name) is not None}
        return cls(**{"name": str(values["id"])} | given)


_SCALAR = re.compile(
    r"""(?P<literal>'.*') | (?P<escaped>".*") | (?P<true>true|yes) | (?P<false>false|no) | (?P<none>null|~|)
      | (?P<int>[+-]?\d+(_\d+)*) | (?P<float>[+-]?((\d+(_\d+)*)?\.?\d+(_\d+)*|\d+(_\d+)*\.)(e[+-]?\d+)?|[+-]?(inf|infinity|nan)) | (?P<plain>.*)""",
    re.I | re.S | re.X,
)
_READ = {"literal": lambda t: t[1:-1], "true": lambda t: True, "false": lambda t: False, "none": lambda t: None, "int": int, "float": float, "plain": str}


def scalar(text: str):
    """A value as written: quoted text, a boolean, null, a number or plain text."""
    t = text.strip()
    kind = next(k for k, v in _SCALAR.fullmatch(t).groupdict().items() if v is not None)
    return _READ.get(kind, _unquoted)(t)


def _unquoted(t: str) -> str:
    try:
        return json.loads(t)
    except ValueError:
        return t[1:-1]


def parse_yaml(text: str) -> dict:
    """Top-level keys with values or lists; lists of scalars or of flat mappings; comments on lines of their own."""
    out: dict = {}
    items = current = None
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("- "):
            if items is None:
                raise ValueError(f"a list item outside a list: {line!r}")
            key, colon, value = line[2:].partition(":")
            if colon and (not value or value[0] == " "):
                current = {key.strip(): scalar(value)}
                items.append(current)
            else:
                current = None
                items.append(scalar(line[2:]))
            continue
        key, _, value = line.partition(":")
        if raw[0] in " \t" and current is not None:
            current[key.strip()] = scalar(value)
        elif value.strip():
            out[key.strip()] = scalar(value)
        else:
            items = out[key.strip()] = []
            current = None
    return out


def load_sources(path: str | Path, enabled_only: bool = False) -> list[Source]:
    found = [Source.of(d) for d in parse_yaml(Path(path).read_text(encoding="utf-8")).get("sources", [])]
    return [s for s in found if s.enabled or not enabled_only]


def written_scalar(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    s = str(value)
    plain = s and s == s.strip() and not set(s) & set(":#{}[]&,*?|\"'\n\r")
    return s if plain else json.dumps(s, ensure_ascii=False)


def save_sources(sources: list[Source], path: str | Path) -> None:
    """The sources in the order of their fields; comments of a file before are lost."""
    lines = ["# news sources", "", "sources:"]
    for s in sources:
        for i, f in enumerate(dataclasses.fields(Source)):
            lines.append(f"{'    ' if i else '  - '}{f.name}: {written_scalar(getattr(s, f.name))}")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")


def sources_frame(spark: SparkSession, sources: list[Source]) -> DataFrame:
    return spark.createDataFrame([dataclasses.astuple(s) for s in sources], SOURCE)


def load_env(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines into the environment, where a variable isn't set already; what was set."""
    new: dict[str, str] = {}
    if not Path(path).exists():
        return new
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, equals, value = (x.strip() for x in line.partition("="))
        if equals and key and not line.lstrip().startswith("#") and key not in os.environ:
            os.environ[key] = new[key] = value.strip('"').strip("'")
    return new


def filled(template: str, values: dict[str, str]) -> str:
    """A template with {{ name }} replaced by the values; other braces stay."""
    return re.sub(r"\{\{ ?(\w+) ?\}\}", lambda m: str(values.get(m[1], m[0])), template)


def load_prompt(folder: str | Path, name: str, **values: str) -> str:
    """The template of a name, filled with the values."""
    return filled(Path(folder, f"{name}.md.j2").read_text(encoding="utf-8"), values)
