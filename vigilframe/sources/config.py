"""Configuration: TOML files, defaults, validation, overrides, taxonomies. All of it is small and stays on the driver."""

from __future__ import annotations

import copy
import os
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import DURATION_UNITS, SIZE_UNITS

# Sections and defaults.
DEFAULTS = {
    "server": {"endpoint": "127.0.0.1", "port": 8080, "max_concurrent": 20, "idle_unload_seconds": 300},
    "database": {"backend": "parquet", "pool": 5},
    "cache": {"enabled": True, "ttl_seconds": 0},
    "limits": {"max_memory": "4gb", "max_pending": 1024, "max_download": "512mb", "max_video_seconds": 3600, "max_pixels": 50_000_000, "block_private": True, "allowed_schemes": ["http", "https"], "local_roots": []},
    "retention": {"keep": ""},
    "webhook": {},
    "auth": {},
    "models": {},
    "strategies": {},
    "pipelines": {},
}
MODEL = {"repo": None, "revision": "main", "architecture": "vit", "enabled": True, "batch_size": 8, "timeout_seconds": 30, "priority": 0, "strategy": None, "labels": [], "trigger_threshold": 0.9, "score_threshold": None, "max_results": None, "prompts": [], "template": None, "taxonomy": None, "retries": 3}
METHODS = {"uniform": "count", "fps": "fps", "every_nth": "nth", "iframes": None, "scene": "threshold"}
OPEN_SECTIONS = ("auth", "cache", "limits")
AGGREGATIONS = {"max": "max", "mean": "mean", "average": "mean"}


def parse_size(text: str) -> int | None:
    """Bytes, or None for no limit (zero, empty, malformed)."""
    m = re.fullmatch(r"([0-9]*\.?[0-9]+)\s*([a-z]*)", text.strip().lower())
    if not m or m[2] not in SIZE_UNITS:
        return None
    return int(float(m[1]) * SIZE_UNITS[m[2]]) or None


def parse_duration(text: str) -> int | None:
    """Seconds of `45s 90m 12h 30d 2w`; None for anything else, bare numbers too."""
    m = re.fullmatch(r"([0-9]+)([smhdw])", text.strip())
    return int(m[1]) * DURATION_UNITS[m[2]] if m else None


@dataclass(frozen=True)
class Taxonomy:
    """Flat prompts: rows (prompt_ix, prompt, child_id, parent_id, agg)."""

    rows: list[tuple[int, str, int, int, str]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Taxonomy:
        """Parents by name with id and children; ids unique, prompts non-empty, a missing aggregation is max."""
        parents, children, rows = set(), set(), []
        for name, parent in sorted(tomllib.loads(text).items()):
            if parent["id"] in parents:
                raise ValueError(f"{name}: parent id {parent['id']} is taken")
            parents.add(parent["id"])
            for child_name, child in sorted(parent.get("children", {}).items()):
                if child["id"] in children:
                    raise ValueError(f"{name}.{child_name}: child id {child['id']} is taken")
                children.add(child["id"])
                if not child.get("prompts"):
                    raise ValueError(f"{name}.{child_name}: no prompts")
                how = child.get("aggregation", "max")
                if how not in AGGREGATIONS:
                    raise ValueError(f"{name}.{child_name}: unknown aggregation {how}")
                rows += [(len(rows) + i, p, child["id"], parent["id"], AGGREGATIONS[how]) for i, p in enumerate(child["prompts"])]
        return cls(rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "prompt_ix int, prompt string, child_id bigint, parent_id bigint, agg string")


@dataclass
class Config:
    data: dict
    folder: str = "."

    @classmethod
    def parse(cls, text: str, folder: str = ".") -> Config:
        given = tomllib.loads(text)
        unknown = [k for k in given if k not in DEFAULTS]
        unknown += [f"{s}.{k}" for s in given if s in DEFAULTS and s not in (*OPEN_SECTIONS, "models", "strategies", "pipelines", "webhook") for k in given[s] if k not in DEFAULTS[s]]
        unknown += [f"models.{m}.{k}" for m, v in given.get("models", {}).items() for k in v if k not in MODEL]
        if unknown:
            raise ValueError(f"unknown keys: {', '.join(unknown)}")
        data = {s: copy.deepcopy(d) | given.get(s, {}) for s, d in DEFAULTS.items()}
        data["models"] = {m: copy.deepcopy(MODEL) | v for m, v in data["models"].items()}
        data["_given"] = list(given)
        for m in data["models"].values():
            if m["taxonomy"] and not os.path.isabs(m["taxonomy"]):
                m["taxonomy"] = os.path.join(folder, m["taxonomy"])
        return cls(data, folder)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        path = path or os.path.join(os.environ.get("XDG_CONFIG_HOME", os.path.expanduser("~/.config")), "vigilframe", "config.toml")
        with open(path, encoding="utf-8") as f:
            return cls.parse(f.read(), os.path.dirname(os.path.abspath(path)))

    def override(self, endpoint: str | None = None, port: int | None = None, webhook_url: str | None = None) -> Config:
        """For one run: endpoint and port always; the webhook's URL only if there is a webhook section."""
        data = copy.deepcopy(self.data)
        if endpoint is not None:
            data["server"]["endpoint"] = endpoint
        if port is not None:
            data["server"]["port"] = port
        if webhook_url is not None and "webhook" in data["_given"]:
            data["webhook"]["url"] = webhook_url
        return Config(data, self.folder)

    def problems(self) -> list[str]:
        """All problems, not just the first."""
        d, out = self.data, []
        for name, strategy in d["strategies"].items():
            steps = strategy.get("steps", [])
            if not steps:
                out.append(f"strategy {name} has no steps")
            numbers = [s.get("step") for s in steps]
            out += [f"strategy {name}: step {n} occurs twice" for n in sorted({n for n in numbers if numbers.count(n) > 1}, key=str)]
            if strategy.get("aggregation", "mean") not in AGGREGATIONS:
                out.append(f"strategy {name}: unknown aggregation {strategy['aggregation']}")
            for s in steps:
                method = s.get("method")
                if method not in METHODS:
                    out.append(f"strategy {name}: unknown method {method}")
                elif METHODS[method] and s.get(METHODS[method]) is None:
                    out.append(f"strategy {name}: {method} needs {METHODS[method]}")
        for name, m in d["models"].items():
            if not m["repo"]:
                out.append(f"model {name} has no repo")
            if m["strategy"] is not None and m["strategy"] not in d["strategies"]:
                out.append(f"model {name}: unknown strategy {m['strategy']}")
            if m["architecture"] not in ("vit", "siglip"):
                out.append(f"model {name}: unknown architecture {m['architecture']}")
            if m["batch_size"] < 1:
                out.append(f"model {name}: batch_size must be positive")
        for name, p in d["pipelines"].items():
            orders = [s.get("order") for s in p.get("steps", [])]
            if not orders:
                out.append(f"pipeline {name} has no steps")
            out += [f"pipeline {name}: order {o} occurs twice" for o in sorted({o for o in orders if orders.count(o) > 1}, key=str)]
            out += [f"pipeline {name}: unknown model {s.get('model')}" for s in p.get("steps", []) if s.get("model") not in d["models"]]
        keep = d["retention"]["keep"]
        if keep and parse_duration(keep) is None:
            out.append(f"retention.keep is no duration: {keep}")
        return out

    # --- dotted keys

    def get(self, key: str):
        at = self.data
        for part in key.split("."):
            at = at[part]
        return at

    def set(self, key: str, text: str) -> None:
        *above, last = key.split(".")
        at = self.data
        for part in above:
            at = at.setdefault(part, {})
        at[last] = scalar(text)

    def remove(self, key: str) -> bool:
        *above, last = key.split(".")
        at = self.data
        for part in above:
            at = at.get(part, {})
        return at.pop(last, None) is not None

    # --- dimensions for plans

    def models(self, spark: SparkSession) -> DataFrame:
        rows = [(n, m["enabled"], m["strategy"], m["priority"], m["revision"], m["architecture"], m["batch_size"], m["timeout_seconds"], [int(x) for x in m["labels"]], float(m["trigger_threshold"])) for n, m in self.data["models"].items()]
        return spark.createDataFrame(rows, "model string, enabled boolean, strategy string, priority int, revision string, architecture string, batch_size int, timeout_seconds int, labels array<bigint>, trigger_threshold double")

    def head(self, name: str) -> dict:
        """How a model's output is read and selected from (see heads.predictor)."""
        m = self.data["models"][name]
        out = {k: m[k] for k in ("architecture", "prompts", "template", "score_threshold", "max_results")}
        if m["taxonomy"]:
            with open(m["taxonomy"], encoding="utf-8") as f:
                out["taxonomy"] = Taxonomy.parse(f.read()).rows
        return out

    def pipelines(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, s["order"], s["model"]) for n, p in self.data["pipelines"].items() for s in p["steps"]], "pipeline string, order int, model string")

    def gates(self, spark: SparkSession) -> DataFrame:
        """(pipeline, label, stop_labels, stop_threshold) of the steps that may end a pipeline."""
        rows = [(n, s["model"], [int(x) for x in s["stop_if"]["labels"]], float(s["stop_if"].get("threshold", 0.9))) for n, p in self.data["pipelines"].items() for s in p["steps"] if s.get("stop_if")]
        return spark.createDataFrame(rows, "pipeline string, label string, stop_labels array<bigint>, stop_threshold double")

    def steps(self, spark: SparkSession) -> DataFrame:
        rows = [(n, s["step"], s["method"], s.get("count"), s.get("fps") and float(s["fps"]), s.get("nth"), s.get("threshold")) for n, st in self.data["strategies"].items() for s in st["steps"]]
        return spark.createDataFrame(rows, "strategy string, step int, method string, count int, rate double, nth int, threshold double")


def scalar(text: str):
    """A value as written on a command line: bool, int, float, else the text."""
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def id2label(text: str) -> list[str]:
    """Labels of a model's config.json in index order; indexes outside 0..n-1 are dropped."""
    import json

    found = {int(k): v for k, v in json.loads(text).get("id2label", {}).items() if k.isdigit()}
    return [found[i] for i in range(len(found)) if i in found]


def normalization(text: str, fallback_size: int = 224) -> dict:
    """Mean, std and size of a preprocessor config; size may be a number, a height or a shortest edge."""
    import json

    d = json.loads(text) if text else {}
    size = d.get("size", fallback_size)
    if isinstance(size, dict):
        size = size.get("height") or size.get("shortest_edge") or fallback_size
    triple = lambda v: [float(x) for x in v] if isinstance(v, list) and len(v) == 3 else [0.5] * 3
    return {"mean": triple(d.get("image_mean")), "std": triple(d.get("image_std")), "size": int(size)}
