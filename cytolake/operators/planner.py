"""Study planning: platforms, designs, costs, timelines and sample sizes.

A plan's tables are a plain dict of dicts, given by the caller or read from a file; the
defaults below are used where none are given.  A plan is immutable: an update gives a
new plan, or raises and changes nothing.
"""

from __future__ import annotations

import ast
import copy
import csv
import json
import math
import os
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.functions.special import t_power

# The default planning tables.
# Platform: CpGs, cost per sample, processing days, recommended.
_PLATFORMS = """
27K 27578 180 5 false
450K 485512 320 7 false
EPIC 866895 425 8 true
EPICv2 935000 475 8 true
Mouse_EPIC 285000 380 8 true
WGBS 28000000 1200 12 true
RRBS 4000000 450 10 true
EM-seq 28000000 980 10 true
Nanopore 28000000 850 5 true
scBS-seq 3000000 180 14 false
Targeted_BS 50000 220 10 true
"""
# Design: groups, paired, least samples recommended, adjustment of the sample size.
_DESIGNS = """
two_group 2 false 15 1.0
paired 2 true 12 0.71
multi_group 3 false 12 1.15
factorial_2x2 4 false 10 1.25
time_series 1 true 8 0.65
case_control_matched 2 true 20 0.85
discovery_replication 2 false 30 1.4
cell_type_deconv 2 false 25 1.3
"""
# Cost component: cost, unit, optional, platforms it applies to (* for all).
_COMPONENTS = """
dna_extraction 45 per_sample false *
dna_extraction_ffpe 85 per_sample true *
quality_control 25 per_sample false *
bisulfite_conversion 35 per_sample false 27K,450K,EPIC,EPICv2,Mouse_EPIC,WGBS,RRBS,scBS-seq,Targeted_BS
library_prep_wgbs 280 per_sample true WGBS
library_prep_rrbs 180 per_sample true RRBS
library_prep_emseq 320 per_sample true EM-seq
library_prep_nanopore 220 per_sample true Nanopore
sequencing_novaseq 850 per_sample true WGBS,EM-seq
sequencing_nextseq 320 per_sample true RRBS,Targeted_BS
sequencing_nanopore 450 per_sample true Nanopore
batch_correction 15 per_sample true *
bioinformatics_array 80 per_sample false 27K,450K,EPIC,EPICv2,Mouse_EPIC
bioinformatics_wgbs 180 per_sample false WGBS,EM-seq,RRBS,Targeted_BS
bioinformatics_nanopore 120 per_sample false Nanopore
dmr_analysis 1500 fixed false *
cell_type_deconvolution 800 fixed true *
storage_array 2e-06 per_cpg true 27K,450K,EPIC,EPICv2,Mouse_EPIC
storage_sequencing 8e-07 per_cpg true WGBS,EM-seq,RRBS,Nanopore,Targeted_BS
sample_shipping 35 per_sample true *
project_management 2500 fixed true *
publication_support 3500 fixed true *
"""
# Phase: base days, days per sample, days per further batch, critical, parallel.
_PHASES = """
study_design 14 0 0 true false
ethics_irb 45 0 0 true false
sample_collection 30 0.15 0 true false
sample_processing 7 0.08 2 true true
bisulfite_conversion 3 0.02 1 false true
library_prep 5 0.05 1.5 false true
array_hybridization 4 0.03 3 false true
sequencing_run 3 0.01 2 false true
data_qc 7 0.06 0 true false
statistical_analysis 21 0.04 0 true false
validation 14 0 0 false false
manuscript_prep 30 0 0 false false
data_deposition 7 0.02 0 false true
"""
_SETTINGS = {"contingency_buffer_percent": 20.0, "default_mcp_method": "fdr"}
# End of fixed values.

SECTIONS = ("platforms", "designs", "cost_components", "timeline_phases", "global_settings")
BATCH_SIZE = 96


def _rows(text: str, names: list[str]) -> dict[str, dict]:
    kinds = {"true": True, "false": False}
    out = {}
    for line in text.split("\n"):
        if line:
            key, *values = line.split(" ")
            out[key] = {n: kinds[v] if v in kinds else v if n in ("unit", "applies_to") else float(v) for n, v in zip(names, values, strict=True)}
    return out


def default_tables() -> dict:
    """The default tables, made anew."""
    components = _rows(_COMPONENTS, ["cost", "unit", "optional", "applies_to"])
    for c in components.values():
        c["applies_to"] = None if c["applies_to"] == "*" else c["applies_to"].split(",")
    return {
        "platforms": _rows(_PLATFORMS, ["n_cpgs", "cost_per_sample", "processing_days", "recommended"]),
        "designs": _rows(_DESIGNS, ["n_groups", "paired", "min_n_recommended", "power_adjustment"]),
        "cost_components": components,
        "timeline_phases": _rows(_PHASES, ["base_duration_days", "scaling_factor", "batch_adjustment", "critical", "parallelizable"]),
        "global_settings": dict(_SETTINGS),
    }


def check_tables(tables: dict) -> dict:
    """The tables, if their values are in range; else a ValueError that names the first that isn't."""
    for name in SECTIONS:
        if not isinstance(tables.get(name, {}), dict):
            raise ValueError(f"{name} must be a mapping")
    for k, p in tables.get("platforms", {}).items():
        if p.get("cost_per_sample", 0) < 0 or p.get("n_cpgs", 0) <= 0:
            raise ValueError(f"platform {k}: cost must not be negative and n_cpgs must be positive")
    for k, d in tables.get("designs", {}).items():
        if d.get("power_adjustment", 1) <= 0 or d.get("n_groups", 1) < 1 or d.get("min_n_recommended", 1) < 1:
            raise ValueError(f"design {k}: its numbers must be positive")
    for k, c in tables.get("cost_components", {}).items():
        if c.get("unit", "per_sample") not in ("per_sample", "per_cpg", "fixed") or c.get("cost", 0) < 0:
            raise ValueError(f"cost component {k}: bad unit or cost")
    for k, p in tables.get("timeline_phases", {}).items():
        if min(p.get("base_duration_days", 0), p.get("scaling_factor", 0), p.get("batch_adjustment", 0)) < 0:
            raise ValueError(f"phase {k}: durations must not be negative")
    if tables.get("global_settings", {}).get("default_mcp_method", "fdr") not in ("fdr", "bonferroni", "none"):
        raise ValueError("default_mcp_method must be fdr, bonferroni or none")
    return tables


def merged(old: dict, new: dict) -> dict:
    """``old`` with ``new`` over it, mapping by mapping."""
    out = dict(old)
    for k, v in new.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def read_tables(path: str, section: str = "platforms") -> dict:
    """Tables from a JSON, YAML, TOML or Python-literal file, or one section from a CSV or Excel file of rows.

    A CSV or Excel file's first column is the id; a JSON file of the same name beside it adds to it.
    """
    kind = os.path.splitext(path)[1].lower()
    if kind in (".csv", ".xlsx", ".xls"):
        if kind == ".csv":
            with open(path, newline="", encoding="utf-8") as f:
                rows = list(csv.DictReader(f))
        else:
            import pandas as pd

            rows = pd.read_excel(path).to_dict("records")

        def value(v):
            try:
                return ast.literal_eval(str(v))
            except (ValueError, SyntaxError):
                return {"true": True, "false": False}.get(str(v).lower(), v)

        out = {section: {str(r[next(iter(r))]): {k: value(v) for k, v in list(r.items())[1:]} for r in rows}}
        beside = os.path.splitext(path)[0] + ".json"
        return merged(out, read_tables(beside)) if os.path.exists(beside) else out
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if kind == ".json":
        return json.loads(text)
    if kind in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text)
    if kind == ".toml":
        import tomllib

        return tomllib.loads(text)
    if kind in (".py", ".txt"):
        return ast.literal_eval(text)
    raise ValueError(f"unsupported file kind: {kind!r}")


@dataclass(frozen=True)
class Plan:
    """Planning tables and what follows from them."""

    tables: dict = field(default_factory=default_tables)

    def __post_init__(self):
        check_tables(self.tables)

    @classmethod
    def load(cls, path: str, merge: bool = True, section: str = "platforms", migrate=None) -> Plan:
        """A plan from a file, over the defaults or alone; ``migrate`` may change what was read."""
        new = read_tables(path, section)
        new = migrate(new) if migrate else new
        return cls(merged(default_tables(), new) if merge else new)

    def save(self, path: str) -> None:
        """Write the tables as JSON or YAML, whole or not at all."""
        kind = os.path.splitext(path)[1].lower()
        if kind in (".yaml", ".yml"):
            import yaml

            text = yaml.safe_dump(self.tables, sort_keys=False)
        elif kind == ".json":
            text = json.dumps(self.tables, indent=1)
        else:
            raise ValueError(f"unsupported file kind: {kind!r}")
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), delete=False, encoding="utf-8") as f:
            f.write(text)
        os.replace(f.name, path)

    def _get(self, section: str, key: str) -> dict:
        try:
            return self.tables[section][key]
        except KeyError:
            raise KeyError(f"no {key!r} in {section}; there are: {', '.join(self.tables.get(section, {}))}") from None

    def platform(self, key: str) -> dict:
        return dict(self._get("platforms", key))

    def design(self, key: str) -> dict:
        return dict(self._get("designs", key))

    def _with(self, section: str, key: str, value: dict) -> Plan:
        return Plan(merged(self.tables, {section: {key: value}}))

    def with_platform_cost(self, key: str, cost: float) -> Plan:
        if cost < 0:
            raise ValueError("a cost must not be negative")
        self.platform(key)
        return self._with("platforms", key, {"cost_per_sample": float(cost)})

    def with_platform(self, key: str, values: dict) -> Plan:
        if key in self.tables["platforms"]:
            raise ValueError(f"there is a platform {key!r} already")
        return self._with("platforms", key, values)

    def with_regional_pricing(self, multiplier: float) -> Plan:
        """All platforms' costs times a positive number, to two decimals."""
        if multiplier <= 0:
            raise ValueError("a multiplier must be positive")
        return Plan(merged(self.tables, {"platforms": {k: {"cost_per_sample": round(p["cost_per_sample"] * multiplier, 2)} for k, p in self.tables["platforms"].items()}}))

    def frame(self, spark: SparkSession, section: str) -> DataFrame:
        """A section as a small DataFrame, its id as ``id``."""
        kinds = {bool: "boolean", float: "double", int: "double", str: "string", list: "array<string>"}
        rows = self.tables[section]
        names = list(dict.fromkeys(n for r in rows.values() for n in r))
        kind = {n: next((kinds[type(r[n])] for r in rows.values() if r.get(n) is not None), "string") for n in names}
        data = [(k, *[float(r[n]) if kind[n] == "double" and r.get(n) is not None else r.get(n) for n in names]) for k, r in rows.items()]
        return spark.createDataFrame(data, ", ".join(["id string", *[f"{n} {kind[n]}" for n in names]]))

    def platforms(self, spark: SparkSession, recommended_only: bool = False, most_cost: float | None = None) -> DataFrame:
        out = self.frame(spark, "platforms")
        out = out.where("recommended") if recommended_only else out
        return out if most_cost is None else out.where(F.col("cost_per_sample") <= most_cost)

    def components(self, spark: SparkSession, platform: str | None = None, include_optional: bool = True) -> DataFrame:
        """Cost components, without optional ones if asked, and without those for other platforms."""
        out = self.frame(spark, "cost_components")
        out = out if include_optional else out.where(~F.col("optional"))
        return out if platform is None else out.where(F.col("applies_to").isNull() | F.array_contains("applies_to", platform))

    def cost(self, spark: SparkSession, n_samples: int, platform: str, include_optional: bool = True) -> DataFrame:
        """``component, unit, cost`` of the platform and every component that applies."""
        if not isinstance(n_samples, (int, float)) or n_samples <= 0:
            raise ValueError(f"a positive number of samples is needed, not {n_samples}")
        n, p = float(int(n_samples)), self.platform(platform)
        per = F.when(F.col("unit") == "per_cpg", F.col("cost") * float(p["n_cpgs"]) * n).when(F.col("unit") == "fixed", F.col("cost")).otherwise(F.col("cost") * n)
        base = spark.createDataFrame([(f"platform:{platform}", "per_sample", float(p["cost_per_sample"]) * n)], "component string, unit string, cost double")
        return base.unionByName(self.components(spark, platform, include_optional).select(F.col("id").alias("component"), "unit", per.alias("cost")))

    def total_cost(self, spark: SparkSession, n_samples: int, platform: str, include_optional: bool = True) -> DataFrame:
        """One row: ``total_cost, cost_per_sample``."""
        return self.cost(spark, n_samples, platform, include_optional).agg(F.sum("cost").alias("total_cost"), (F.sum("cost") / int(n_samples)).alias("cost_per_sample"))

    def timeline(self, spark: SparkSession, n_samples: int, platform: str, contingency: bool = True) -> DataFrame:
        """``phase_id, estimated_days, critical, parallelizable`` of each phase, and a row ``TOTAL`` in which parallel phases count half."""
        if n_samples <= 0:
            raise ValueError("a positive number of samples is needed")
        p, batches = self.platform(platform), max(1, math.ceil(n_samples / BATCH_SIZE))
        base = F.when(F.col("id") == "array_processing", float(p.get("processing_days", 0))).otherwise(F.col("base_duration_days"))
        factor = 1 + self.tables["global_settings"].get("contingency_buffer_percent", 10.0) / 100 if contingency else 1.0
        days = F.ceil((base + F.col("scaling_factor") * n_samples + F.col("batch_adjustment") * (batches - 1)) * factor).cast("double")
        rows = self.frame(spark, "timeline_phases").select(F.col("id").alias("phase_id"), days.alias("estimated_days"), "critical", "parallelizable")
        total = rows.agg(F.ceil(F.sum(F.when(F.col("parallelizable"), F.col("estimated_days") / 2).otherwise(F.col("estimated_days")))).cast("double").alias("estimated_days"))
        return rows.unionByName(total.select(F.lit("TOTAL").alias("phase_id"), "estimated_days", F.lit(False).alias("critical"), F.lit(False).alias("parallelizable")))

    def sample_size(self, design: str, platform: str, effect: float, alpha: float = 0.05, power: float = 0.8, mcp: str | None = None, most: int = 500) -> dict:
        """Samples per group and in all for a two-sided t-test at a power; Bonferroni divides alpha by the platform's CpGs."""
        d, p = self.design(design), self.platform(platform)
        mcp = mcp or self.tables["global_settings"].get("default_mcp_method", "fdr")
        effective = alpha / p["n_cpgs"] if mcp == "bonferroni" and p["n_cpgs"] > 0 else alpha
        least, adjust = int(d["min_n_recommended"]), d["power_adjustment"]
        try:
            raw = solve_n(effect, effective, power, d["paired"])
        except ValueError:
            raw = least
        n = int(min(max(math.ceil(raw * adjust), least), most))
        return {"n_per_group": n, "total_samples": n * int(d["n_groups"]), "alpha_nominal": alpha, "alpha_effective": effective, "mcp_method": mcp,
                "effect_size": effect, "power": power, "design_id": design, "platform_id": platform}


def solve_n(effect: float, alpha: float, power: float, paired: bool) -> float:
    """The number of observations (a fraction) at which a t-test has a power."""
    if not effect or not 0 < alpha < power < 1:
        raise ValueError("no such test")
    low, high = 2.0001, 4.0
    while t_power(high, abs(effect), alpha, paired) < power:
        high *= 2
        if high > 1e7:
            raise ValueError("no number of samples is enough")
    for _ in range(60):
        m = (low + high) / 2
        low, high = (m, high) if t_power(m, abs(effect), alpha, paired) < power else (low, m)
    return (low + high) / 2
