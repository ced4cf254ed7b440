"""Reports and model bundles: the only places where results come to the driver, all of them bounded."""

from __future__ import annotations

import hashlib
import json
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a table in a report.
MOST_ROWS = 500


def markdown_table(df: DataFrame, rows: int = MOST_ROWS) -> str:
    """The first rows of a small result as a Markdown table; pipes and line breaks are escaped."""
    clean = lambda v: "" if v is None else str(v).replace("\n", " ").replace("|", "\\|")
    lines = [f"| {' | '.join(df.columns)} |", f"| {' | '.join('---' for _ in df.columns)} |"]
    lines += [f"| {' | '.join(clean(v) for v in r)} |" for r in df.limit(min(rows, MOST_ROWS)).collect()]
    return "\n".join(lines)


def mermaid_graph(edges: DataFrame, source: str, target: str, weight: str, prefixes: tuple[str, str], rows: int = 60) -> str:
    """A small edge table as a Mermaid graph."""
    lines = ["```mermaid", "graph LR"]
    for r in edges.select(source, target, weight).limit(min(rows, MOST_ROWS)).collect():
        lines.append(f"  {prefixes[0]}{r[0]} -->|{r[2]:.2f}| {prefixes[1]}{r[1]}")
    return "\n".join([*lines, "```"])


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row of a small result as one JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def report(title: str, sections: dict[str, str]) -> str:
    """A Markdown document of named sections."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{body}" for name, body in sections.items())]) + "\n"


def export_bundle(model: Path, target: Path, facts: dict[str, object]) -> dict[str, object]:
    """Packs a saved model directory as .tar.gz with a manifest of its files' hashes; returns the manifest."""
    files = {str(p.relative_to(model)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(model.rglob("*")) if p.is_file() and p.name != "manifest.json"}
    manifest = {"format": 1, "facts": facts, "files": files}
    (model / "manifest.json").write_text(json.dumps(manifest, indent=1, sort_keys=True))
    shutil.make_archive(str(target), "gztar", root_dir=model)
    return manifest


def import_bundle(archive: Path, target: Path, expected: dict[str, object] | None = None) -> dict[str, object]:
    """Unpacks a bundle beside the target, checks hashes and expected facts, then moves it into place."""
    fresh = target.with_name(target.name + ".new")
    shutil.rmtree(fresh, ignore_errors=True)
    shutil.unpack_archive(str(archive), str(fresh), filter="data")
    manifest = json.loads((fresh / "manifest.json").read_text())
    for name, digest in manifest["files"].items():
        if hashlib.sha256((fresh / name).read_bytes()).hexdigest() != digest:
            raise ValueError(f"{name} is damaged")
    for key, value in (expected or {}).items():
        if manifest["facts"].get(key) != value:
            raise ValueError(f"the bundle has {key} {manifest['facts'].get(key)!r} instead of {value!r}")
    shutil.rmtree(target, ignore_errors=True)
    fresh.rename(target)
    return manifest


#: What a bundle holds: everything, or what serving needs, without the counts that training goes on from.
BUNDLES = {"full": (), "inference": ("pair_counts", "word_counts", "corpus")}


def _moved(spark: SparkSession, source: str, target: str, here: bool) -> None:
    """Copies a file or directory from a file system that Spark knows to this machine, or back."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(source if here else target)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if here:
        fs.copyToLocalFile(False, place, jvm.org.apache.hadoop.fs.Path(target), True)
    else:
        fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(source), place)


def bundle_model(spark: SparkSession, model: str, target: str, facts: dict[str, object], mode: str = "full") -> dict[str, object]:
    """Packs a model version on any file system to an archive on any; the driver's disk is used in between, a model is of bounded size."""
    left_out = BUNDLES[mode]
    with tempfile.TemporaryDirectory() as folder:
        _moved(spark, model, f"{folder}/model", True)
        for name in left_out:
            shutil.rmtree(f"{folder}/model/{name}", ignore_errors=True)
        for p in Path(folder).rglob(".*.crc"):
            p.unlink()
        manifest = export_bundle(Path(folder, "model"), Path(folder, "bundle"), {**facts, "mode": mode})
        _moved(spark, f"{folder}/bundle.tar.gz", target, False)
    return manifest


def unbundle_model(spark: SparkSession, archive: str, target: str, expected: dict[str, object] | None = None) -> dict[str, object]:
    """Checks an archive on any file system and unpacks it to a directory on any."""
    with tempfile.TemporaryDirectory() as folder:
        _moved(spark, archive, f"{folder}/bundle.tar.gz", True)
        manifest = import_bundle(Path(folder, "bundle.tar.gz"), Path(folder, "model"), expected)
        _moved(spark, f"{folder}/model", target, False)
    return manifest
