"""Embedding snapshots of an inventory: sealed JSON documents and their checks."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.canonical import digest
from ..operators import validate as V

VERSION = "semantic-tool-embeddings/v1"
RECIPE = "tool-identity-description-source-v1"


def snapshot(embedding_id: str, inventory_id: str, inventory_sha256: str, vectors: dict[str, list[float]], model: dict | None = None, text_recipe: str = RECIPE) -> dict:
    """A document with its digest; vectors must be of one dimension, finite and not zero."""
    sizes = {len(v) for v in vectors.values()}
    if not embedding_id or len(sizes) != 1 or sizes == {0}:
        raise ValueError("an embedding needs an id and vectors of one dimension")
    if not all(name and all(map(math.isfinite, v)) and any(v) for name, v in vectors.items()):
        raise ValueError("a vector is not finite or zero, or has no name")
    body = {
        "schema_version": VERSION, "embedding_id": embedding_id, "inventory_id": inventory_id, "inventory_sha256": inventory_sha256, "text_recipe": text_recipe, "model": dict(model or {}), "dimension": sizes.pop(),
        "vectors": [{"tool": k, "vector": [float(x) for x in v]} for k, v in sorted(vectors.items())],
    }
    return body | {"sha256": digest(body, "")}


def write_snapshot(document: dict, path: str) -> None:
    Path(path).write_text(json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def read_snapshot(text: str) -> dict:
    """The normalised document; declared dimension and digest must be those of the vectors."""
    d = json.loads(text)
    if d.get("schema_version", VERSION) != VERSION:
        raise ValueError("unknown embedding version")
    made = snapshot(d["embedding_id"], d["inventory_id"], d["inventory_sha256"], {v["tool"]: v["vector"] for v in d["vectors"]}, d.get("model"), d.get("text_recipe", RECIPE))
    if d.get("dimension") not in (None, made["dimension"]) or d.get("sha256") not in (None, made["sha256"]):
        raise ValueError("the snapshot's dimension or digest does not match")
    return made


def load_snapshot(spark: SparkSession, path: str, inventory: DataFrame | None = None, inventory_sha256: str | None = None) -> DataFrame:
    """(embedding_id, name, vector) of a snapshot whose digest, dimensions and values are sound.

    With an inventory, every tool must have a vector and every vector a tool.
    """
    document = read_snapshot(spark.read.text(path, wholetext=True).first()[0])
    if inventory_sha256 is not None and document["inventory_sha256"] != inventory_sha256:
        raise ValueError("the snapshot is of another inventory")
    rows = [(document["embedding_id"], v["tool"], v["vector"]) for v in document["vectors"]]
    vectors = spark.createDataFrame(rows, "embedding_id string, name string, vector array<double>")
    V.require_none(V.embedding_violations(vectors.select("name", "vector")), "embeddings")
    if inventory is not None:
        V.require_none(V.embedding_coverage(vectors, inventory), "embeddings and inventory")
    return vectors
