"""Tool inventories: extraction from Python source trees, JSON documents, model snapshots."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import digest, sealed, verify_seal

INVENTORY_VERSION = "mcp-tool-inventory/v1"
TOOLS = "name string, description string, server string, path string, position long"


def _flat(text: str) -> str:
    return " ".join(text.split())


def _keyword(call: ast.Call, name: str) -> str | None:
    for k in call.keywords:
        if k.arg == name and isinstance(k.value, ast.Constant) and isinstance(k.value.value, str):
            return k.value.value
    return None


def _is_tool_call(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "tool"


def _text(node: ast.AST) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def tools_in(source: str) -> Iterator[tuple[str, str]]:
    """(tool name, description) of what a module registers, each name once.

    Three forms count: a called decorator ``@x.tool(...)`` on a function, a plain call
    ``_register_tool("name", ..)`` and ``x.tool(name="name", ..)(f)``. Only a decorated function lends
    its own name and, without a description in the call, its docstring; white space is collapsed.
    A module that does not parse has none.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    seen: set[str] = set()
    for node in ast.walk(tree):
        found: list[tuple[str, str]] = []
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            for d in filter(_is_tool_call, node.decorator_list):
                found.append((_keyword(d, "name") or node.name, _keyword(d, "description") or ast.get_docstring(node) or ""))
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "_register_tool":
            if node.args and (name := _text(node.args[0])) is not None:
                found.append((name, ""))
        elif isinstance(node, ast.Call) and _is_tool_call(node.func) and (name := _keyword(node.func, "name")):
            found.append((name, _keyword(node.func, "description") or ""))
        for name, description in found:
            if name not in seen:
                seen.add(name)
                yield name, _flat(description)


def _decoded(content: bytes) -> str:
    """UTF-8 text; what is none counts as a module without tools."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return ""


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [
            (f"{server}::{name}", description, server, path, i)
            for server, path, content in zip(f["server"], f["path"], f["content"])
            for i, (name, description) in enumerate(tools_in(_decoded(bytes(content))))
        ]
        yield pd.DataFrame(rows, columns=["name", "description", "server", "path", "position"])


def extract_tools(files: DataFrame) -> DataFrame:
    """Tools of (server, path, content) rows; of a repeated name the first by path and position stays."""
    found = files.mapInPandas(_extract, TOOLS)
    first = Window.partitionBy("name").orderBy("path", "position")
    return found.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")


def python_tree(spark: SparkSession, root: str) -> DataFrame:
    """(server, path, content) of the modules ``root/src/<server>/..``; the path is that below the root.

    Modules directly below ``src`` and those under a folder or file named tests or integration are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(f"{root.rstrip('/')}/src")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    below = F.element_at(F.split("path", re.escape(f"/{base}/src/"), 2), 2)
    parts = F.split(below, "/")
    kept = (F.size(parts) >= 2) & ~F.arrays_overlap(parts, F.array(F.lit("tests"), F.lit("integration")))
    return files.where(kept).select(F.element_at(parts, 1).alias("server"), F.concat(F.lit("src/"), below).alias("path"), "content")


def tree_inventory(spark: SparkSession, root: str, inventory_id: str, repository: str, revision: str, kind: str = "github-source-tree") -> dict:
    """The tools of a source tree as an inventory document; a tree without tools is refused."""
    rows = extract_tools(python_tree(spark, root)).orderBy("name").collect()
    if not rows:
        raise ValueError("the tree has no tools")
    tools = [{"name": r.name, "description": r.description, "server": r.server, "metadata": {"upstream_tool_name": r.name.split("::", 1)[1], "source_path": r.path}} for r in rows]
    return make_inventory(inventory_id, tools, {"kind": kind, "repository": repository, "revision": revision, "extraction": "python-ast-mcp-tool-v1"})


# --- inventory documents (small: one row for each tool of one inventory) ---------------------


def make_inventory(inventory_id: str, tools: list[dict], source: dict | None = None, schema_version: str = INVENTORY_VERSION) -> dict:
    """An inventory document with its digest, tools in the given order; refuses empty and repeated names."""
    names = [t["name"] for t in tools]
    if schema_version != INVENTORY_VERSION:
        raise ValueError("unknown inventory version")
    if not inventory_id or not tools or not all(names) or len(set(names)) != len(names) or not all(t["server"] for t in tools):
        raise ValueError("an inventory needs an id and tools with distinct names and a server")
    rows = [{"name": t["name"], "description": t.get("description", ""), "server": t["server"], "metadata": dict(t.get("metadata") or {})} for t in tools]
    body = {"schema_version": schema_version, "inventory_id": inventory_id, "source": dict(source or {}), "tools": rows}
    return body | {"sha256": digest(body, "")}


def write_inventory(inventory: dict, path: str) -> None:
    Path(path).write_text(json.dumps(inventory, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def read_inventory(text: str) -> dict:
    """The normalised document: what may be left out has its default, and a declared digest is that of this form."""
    document = json.loads(text)
    made = make_inventory(document["inventory_id"], document["tools"], document.get("source"), document.get("schema_version", INVENTORY_VERSION))
    if document.get("sha256") not in (None, made["sha256"]):
        raise ValueError("the inventory's digest does not match")
    return made


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    """inventory_id, name, description, server, metadata (JSON text) of a document."""
    made = read_inventory(spark.read.text(path, wholetext=True).first()[0])
    rows = [(made["inventory_id"], t["name"], t["description"], t["server"], json.dumps(t["metadata"], sort_keys=True)) for t in made["tools"]]
    return spark.createDataFrame(rows, "inventory_id string, name string, description string, server string, metadata string")


# --- model snapshots -------------------------------------------------------------------------

SNAPSHOT_VERSION = "model-snapshot/v1"
_MODEL = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*/[A-Za-z0-9][A-Za-z0-9_.-]*")
_REVISION = re.compile(r"[0-9a-f]{40}")
_WEIGHTS = (".safetensors", ".bin")


def _file_row(root: Path, p: Path) -> dict:
    sha = hashlib.sha256()
    with p.open("rb") as f:
        while block := f.read(1 << 20):
            sha.update(block)
    return {"path": p.relative_to(root).as_posix(), "bytes": p.stat().st_size, "sha256": "sha256:" + sha.hexdigest()}


def freeze_snapshot(folder: str, model_id: str, revision: str) -> dict:
    """A sealed list of the files of a snapshot folder ``../snapshots/<revision>``.

    Needs a pinned model (owner/name and a full revision), config.json and weights; links may lead
    to other folders of the same cache and no further.
    """
    if not (isinstance(model_id, str) and _MODEL.fullmatch(model_id) and isinstance(revision, str) and _REVISION.fullmatch(revision)):
        raise ValueError("a model is pinned by owner/name and a full revision")
    root = Path(folder)
    if root.name != revision or root.parent.name != "snapshots" or not root.is_dir():
        raise ValueError("the folder is not snapshots/<revision>")
    cache = root.parent.parent.resolve()
    found = [p for p in sorted(root.rglob("*")) if p.is_file()]
    if not all(p.resolve().is_relative_to(cache) for p in found):
        raise ValueError("a file leads out of the snapshot's cache")
    files = [_file_row(root, p) for p in found]
    names = [f["path"] for f in files]
    if "config.json" not in names or not any(n.endswith(_WEIGHTS) for n in names):
        raise ValueError("a snapshot needs config.json and weights")
    return sealed({"schema_version": SNAPSHOT_VERSION, "model_id": model_id, "revision": revision, "model_ref": f"{model_id}@{revision}", "files": files})


def fetch_snapshot(model_id: str, revision: str, download: Callable[..., str]) -> tuple[str, dict]:
    """The folder that ``download(repo_id=, revision=)`` gives, and its evidence; models are loaded from there."""
    if not (_MODEL.fullmatch(model_id) and _REVISION.fullmatch(revision)):
        raise ValueError("a model is pinned by owner/name and a full revision")
    folder = str(download(repo_id=model_id, revision=revision))
    return folder, freeze_snapshot(folder, model_id, revision)


def verify_snapshot(folder: str, snapshot: dict) -> None:
    """Raises unless the files are exactly those of the evidence."""
    verify_seal(snapshot)
    if freeze_snapshot(folder, snapshot["model_id"], snapshot["revision"]) != snapshot:
        raise ValueError("the files differ from the snapshot")
