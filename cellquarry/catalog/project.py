"""Project folders on the driver: a manifest, a vault of artifacts, snapshots, pruning and views."""

from __future__ import annotations

import difflib
import fcntl
import hashlib
import json
import os
import pickle
import re
import shutil
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquarry.operators.graph import Graph
from cellquarry.operators.matrix import Matrix
from cellquarry.operators.spatial import Spatial
from cellquarry.operators.table import Table
from cellquarry.plans.rules import inside_box, keep_ids
from cellquarry.sources import readers, writers

SCHEMA = 2
SNAPSHOT = re.compile(r"^(.+)\.([a-z0-9]{8})$")


def _replace_json(path: Path, data: dict) -> None:
    tmp = path.with_suffix(f".{os.getpid()}.tmp")
    tmp.write_text(json.dumps(data, indent=1, sort_keys=True))
    os.replace(tmp, path)


class Project:
    """``project.json`` holds {uid: fields}; edits lie in ``_pending`` until they are merged, so writers do not collide."""

    def __init__(self, root: str):
        self.root = Path(root).resolve()
        self.vault, self.snapshots_dir, self.pending = self.root / "artifacts", self.root / "snapshots", self.root / "_pending"
        for d in (self.vault, self.snapshots_dir, self.pending):
            d.mkdir(parents=True, exist_ok=True)
        if not (self.root / "project.json").exists():
            _replace_json(self.root / "project.json", {"schema": SCHEMA, "artifacts": {}})
        found = self._load()["schema"]
        if not 1 <= found <= SCHEMA:
            raise ValueError(f"schema {found} is not read")

    # ---- manifest

    def _load(self) -> dict:
        return json.loads((self.root / "project.json").read_text())

    @contextmanager
    def _locked(self) -> Iterator[None]:
        """One process at a time merges edits: the lock is a file of the project's folder."""
        with open(self.root / ".lock", "a") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            try:
                yield
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    def consolidate(self) -> dict:
        """Merges the pending edits, in the order they were made, into the manifest."""
        if not any(self.pending.glob("*.json")):
            return self._load()["artifacts"]
        with self._locked():
            return self._merge()

    def _merge(self) -> dict:
        data, done = self._load(), []
        for p in sorted(self.pending.glob("*.json")):
            edit = json.loads(p.read_text())
            if edit.get("removed"):
                data["artifacts"].pop(edit["uid"], None)
            else:
                data["artifacts"][edit["uid"]] = data["artifacts"].get(edit["uid"], {}) | edit["fields"]
            done.append(p)
        if done:
            _replace_json(self.root / "project.json", data)
            for p in done:
                p.unlink()
        return data["artifacts"]

    def register(self, uid: str, **fields) -> None:
        _replace_json(self.pending / f"{time.time_ns()}-{uid}.json", {"uid": uid, "fields": fields})

    def __getitem__(self, key: str | tuple[str, str]):
        """project[uid] or project[uid, field]."""
        return self.consolidate()[key[0]][key[1]] if isinstance(key, tuple) else self.consolidate()[key]

    def __setitem__(self, key: tuple[str, str], value: object) -> None:
        self.register(key[0], **{key[1]: value})

    def __len__(self) -> int:
        return len(self.consolidate())

    def __contains__(self, uid: str) -> bool:
        return uid in self.consolidate()

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(u, f.get("type"), json.dumps(f, sort_keys=True)) for u, f in sorted(self.consolidate().items())]
        return spark.createDataFrame(rows, "uid string, type string, fields string")

    def update_schema(self) -> int:
        """Migrates an older manifest: version 1 listed artifacts."""
        data = self._load()
        if isinstance(data["artifacts"], list):
            data["artifacts"] = {a.pop("uid"): a for a in data["artifacts"]}
        data["schema"] = SCHEMA
        _replace_json(self.root / "project.json", data)
        return SCHEMA

    # ---- artifacts

    def path(self, uid: str) -> str:
        return str(self.vault / uid)

    @staticmethod
    def content_hash(path: str) -> str:
        h = hashlib.sha256()
        for p in sorted(Path(path).rglob("*")):
            if p.is_file() and not p.name.startswith((".", "_")):
                h.update(p.name.split("-")[0].encode())
                with p.open("rb") as f:
                    while block := f.read(1 << 20):
                        h.update(block)
        return h.hexdigest()

    def write(self, what: Table | DataFrame | Matrix | Graph | object, depends: Sequence[str] = (), **fields) -> str:
        """Stores a handle or a picklable object in the vault and registers it."""
        uid = writers.new_uid()
        to = self.path(uid)
        if isinstance(what, Matrix):
            kind = "matrix"
            writers.write_matrix(what, to, renumber=False)
        elif isinstance(what, Graph):
            kind = "graph"
            writers.write_graph(what, to)
        elif isinstance(what, Table | DataFrame):
            kind = "table"
            writers.write_table(what.df() if isinstance(what, Table) else what, to, uid)
        else:
            kind = "object"
            Path(to).mkdir()
            (Path(to) / "object.pkl").write_bytes(pickle.dumps(what))
        self.register(uid, type=kind, depends=list(depends), hash=self.content_hash(to), **fields)
        return uid

    def read(self, spark: SparkSession, uid: str) -> Table | Matrix | Graph | object:
        kind = self[uid]["type"]
        if kind == "object":
            return pickle.loads((Path(self.path(uid)) / "object.pkl").read_bytes())  # written by this project itself
        return {"matrix": readers.read_matrix, "graph": readers.read_graph, "table": Table.read}[kind](spark, self.path(uid))

    def adopt(self, path: str, kind: str, move: bool = True, **fields) -> str:
        """Takes a folder or file into the vault; what lies there already is only registered."""
        own = Path(path).resolve()
        if self.vault in own.parents:
            return own.relative_to(self.vault).parts[0]
        uid = writers.new_uid()
        (shutil.move if move else shutil.copytree)(str(own), self.path(uid))
        self.register(uid, type=kind, depends=[], **fields)
        return uid

    # ---- snapshots

    def snapshots(self) -> dict[str, Path]:
        """The newest folder of each name."""
        out: dict[str, Path] = {}
        for p in sorted(self.snapshots_dir.iterdir(), key=lambda p: p.stat().st_mtime_ns):
            if m := SNAPSHOT.match(p.name):
                out[m[1]] = p
        return out

    def save(self, name: str, state: object, uses: Sequence[str] = ()) -> str:
        """Saves a state by name; it keeps the artifacts it uses alive. Older ones of that name go once it is in place."""
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"not a name: {name}")
        old = [p for p in self.snapshots_dir.iterdir() if (m := SNAPSHOT.match(p.name)) and m[1] == name]
        tag = writers.new_uid()
        staged = self.snapshots_dir / f".{name}.{tag}"
        staged.mkdir()
        (staged / "state.pkl").write_bytes(pickle.dumps(state))
        (staged / "uses.json").write_text(json.dumps(list(uses)))
        os.replace(staged, self.snapshots_dir / f"{name}.{tag}")
        for p in old:
            shutil.rmtree(p)
        return tag

    def _snapshot(self, name: str) -> Path:
        found = self.snapshots()
        if name not in found:
            near = difflib.get_close_matches(name, found, 3)
            raise KeyError(f"no snapshot {name}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return found[name]

    def load(self, name: str) -> object:
        return pickle.loads((self._snapshot(name) / "state.pkl").read_bytes())

    def delete(self, name: str) -> None:
        shutil.rmtree(self._snapshot(name))

    def prune(self, dry_run: bool = False) -> list[str]:
        """Deletes artifacts that no snapshot uses, itself or through dependencies."""
        known = self.consolidate()
        todo = [u for p in self.snapshots().values() for u in json.loads((p / "uses.json").read_text())]
        keep: set[str] = set()
        while todo:
            u = todo.pop()
            if u not in keep and u in known:
                keep.add(u)
                todo += known[u].get("depends", [])
        gone = sorted(set(known) - keep)
        if not dry_run:
            for u in gone:
                shutil.rmtree(self.path(u), ignore_errors=True)
                _replace_json(self.pending / f"{time.time_ns()}-{u}.json", {"uid": u, "removed": True})
            self.consolidate()
        return gone


def resolve_view(cells: DataFrame, steps: Sequence[Mapping], owners: Sequence[tuple[DataFrame, str]], locations: DataFrame | None = None) -> DataFrame:
    """The cell ids that pass all steps, in order: {"filter": SQL, "column": name} on the first owner (frame, id column) with the column, {"crop": box} on locations (cell_id, x_index, y_index), or {"ids": sequence or DataFrame}."""
    out = cells
    for s in steps:
        if "crop" in s:
            if locations is None:
                raise ValueError("a crop needs locations")
            got = locations.where(inside_box(F.col("x_index"), F.col("y_index"), s["crop"])).select("cell_id")
        elif "ids" in s:
            got = s["ids"]
        else:
            owner = next(((d, k) for d, k in owners if s["column"] in d.columns), None)
            if owner is None:
                raise KeyError(f"nothing holds {s['column']}")
            got = owner[0].where(s["filter"]).select(owner[1])
        out = keep_ids(out, "cell_id", got)
    return out


def apply_view(ids: DataFrame, target: Matrix | DataFrame, id_col: str = "cell_id") -> Matrix | DataFrame:
    """One set of surviving ids narrows every target."""
    return target.subset(cells=ids.select("cell_id")) if isinstance(target, Matrix) else keep_ids(target, id_col, ids.select("cell_id"))


#: Targets keyed by cell, with the column that holds the cell's id.
CELL_KEYED = {"cell_meta": "cell_id", "enrichment": "cell_id", "locations": "cell_id", "polygons": "poly_ID"}


def resolve_target(kind: str, target: Matrix | DataFrame | Spatial, ids: DataFrame | None, steps: Sequence[Mapping] = (), space: Callable[[Spatial], Spatial] | None = None) -> Matrix | DataFrame | Spatial:
    """A target as a view shows it.

    expression, cell_meta, enrichment, locations and polygons narrow to the surviving ``ids`` (locations and polygons move into the ``space`` first);
    points and bin_points are not keyed by cell: crop steps clip them in the output space, other steps pass. Bin points know no space.
    """
    if kind == "bin_points" and space:
        raise ValueError("bin points know no spaces")
    if kind in ("locations", "polygons", "points") and space:
        target = space(target if isinstance(target, Spatial) else Spatial.of(target))
    if kind in ("points", "bin_points"):
        out = target if isinstance(target, Spatial) else Spatial.of(target)
        for s in steps:
            if "crop" in s:
                out = out.crop(s["crop"])
            elif "region" in s:
                out = out.relate(s["region"], s.get("relation", "intersects"))
        return out
    if ids is None:
        return target
    if kind == "expression":
        return apply_view(ids, target)
    if kind not in CELL_KEYED:
        raise KeyError(f"no such target: {kind}")
    key = CELL_KEYED[kind]
    if isinstance(target, Spatial):
        return replace(target, table=target.table.keep(key, ids.select("cell_id")))
    return apply_view(ids, target, key)
