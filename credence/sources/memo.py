"""Results of files whose text a worker has met before.

What a text means depends on its path only by the module's name, which stands at the front of the names that the module
defines.  So a result is found once under a name of our own, and that name is replaced by the file's.  Where a module's
name could mean more - it occurs in its text, begins a name with a fixed meaning, or imports are relative to it - the
file is read by itself, as are those whose text is long.

``fact_batches`` and ``flow_batches`` do so for many files at once: the rows of each text are repeated as Arrow arrays, and
the name is replaced in whole columns.
"""

from __future__ import annotations

import ast
import json
from collections import OrderedDict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from credence.functions import flow as fixed
from credence.sources import python_code as code

#: A module's name that no project has.
OWN = "credence0own0module"
LONGEST, MOST, MOST_CHARS = 1 << 16, 512, 16 << 20
#: How many files go through Arrow at once, their characters, and how many of those that are read by themselves.
FILES, FILE_CHARS, ALONE = 1024, 4 << 20, 64

_RESERVED = frozenset(
    n.partition(".")[0]
    for names in (fixed.LIBRARY, fixed.SERIALISERS, fixed.ENCODERS, fixed.BUFFERS, fixed.PASSING, fixed.OPAQUE, fixed.REQUESTS, code.READ_FUNCTIONS, code.ROUTERS, code.DEPENDS, code.ANNOTATED, code.CONVERSIONS)
    for n in names
) | {"builtins", "typing", "typing_extensions", "sqlalchemy", "shlex", "self", "cls", ""}

_kept: OrderedDict[tuple, str] = OrderedDict()
_chars = 0


def _get(key: tuple) -> str | None:
    found = _kept.get(key)
    if found is not None:
        _kept.move_to_end(key)
    return found


def _put(key: tuple, text: str) -> str:
    global _chars
    _kept[key] = text
    _chars += len(text) + len(key[1])
    while _kept and (len(_kept) > MOST or _chars > MOST_CHARS):
        old, gone = _kept.popitem(last=False)
        _chars -= len(gone) + len(old[1])
    return text


def _relative(text: str) -> bool:
    return any(isinstance(n, ast.ImportFrom) and n.level for n in ast.walk(ast.parse(text)))


def shared(path: str, data, others: tuple[str, ...] = ()) -> str | None:
    """The module's name, if results of the text under another name hold for it; ``others``: further names with a
    fixed meaning."""
    if not isinstance(data, str) or len(data) > LONGEST or path.endswith("__init__.py"):
        return None
    module = code.module_of(path)
    top = (module or "").partition(".")[0]
    if top in _RESERVED or top in data or OWN in data or any(n.partition(".")[0] == top for n in others):
        return None
    return module


def _named(text: str, module: str) -> str:
    return text.replace(OWN, json.dumps(module)[1:-1])


def _facts_text(data: str, marker_modules: tuple[str, ...]) -> str | None:
    """The facts of a text under our own name; None if they hold for no other name."""
    key = ("facts", data, marker_modules)
    text = _get(key)
    if text is None:
        row = _facts(f"{OWN}.py", data, marker_modules)
        text = _put(key, "" if row["status"] != "ok" or _relative(data) else json.dumps(row))
    return text or None


def facts(path: str, data, marker_modules: tuple[str, ...]) -> dict:
    """The row of facts of one file."""
    module = shared(path, data, marker_modules)
    text = None if module is None else _facts_text(data, marker_modules)
    if text is None:
        return _facts(path, data, marker_modules)
    row = json.loads(_named(text, module))
    row["path"], row["references"] = path, sorted(row["references"])
    for e in row["entities"]:
        e["path"] = path
    return row


def _facts(path: str, data, marker_modules: tuple[str, ...]) -> dict:
    src, status, message = code.parsed(path, data, marker_modules)
    if src is None:
        return {"path": path, "status": status, "message": message, "references": [], "imports": [], "entities": []}
    try:
        return {"path": path, "status": status, "message": message, "references": sorted(src.references()), "imports": sorted(src.imports()), "entities": list(src.entity_rows()), **src.module_facts()}
    except RecursionError:
        return {"path": path, "status": "skipped", "message": "nested too deeply", "references": [], "imports": [], "entities": []}


def _flows_text(module: str, data: str, told: str, marker_modules: tuple[str, ...], library: Mapping[str, int], clash: bool) -> str | None:
    """The rows of flow of a text under our own name, told ``told`` (a list of seeds and meets, as JSON); None if they hold
    for no other name."""
    if OWN in told or not module.isprintable() or '"' in module or "\\" in module:
        return None
    told = told.replace(f'"{module}.', f'"{OWN}.').replace(f'"{module}#', f'"{OWN}#')
    key = ("flows", data, told, marker_modules, tuple(sorted(library.items())), clash)
    text = _get(key)
    if text is None:
        if _get(("flat", data)) is None:
            src, _, _ = code.parsed(f"{OWN}.py", data, marker_modules)
            if src is None or _relative(data):
                return None
            _put(("flat", data), "1")
        text = _put(key, json.dumps(_flows(f"{OWN}.py", data, *json.loads(told), marker_modules, library, clash)))
    return text


def flows(path: str, data, seeds: list[dict], meets: list[dict], marker_modules: tuple[str, ...], library: Mapping[str, int], clash: bool) -> list[dict]:
    """The rows of flow of one file, none if it can't be parsed; ``seeds`` and ``meets`` as rows."""
    module = shared(path, data, (*marker_modules, *library))
    text = None if module is None else _flows_text(module, data, json.dumps([seeds, meets], ensure_ascii=False), marker_modules, library, clash)
    if text is None:
        return _flows(path, data, seeds, meets, marker_modules, library, clash)
    rows = json.loads(_named(text, module))
    for r in rows:
        r["path"] = path
    return rows


def _flows(path: str, data, seeds: list[dict], meets: list[dict], marker_modules: tuple[str, ...], library: Mapping[str, int], clash: bool) -> list[dict]:
    src, _, _ = code.parsed(path, data, marker_modules)
    if src is None:
        return []
    known = {s["qualname"]: (s["body"], s["ret"], s["params"]) for s in seeds}
    told: dict[str, dict[str, int]] = {}
    for m in meets:
        told.setdefault(m["callee"], {})[m["param"]] = m["rank"]
    real = {s["qualname"]: s["real"] for s in seeds if s.get("real")}
    return list(code.flow_rows(src, known, told, dict(library), clash, real))


def _slices(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """The rows of a batch, as many at once as are small."""
    sizes = pc.fill_null(pc.binary_length(batch["source"]), 0).to_pylist()
    start, chars = 0, 0
    for at, size in enumerate(sizes):
        if at > start and (at - start == FILES or chars + size > FILE_CHARS):
            yield batch.slice(start, at - start).to_pylist()
            start, chars = at, 0
        chars += size
    if start < len(sizes):
        yield batch.slice(start).to_pylist()


def _named_array(array: pa.Array, name: str, of: np.ndarray, paths: pa.Array, modules: pa.Array) -> pa.Array:
    """``array`` with the module's name of each file in the place of our own; ``of``: whose file an element is.  What is
    called ``path`` is the file's."""
    kind = array.type
    if name == "path":
        return paths.take(pa.array(of))
    if pa.types.is_string(kind):
        hit = pc.fill_null(pc.match_substring(array, OWN), False)
        if not pc.any(hit).as_py():
            return array
        values = array.dictionary_encode()
        parts = [[] if v is None else v.split(OWN) for v in values.dictionary.to_pylist()]
        piece = lambda k: pa.array([p[k] if k < len(p) else None for p in parts], kind).take(values.indices)
        own, out = modules.take(pa.array(of)), piece(0)
        for k in range(1, max(map(len, parts))):
            longer = pc.binary_join_element_wise(out, own, piece(k), "")
            out = pc.if_else(pc.is_valid(longer), longer, out)
        return out
    if pa.types.is_struct(kind):
        fields = list(kind)
        return pa.StructArray.from_arrays([_named_array(array.field(k), f.name, of, paths, modules) for k, f in enumerate(fields)], fields=fields, mask=array.is_null())
    if pa.types.is_list(kind):
        ends = array.offsets.to_numpy()
        inner = array.values.slice(ends[0], ends[-1] - ends[0])
        inner = _named_array(inner, kind.value_field.name, np.repeat(of, np.diff(ends)), paths, modules)
        return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), inner, type=kind, mask=array.is_null())
    return array


def _named_rows(found: list[tuple[str, str, str]], schema: pa.Schema) -> pa.RecordBatch:
    """The rows of files (path, module, rows under our own name as JSON)."""
    at: dict[str, int] = {}
    rows, ends = [], [0]
    for _, _, text in found:
        if text not in at:
            at[text] = len(at)
            held = json.loads(text)
            rows += held if isinstance(held, list) else [held]
            ends.append(len(rows))
    which, starts = np.array([at[text] for _, _, text in found]), np.array(ends)
    n = np.diff(starts)[which]
    of = np.repeat(np.arange(len(found)), n)
    taken = np.repeat(starts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
    out = pa.RecordBatch.from_pylist(rows, schema=schema).take(pa.array(taken))
    paths, modules = pa.array([p for p, _, _ in found], pa.string()), pa.array([m for _, m, _ in found], pa.string())
    return pa.RecordBatch.from_arrays([_named_array(c, f.name, of, paths, modules) for c, f in zip(out.columns, schema)], schema=schema)


def _batches(found: list[tuple[str, str, str]], alone: Iterator[list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if found:
        yield _named_rows(found, schema)
    rows: list[dict] = []
    for k, more in enumerate(alone, 1):
        rows += more
        if k % ALONE == 0:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def fact_batches(batch: pa.RecordBatch, marker_modules: tuple[str, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The facts of a batch of files (path, source); names that calls refer to are in no fixed order."""
    for files in _slices(batch):
        found, alone = [], []
        for r in files:
            module = shared(r["path"], r["source"], marker_modules)
            text = None if module is None else _facts_text(r["source"], marker_modules)
            alone.append(r) if text is None else found.append((r["path"], module, text))
        yield from _batches(found, ([_facts(r["path"], r["source"], marker_modules)] for r in alone), schema)


def flow_batches(batch: pa.RecordBatch, marker_modules: tuple[str, ...], library: Mapping[str, int], clash: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of flow of a batch of files (path, source, seeds, meets; the last two as JSON, or null)."""
    others = (*marker_modules, *library)
    for files in _slices(batch):
        found, alone = [], []
        for r in files:
            told = f"[{r['seeds'] or '[]'},{r['meets'] or '[]'}]"
            module = shared(r["path"], r["source"], others)
            text = None if module is None else _flows_text(module, r["source"], told, marker_modules, library, clash)
            alone.append((r, told)) if text is None else found.append((r["path"], module, text))
        yield from _batches(found, (_flows(r["path"], r["source"], *json.loads(told), marker_modules, library, clash) for r, told in alone), schema)
