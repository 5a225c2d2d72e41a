"""Geometric files, read and written by the driver, meshes and grids a part at a time: PLY, GLB, VTK, DXF, rasters, GeoParquet polygons."""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import Vector
from gridloom.operators.mesh import MeshTables, grid_table, hexahedra
from gridloom.operators.model import BlockModel, ModelError
from gridloom.operators.spatial import Mesh, Polygon, Raster
from gridloom.sources import store

#: PLY's types and their struct codes.
PLY_TYPES = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}


# PLY


def _ply_header(lines: list[str]) -> tuple[list, dict, str]:
    """Elements (name, number, properties), the comments' values, and the format."""
    if not lines or lines[0].strip() != "ply":
        raise ModelError("not a PLY file")
    elements: list[tuple[str, int, list]] = []
    meta: dict = {}
    kind = ""
    for line in lines[1:]:
        words = line.split()
        if not words:
            continue
        if words[0] == "format":
            kind = words[1]
        elif words[0] == "comment" and "=" in line:
            k, _, v = line.split(None, 1)[1].strip().partition("=")
            try:
                meta[k] = json.loads(v)
            except ValueError:
                meta[k] = v
        elif words[0] == "element":
            elements.append((words[1], int(words[2]), []))
        elif words[0] == "property":
            elements[-1][2].append((words[-1], words[2:4] if words[1] == "list" else words[1]))
    return elements, meta, kind


def _ply_head(f) -> tuple[list, dict, str]:
    """The header of an open PLY file, which then stands at its body."""
    line = f.readline(1 << 20)
    if line.strip() != b"ply":
        raise ModelError("not a PLY file")
    lines = [line]
    while not (line := f.readline()).startswith(b"end_header"):
        if not line:
            raise ModelError("the PLY header does not end")
        lines.append(line)
    elements, meta, kind = _ply_header([x.decode("ascii", "replace") for x in lines])
    if kind not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ModelError(f"no PLY format: {kind}")
    return elements, meta, kind


class _Words:
    """The words of an open file, some at a time."""

    def __init__(self, f):
        self.f, self.rest, self.held, self.at = f, b"", [], 0

    def take(self, n: int) -> list[bytes]:
        out: list[bytes] = []
        while True:
            part = self.held[self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
            if len(out) == n:
                return out
            block = self.f.read(BLOCK)
            text = self.rest + block
            end = max(text.rfind(c) for c in (b" ", b"\n", b"\t", b"\r")) + 1 if block else len(text)
            self.rest, self.held, self.at = text[end:], text[:end].split(), 0
            if not block and not self.held:
                raise ModelError("the file ends before its last element")


def _exactly(f, n: int) -> bytes:
    if len(data := f.read(n)) < n:
        raise ModelError("the file ends before its last element")
    return data


def _ply_rows(f, words: _Words, kind: str, n: int, properties: list) -> dict:
    """n records whose lists may have any length; the lists are passed over."""
    import numpy as np

    order = ">" if "big" in kind else "<"

    def number(t: str):
        if kind == "ascii":
            word = words.take(1)[0]
            return float(word) if PLY_TYPES[t] in "fd" else int(word)
        form = order + PLY_TYPES[t]
        return struct.unpack(form, _exactly(f, struct.calcsize(form)))[0]

    held: dict[str, list] = {p: [] for p, t in properties if not isinstance(t, list)}
    for _ in range(n):
        for p, t in properties:
            if isinstance(t, list):
                for _ in range(int(number(t[0]))):
                    number(t[1])
            else:
                held[p].append(number(t))
    types = dict((p, t) for p, t in properties if not isinstance(t, list))
    return {p: np.array(v, float if PLY_TYPES[types[p]] in "fd" else np.int64) for p, v in held.items()}


def _ply_fixed(f, words: _Words, kind: str, n: int, properties: list) -> tuple[dict, list]:
    """n records whose lists have three items: the columns, and an array of n by 3 for each list."""
    import numpy as np

    columns, lists = {}, []
    if kind == "ascii":
        width = sum(4 if isinstance(t, list) else 1 for _, t in properties)
        # A list of another length moves all that follows: the lengths of a record are looked at before the next is read.
        table = np.fromiter(map(float, words.take(n * width)), float, n * width).reshape(n, width)
        at = 0
        for p, t in properties:
            if isinstance(t, list):
                if (table[:, at] != 3).any():
                    raise ModelError("only triangles are read")
                lists.append(table[:, at + 1 : at + 4].astype(np.int64))
                at += 4
                continue
            columns[p] = table[:, at]
            if PLY_TYPES[t] not in "fd":
                columns[p] = columns[p].astype(np.int64)
                if (columns[p] != table[:, at]).any():
                    raise ModelError(f"{p} is no whole number")
            at += 1
        return columns, lists
    order, fields = ">" if "big" in kind else "<", []
    for m, (_, t) in enumerate(properties):
        fields += [(f"n{m}", order + PLY_TYPES[t[0]]), (f"p{m}", order + PLY_TYPES[t[1]], (3,))] if isinstance(t, list) else [(f"p{m}", order + PLY_TYPES[t])]
    form = np.dtype(fields)
    data = f.read(n * form.itemsize)
    table = np.frombuffer(data[: len(data) // form.itemsize * form.itemsize], form)
    for m, (p, t) in enumerate(properties):
        if isinstance(t, list):
            if (table[f"n{m}"] != 3).any():
                raise ModelError("only triangles are read")
            lists.append(table[f"p{m}"].astype(np.int64))
        else:
            columns[p] = table[f"p{m}"].astype(float if PLY_TYPES[t] in "fd" else np.int64)
    if len(table) < n:
        raise ModelError("the file ends before its last element")
    return columns, lists


def ply_chunks(path: str) -> tuple[list, dict, Iterator]:
    """A PLY file's elements, the comments' values, and its vertices and faces a chunk at a time: the element's name,
    its columns as arrays, and the faces' corners as an array of n by 3."""
    import numpy as np

    with open(path, "rb") as f:
        elements, meta, kind = _ply_head(f)

    def chunks():
        with open(path, "rb") as f:
            _ply_head(f)
            words = _Words(f)
            for name, n, properties in elements:
                listed = sum(isinstance(t, list) for _, t in properties)
                if name == "face" and listed > 1:
                    raise ModelError("a face has one list")
                for start in range(0, n, CHUNK):
                    m, corners = min(CHUNK, n - start), np.zeros((0, 3), np.int64)
                    if listed and name != "face":
                        columns = _ply_rows(f, words, kind, m, properties)
                    else:
                        columns, lists = _ply_fixed(f, words, kind, m, properties)
                        corners = lists[0] if lists else corners
                    if name in ("vertex", "face"):
                        yield name, columns, corners

    return elements, meta, chunks()


def _scalars(elements: list, element: str) -> list[str]:
    return list(dict.fromkeys(p for name, _, properties in elements if name == element for p, t in properties if not isinstance(t, list)))


def read_ply(path: str) -> tuple[dict[str, list], list[tuple[int, int, int]], dict[str, list], dict]:
    """Vertex columns, triangles, face columns and the comments' values of a PLY file, all in lists: ``ply_chunks``
    and ``ply_tables`` are for large ones."""
    elements, meta, chunks = ply_chunks(path)
    vertices: dict[str, list] = {c: [] for c in _scalars(elements, "vertex")}
    attributes: dict[str, list] = {c: [] for c in _scalars(elements, "face")}
    faces: list[tuple[int, int, int]] = []
    for name, columns, corners in chunks:
        for c, v in columns.items():
            (vertices if name == "vertex" else attributes)[c] += v.tolist()
        faces += map(tuple, corners.tolist())
    return vertices, faces, attributes, meta


def ply_mesh(path: str, name: str | None = None) -> Mesh:
    v, f, _, _ = read_ply(path)
    return Mesh(tuple(zip(v["x"], v["y"], v["z"])), tuple(f), name)


def _word_places(f, numbers: list[int]) -> list[int]:
    """The first bytes of an open file's words with these numbers, in order; behind its last word, the file's end."""
    import numpy as np

    blank = np.zeros(256, bool)
    blank[[*b" \t\n\r\x0b\x0c"]] = True
    found: list[int] = []
    seen, at, after = 0, f.tell(), True
    while len(found) < len(numbers) and (block := f.read(BLOCK >> 2)):
        gaps = blank[np.frombuffer(block, np.uint8)]
        firsts = np.flatnonzero(~gaps & np.concatenate(([after], gaps[:-1])))
        while len(found) < len(numbers) and numbers[len(found)] < seen + len(firsts):
            found.append(at + int(firsts[numbers[len(found)] - seen]))
        seen, at, after = seen + len(firsts), at + len(block), bool(gaps[-1])
    if any(n > seen for n in numbers[len(found) :]):
        raise ModelError("the file ends before its last element")
    return found + [at] * (len(numbers) - len(found))


def _ply_parts(path: str) -> dict[str, list[tuple[int, int, int, int]]] | None:
    """For vertices and faces, chunks that can be read apart: first record, records, first byte and bytes. None where
    lists of any length leave records without a known place."""
    with open(path, "rb") as f:
        elements, _, kind = _ply_head(f)
        lists = {name: sum(isinstance(t, list) for _, t in properties) for name, _, properties in elements}
        if len(lists) < len(elements) or any(n != (name == "face") for name, n in lists.items()) or not _scalars(elements, "vertex"):
            return None
        ascii_, body = kind == "ascii", f.tell()
        made, at = [], 0 if ascii_ else body
        for name, n, properties in elements:
            if ascii_:
                width = sum(4 if isinstance(t, list) else 1 for _, t in properties)
            else:
                width = struct.calcsize("<" + "".join(PLY_TYPES[t[0]] + 3 * PLY_TYPES[t[1]] if isinstance(t, list) else PLY_TYPES[t] for _, t in properties))
            for start in range(0, n, CHUNK):
                made.append((name, start, min(CHUNK, n - start), at))
                at += made[-1][2] * width
        places = [*(m[3] for m in made), at]
        if ascii_:
            places = _word_places(f, places)
        elif at > f.seek(0, 2):
            raise ModelError("the file ends before its last element")
    parts: dict[str, list] = {"vertex": [], "face": []}
    for (name, start, n, _), at, end in zip(made, places, places[1:]):
        if name in parts:
            parts[name].append((start, n, at, end - at))
    return parts


def _ply_batch(name: str, first: int, held: dict, corners, names: list[str], columns: list[str]):
    """A chunk's records as Arrow columns, numbered from the first."""
    import numpy as np
    import pyarrow as pa

    n = len(corners) if name == "face" else len(next(iter(held.values()), ()))
    ids = [np.arange(first, first + n), *(corners[:, m] for m in range(3) if name == "face")]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in [*ids, *(np.asarray(held[c], float) for c in columns)]], names=[*names, *columns])


def ply_tables(spark: SparkSession, path: str) -> MeshTables:
    """A PLY file with all its properties, as vertex and face tables. Where executors reach the file and its records
    have known places, they read it, and the driver only looks for the places; else the driver reads a chunk at a time."""
    import os

    import pyarrow as pa

    path = os.path.abspath(path)
    elements, meta, chunks = ply_chunks(path)
    columns = {"vertex": _scalars(elements, "vertex"), "face": _scalars(elements, "face")}
    lead = {"vertex": ["vertex_id"], "face": ["face_id", "v0", "v1", "v2"]}
    ddl = {e: ", ".join([*(f"{c} long" for c in lead[e]), *(f"`{c}` double" for c in columns[e])]) for e in lead}
    made = store.scratch_dir(spark)
    parts = _ply_parts(path) if store._mounted(spark, f"file://{path}") and store._mounted(spark, made) else None
    if parts is not None:
        return MeshTables(*(_ply_table(spark, path, e, parts[e], lead[e], columns[e], ddl[e], f"{made}/{e}") for e in lead), meta)
    done = {e: store.Upload(spark, ddl[e]) for e in lead}
    places = dict.fromkeys(lead, 0)
    for name, held, corners in chunks:
        batch = _ply_batch(name, places[name], held, corners, lead[name], columns[name])
        places[name] += batch.num_rows
        done[name].add(pa.Table.from_batches([batch]))
    return MeshTables(done["vertex"].table(), done["face"].table(), meta)


def _ply_table(spark: SparkSession, path: str, name: str, parts: list, names: list[str], columns: list[str], ddl: str, folder: str) -> DataFrame:
    """The element's parts, each read by a task, as a table in a folder that all share."""
    if not parts:
        return spark.createDataFrame([], ddl)
    with open(path, "rb") as f:
        elements, _, kind = _ply_head(f)
    properties = next(p for e, _, p in elements if e == name)

    def packed(batches, target) -> int:
        import io

        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        rows = 0
        for number in (n for batch in batches for n in batch.column(0).to_pylist()):  # a task has one
            first, n, at, size = parts[number]
            with open(path, "rb") as f:
                f.seek(at)
                body = io.BytesIO(_exactly(f, size))
            held, lists = _ply_fixed(body, _Words(body), kind, n, properties)
            batch = _ply_batch(name, first, held, lists[0] if lists else np.zeros((0, 3), np.int64), names, columns)
            pq.write_table(pa.Table.from_batches([batch]), target)
            rows += n
        return rows

    try:
        rows = store._by_executors(spark.range(0, len(parts), 1, len(parts)), packed, store._os_path(spark, folder))
    except Exception as e:
        if said := re.search(r"ModelError: (.*)", str(e)):
            raise ModelError(said[1]) from e
        raise
    if rows != sum(n for _, n, _, _ in parts):
        raise ModelError("the file changed while it was read")
    return spark.read.schema(ddl).parquet(folder)


#: A mesh file is one machine's, and the driver numbers its vertices: larger meshes are an error, not a full driver.
MOST_VERTICES = 50_000_000
#: Records of a file that the driver reads at a time, bytes of text, and rows of a table that come to it at a time.
CHUNK, BLOCK, PART = 1 << 16, 1 << 22, 100_000


def _streamed(df: DataFrame, rows: int, keys: list[str], said: Callable) -> Iterator[tuple]:
    """The table in the order of its keys, the first of which deals it out: what ``said`` makes of a batch, some bytes,
    made by the executors. The driver holds two parts of the table at a time."""

    def turned(batches):
        import pyarrow as pa

        for batch in batches:
            made = said(batch)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in made], names=[f"b{n}" for n in range(len(made))])

    width = 2 if getattr(said, "pair", False) else 1
    dealt = df.repartitionByRange(max(1, -(-rows // PART)), keys[0]).sortWithinPartitions(*keys)
    return (tuple(r) for r in dealt.mapInArrow(turned, ", ".join(f"b{n} binary" for n in range(width))).toLocalIterator(prefetchPartitions=True))


def _texts(column):
    """What str says of a column's values, as an array of objects; missing ones are nan."""
    import numpy as np

    coded = column.dictionary_encode()
    words = [*("nan" if v is None else str(v) for v in coded.dictionary.to_pylist()), "nan"]
    return np.array(words, object)[coded.indices.fill_null(len(words) - 1).to_numpy(zero_copy_only=False)]


def _lines(columns: list) -> bytes:
    """A batch's columns as lines of words."""
    texts = [_texts(c).tolist() for c in columns]
    return "".join([f"{line}\n" for line in (map(" ".join, zip(*texts)) if len(texts) > 1 else texts[0])]).encode("ascii")


def _records(columns: list, kinds: list[str]) -> bytes:
    """A batch's columns as packed little-endian records: i for 32-bit integers, f for 32-bit floats."""
    import numpy as np

    table = np.zeros(len(columns[0]), np.dtype([(f"c{n}", f"<{k}4") for n, k in enumerate(kinds)]))
    for n, (c, k) in enumerate(zip(columns, kinds)):
        if k == "i" and c.null_count:
            raise ModelError("an integer is missing")
        v = c.to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            table[f"c{n}"] = v
        if k == "f" and (np.isinf(table[f"c{n}"]) & ~np.isinf(v)).any():
            raise ModelError("a number is too large for 32 bits")
    return table.tobytes()


class _Faces:
    """Face corners as places in the vertex list. The vertices' ids are held sorted, 4 or 8 bytes each."""

    def __init__(self, mesh: MeshTables, points: bool = False):
        ends = [f(c).cast("double") for c in "xyz" for f in (F.min, F.max)] if points else []
        self.nv, low, high, *self.ends = mesh.vertices.agg(F.count(F.lit(1)), F.min("vertex_id"), F.max("vertex_id"), *(e.alias(f"e{n}") for n, e in enumerate(ends))).first()
        if self.nv > MOST_VERTICES:
            raise ModelError(f"{self.nv} vertices do not go into one file")
        import numpy as np

        self.nf, self.low, self.high, self.seen = mesh.faces.count(), low or 0, high or 0, 0
        self.ids = np.empty(self.nv, np.uint32 if self.high - self.low < 2**32 else np.uint64)

    def keep(self, ids: bytes) -> None:
        """The next vertices, in order."""
        import numpy as np

        ids = np.frombuffer(ids, np.int64) - self.low
        if self.seen + len(ids) > self.nv:
            raise ModelError("the mesh changed while it was written")
        self.ids[self.seen : self.seen + len(ids)] = ids
        self.seen += len(ids)

    def places(self, corners: bytes):
        """n by 3 vertex ids as places."""
        import numpy as np

        if self.seen != self.nv:
            raise ModelError("the mesh changed while it was written")
        asked = np.frombuffer(corners, np.int64)
        near = (np.clip(asked, self.low, self.high) - self.low).astype(self.ids.dtype)
        at = np.searchsorted(self.ids, near, "right") - 1
        if len(asked) and (not self.nv or (at < 0).any() or (self.ids[at].astype(np.int64) + self.low != asked).any()):
            raise ModelError("a face names a vertex that is not there")
        return at.reshape(-1, 3)


def _led(n: int, turn: Callable) -> Callable:
    """For ``_streamed``: the first n columns as rows of 64-bit integers, and what ``turn`` makes of the others."""

    def said(batch):
        import numpy as np

        lead = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:n]], 1).astype(np.int64)
        return lead.tobytes(), turn(batch.columns[n:]) if batch.num_columns > n else b""

    said.pair = True
    return said


def write_ply(mesh: MeshTables, path: str, binary: bool = False) -> None:
    """A PLY file of a mesh with its attributes. A file is one machine's: meshes for viewers, not corpora."""
    import numpy as np

    vcols = ["x", "y", "z", *(c for c in "ijk" if c in mesh.vertices.columns), *sorted(set(mesh.vertices.columns) - {"vertex_id", "block_id", "corner", *"xyzijk"})]
    fcols = [*(c for c in "ijk" if c in mesh.faces.columns), *sorted(set(mesh.faces.columns) - {"face_id", "block_id", "v0", "v1", "v2", *"ijk"})]
    order = _Faces(mesh)
    kind = lambda c: "int" if c in ("i", "j", "k") else "float"
    head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", *(f"comment {k}={json.dumps(v)}" for k, v in mesh.meta.items()), f"element vertex {order.nv}"]
    head += [f"property {kind(c)} {c}" for c in vcols] + [f"element face {order.nf}", "property list uchar int vertex_indices", *(f"property {kind(c)} {c}" for c in fcols), "end_header"]

    def table(df: DataFrame, ids: list[str], columns: list[str]) -> Iterator[tuple]:
        kinds = [kind(c)[0] for c in columns]
        turn = (lambda held: _records(held, kinds)) if binary else _lines
        typed = [F.col(c).cast("int" if kind(c) == "int" else "double").alias(c) if binary else F.col(c) for c in columns]
        return _streamed(df.select(*(F.col(c).cast("long").alias(c) for c in ids), *typed), order.nv if ids[0] == "vertex_id" else order.nf, ids[:1], _led(len(ids), turn))

    with open(path, "wb") as f:
        f.write(("\n".join(head) + "\n").encode("ascii"))
        for ids, body in table(mesh.vertices, ["vertex_id"], vcols):
            order.keep(ids)
            f.write(body)
        done = 0
        for ids, body in table(mesh.faces, ["face_id", "v0", "v1", "v2"], fcols):
            corners = order.places(np.frombuffer(ids, np.int64).reshape(-1, 4)[:, 1:].tobytes())
            done += len(corners)
            if binary:
                out = np.zeros(len(corners), np.dtype([("n", "u1"), ("v", "<i4", (3,)), ("r", f"V{4 * len(fcols)}")] if fcols else [("n", "u1"), ("v", "<i4", (3,))]))
                out["n"], out["v"] = 3, corners
                if fcols:
                    out["r"] = np.frombuffer(body, f"V{4 * len(fcols)}")
                f.write(out.tobytes())
            else:
                rest = body.decode().split("\n") if fcols else [""] * len(corners)
                f.write("".join([f"3 {a} {b} {c}{' ' if r else ''}{r}\n" for (a, b, c), r in zip(corners.tolist(), rest)]).encode())
        if order.seen != order.nv or done != order.nf:
            raise ModelError("the mesh changed while it was written")


# GLB


def write_glb(mesh: MeshTables, path: str, colours: DataFrame | None = None) -> None:
    """A binary glTF 2.0 file: positions, indices, and vertex colours if given (vertex_id, r, g, b, a). Its lengths are
    known before its parts, which are written as they come."""
    order = _Faces(mesh, points=True)
    nv, nf = order.nv, order.nf
    sizes = [12 * nv, 12 * nf] + ([4 * nv] if colours is not None else [])
    accessors = [
        {"bufferView": 0, "componentType": 5126, "count": nv, "type": "VEC3", "min": [0 if e is None else e for e in order.ends[::2]], "max": [0 if e is None else e for e in order.ends[1::2]]},
        {"bufferView": 1, "componentType": 5125, "count": 3 * nf, "type": "SCALAR"},
    ]
    primitive: dict = {"attributes": {"POSITION": 0}, "indices": 1, "mode": 4}
    if colours is not None:
        accessors.append({"bufferView": 2, "componentType": 5121, "normalized": True, "count": nv, "type": "VEC4"})
        primitive["attributes"]["COLOR_0"] = 2
    views, at = [], 0
    for n, size in enumerate(sizes):
        views.append({"buffer": 0, "byteOffset": at, "byteLength": size, "target": 34963 if n == 1 else 34962})
        at += size  # all are multiples of four bytes
    scene = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [primitive], "extras": mesh.meta}], "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": at}]}
    text = json.dumps(scene).encode()
    text += b" " * (-len(text) % 4)
    if 28 + len(text) + at >= 2**32:
        raise ModelError("a GLB file has less than 4 GB")
    points = mesh.vertices.select(F.col("vertex_id").cast("long").alias("vertex_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    faces = mesh.faces.select(*(F.col(c).cast("long").alias(c) for c in ("face_id", "v0", "v1", "v2")))

    def corners(batch):
        import numpy as np

        return (np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1).astype(np.int64).tobytes(),)

    def shades(batch):
        import numpy as np

        table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
        if not ((table >= 0) & (table <= 255)).all():
            raise ModelError("a colour is outside 0 to 255")
        return (table.astype(np.uint8).tobytes(),)

    with open(path, "wb") as f:
        f.write(struct.pack("<III", 0x46546C67, 2, 28 + len(text) + at))
        f.write(struct.pack("<II", len(text), 0x4E4F534A) + text)
        f.write(struct.pack("<II", at, 0x004E4942))
        for ids, body in _streamed(points, nv, ["vertex_id"], _led(1, lambda held: _records(held, ["f"] * 3))):
            order.keep(ids)
            f.write(body)
        for (body,) in _streamed(faces, nf, ["face_id"], corners):
            f.write(order.places(body).astype("<u4").tobytes())
        if colours is not None:
            for (body,) in _streamed(colours.select("vertex_id", "r", "g", "b", "a"), nv, ["vertex_id"], shades):
                f.write(body)
        if f.tell() != 28 + len(text) + at:
            raise ModelError("the mesh changed while it was written")


def glb_chunks(path: str) -> tuple[dict, Iterator]:
    """The scene of a GLB file that this module wrote, and its parts a chunk at a time: the part's number (0 positions,
    1 triangles, 2 colours) and an array of rows."""
    import os

    import numpy as np

    with open(path, "rb") as f:
        magic, version, total, n, _ = struct.unpack("<IIIII", f.read(20).ljust(20, b"\0"))
        if magic != 0x46546C67 or version != 2 or total != os.path.getsize(path):
            raise ModelError("not a GLB file")
        scene = json.loads(f.read(n))

    def chunks():
        with open(path, "rb") as f:
            for part, (view, form) in enumerate(zip(scene["bufferViews"], (("<f4", 3), ("<u4", 3), ("u1", 4)))):
                f.seek(28 + n + view["byteOffset"])
                rows = np.dtype((form[0], (form[1],)))
                for start in range(0, view["byteLength"], CHUNK * rows.itemsize):
                    data = _exactly(f, min(CHUNK * rows.itemsize, view["byteLength"] - start))
                    yield part, np.frombuffer(data, form[0]).reshape(-1, form[1])

    return scene, chunks()


def read_glb(path: str) -> tuple[list[tuple], list[tuple], list[tuple], dict]:
    """Positions, triangles, colours and extras of a GLB file that this module wrote, all in lists."""
    scene, chunks = glb_chunks(path)
    out: tuple[list, list, list] = ([], [], [])
    for part, table in chunks:
        out[part].extend(map(tuple, table.tolist()))
    return *out, scene["meshes"][0]["extras"]


# VTK


def _data_array(f, name: str, kind: str, text: Iterable[str | bytes], components: int = 1) -> None:
    f.write(f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{components}" format="ascii">\n'.encode("ascii"))
    for t in text:
        f.write(t.encode("ascii") if isinstance(t, str) else t)
    f.write(b"</DataArray>\n")


def _counted(numbers: range) -> Iterator[str]:
    for at in range(0, len(numbers), CHUNK):
        yield "".join([f"{n}\n" for n in numbers[at : at + CHUNK]])


def _cell_data(f, table: DataFrame, rows: int, key: str, columns: list[str]) -> None:
    """A column after the other: each is streamed to the driver in the table's order."""
    f.write(b"<CellData>\n")
    for c in columns:
        held = table.select(F.col(key).alias("_key"), F.col(c).cast("double").alias("_value"))
        _data_array(f, c, "Float64", (b for (b,) in _streamed(held, rows, ["_key"], lambda batch: (_lines(batch.columns[1:]),))))
    f.write(b"</CellData>\n")


def write_vti(model: BlockModel, path: str, columns: list[str]) -> None:
    """The dense grid as VTK image data (XML): number columns as cell data, NaN where the model has no block. The frame's
    axes are the image's direction. A file is one machine's, like a mesh."""
    g = model.geometry
    if g.blocks > MOST_VERTICES:
        raise ModelError(f"{g.blocks} cells do not go into one file")
    extent = " ".join(f"0 {n}" for n in g.shape)
    said = lambda xs: " ".join(map(repr, xs))
    direction = [a[n] for n in range(3) for a in g.axes]
    with open(path, "wb") as f:
        f.write(b'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="1.0" byte_order="LittleEndian">\n')
        f.write(f'<ImageData WholeExtent="{extent}" Origin="{said(g.world_point(g.corner))}" Spacing="{said(g.block_size)}" Direction="{said(direction)}">\n<Piece Extent="{extent}">\n'.encode("ascii"))
        _cell_data(f, grid_table(model, columns), g.blocks, "cell", columns)
        f.write(b"</Piece>\n</ImageData>\n</VTKFile>\n")


def write_vtu(model: BlockModel, path: str, columns: list[str]) -> None:
    """The model's blocks as a VTK unstructured grid (XML) of voxels, eight points each."""
    n = model.df.count()
    if 8 * n > MOST_VERTICES:
        raise ModelError(f"{n} blocks do not go into one file")
    points = hexahedra(model).select("block_id", "corner", "x", "y", "z")
    with open(path, "wb") as f:
        f.write(b'<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="1.0" byte_order="LittleEndian">\n')
        f.write(f'<UnstructuredGrid>\n<Piece NumberOfPoints="{8 * n}" NumberOfCells="{n}">\n<Points>\n'.encode("ascii"))
        _data_array(f, "Points", "Float64", (b for (b,) in _streamed(points, 8 * n, ["block_id", "corner"], lambda batch: (_lines(batch.columns[2:]),))), 3)
        f.write(b"</Points>\n<Cells>\n")
        _data_array(f, "connectivity", "Int64", _counted(range(8 * n)))
        _data_array(f, "offsets", "Int64", _counted(range(8, 8 * n + 1, 8)))
        _data_array(f, "types", "UInt8", ("11\n" * min(CHUNK, n - at) for at in range(0, n, CHUNK)))  # fixed value: a voxel, its corners numbered with x fastest
        f.write(b"</Cells>\n")
        _cell_data(f, model.df, n, "block_id", columns)
        f.write(b"</Piece>\n</UnstructuredGrid>\n</VTKFile>\n")


def vtk_chunks(path: str) -> Iterator[tuple[str | None, object]]:
    """A VTK XML file in ASCII, a block at a time: first None and the grid element's attributes; then each data array's
    name with None where it begins, and with arrays of the numbers that follow."""
    from xml.parsers import expat

    import numpy as np

    out: list = []
    text: list[str] = []
    at = {"depth": 0, "grids": 0, "name": None, "inside": False}

    def flush(whole: bool) -> None:
        held = "".join(text)
        end = len(held) if whole else max(map(held.rfind, " \n\t\r")) + 1
        text[:] = [held[end:]] if end < len(held) else []
        if numbers := held[:end].split():
            out.append((at["name"], np.fromiter(map(float, numbers), float, len(numbers))))

    def start(tag, attributes):
        at["depth"] += 1
        if at["depth"] == 2:
            at["grids"] += 1
            if at["grids"] == 1:
                out.append((None, attributes))
        if tag == "DataArray" and at["grids"] == 1:
            at["name"], at["inside"] = attributes.get("Name", ""), True
            out.append((at["name"], None))

    def end(tag):
        at["depth"] -= 1
        if tag == "DataArray" and at["inside"]:
            flush(True)
            at["inside"] = False

    parser = expat.ParserCreate()
    parser.buffer_text, parser.buffer_size = True, 1 << 16
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda t: text.append(t) if at["inside"] else None
    with open(path, "rb") as f:
        while True:
            block = f.read(BLOCK)
            parser.Parse(block, not block)
            if at["inside"]:
                flush(False)
            yield from out
            out.clear()
            if not block:
                return


def read_vtk(path: str) -> tuple[dict[str, str], dict[str, list[float]]]:
    """The grid element's attributes and all data arrays of a VTK XML file in ASCII, in lists."""
    grid: dict[str, str] = {}
    held: dict[str, list[float]] = {}
    for name, part in vtk_chunks(path):
        if name is None:
            grid = part
        elif part is None:
            held[name] = []
        else:
            held[name] += part.tolist()
    return grid, held


# DXF


@dataclass
class Entity:
    """A DXF entity: its group codes in order, and the vertices that follow a POLYLINE."""

    kind: str
    codes: list[tuple[int, str]]
    vertices: list[Entity]

    def first(self, code: int, default: str) -> str:
        return next((v for c, v in self.codes if c == code), default)

    def number(self, code: int, default: float = 0.0) -> float:
        return float(self.first(code, str(default)))

    def point(self, n: int = 0) -> Vector:
        return tuple(self.number(10 * a + n, float("nan") if a < 3 else 0.0) for a in (1, 2, 3))


def _entities(path: str) -> tuple[list[Entity], dict[str, tuple[Vector, list[Entity]]]]:
    """The drawing's entities, and each block's base point and entities."""
    with open(path, encoding="utf-8", errors="replace") as f:
        lines = [x.strip() for x in f]
    found: list[Entity] = []
    for code, value in zip(lines[::2], lines[1::2]):
        if code == "0":
            found.append(Entity(value, [], []))
        elif found:
            found[-1].codes.append((int(code), value))
    drawing: list[Entity] = []
    blocks: dict[str, tuple[Vector, list[Entity]]] = {}
    section, into, line = "ENTITIES", drawing, None
    for e in found:
        if e.kind == "SECTION":
            section = e.first(2, "")
            into = drawing if section == "ENTITIES" else []
        elif e.kind == "BLOCK":
            into = []
            blocks[e.first(2, "")] = tuple(0.0 if c != c else c for c in e.point()), into
        elif e.kind == "VERTEX" and line is not None:
            line.vertices.append(e)
        elif e.kind == "SEQEND":
            line = None
        elif e.kind not in ("ENDBLK", "ENDSEC", "EOF"):
            line = e if e.kind == "POLYLINE" else None
            into.append(e)
    return drawing, blocks


def _fan(points: list[Vector]) -> list[tuple[Vector, Vector, Vector]]:
    """A convex face as triangles round its first point."""
    points = list(dict.fromkeys(p for p in points if all(math.isfinite(c) for c in p)))
    return [(points[0], a, b) for a, b in zip(points[1:], points[2:])]


def _polyline(e: Entity) -> list[tuple[Vector, Vector, Vector]]:
    """The faces of a polyface mesh (flag 64) or of a polygon mesh of M by N vertices (flag 16); 1 and 32 close M and N."""
    flags = int(e.number(70))
    if flags & 64:
        points = [v.point() for v in e.vertices if int(v.number(70)) & 64]
        out = []
        for v in e.vertices:
            if not int(v.number(70)) & 64:  # indices from 1; a negative one hides the edge after it, 0 is none
                corners = [abs(int(v.number(c))) for c in (71, 72, 73, 74)]
                out += _fan([points[n - 1] for n in corners if n])
        return out
    if not flags & 16:
        return []
    points, m, n = [v.point() for v in e.vertices], int(e.number(71)), int(e.number(72))
    at = lambda i, j: points[i % m * n + j % n]
    cells = [(i, j) for i in range(m if flags & 1 else m - 1) for j in range(n if flags & 32 else n - 1)]
    return [t for i, j in cells for t in _fan([at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)])]


def _mesh_entity(e: Entity) -> list[tuple[Vector, Vector, Vector]]:
    """The faces of a MESH: 92 vertices (10, 20, 30), then 93 numbers (90) of faces, each led by its size."""
    points, numbers, counting, left = [], [], False, 0
    for code, value in e.codes:
        if code in (10, 20, 30) and not counting:
            points.append(float(value))
        elif code == 93:
            counting, left = True, int(value)
        elif code == 90 and left:
            numbers.append(int(value))
            left -= 1
    corners = list(zip(points[::3], points[1::3], points[2::3]))
    out, at = [], 0
    while at < len(numbers):
        n = numbers[at]
        out += _fan([corners[i] for i in numbers[at + 1 : at + 1 + n]])
        at += 1 + n
    return out


def _placed(e: Entity, base: Vector) -> list[Callable[[Vector], Vector]]:
    """Where an INSERT puts its block: scaled, turned about z and moved, once for each row and column."""
    scale = tuple(e.number(c, 1.0) for c in (41, 42, 43))
    turn = math.radians(e.number(50))
    cos, sin, to = math.cos(turn), math.sin(turn), e.point()

    def at(dx: float, dy: float) -> Callable[[Vector], Vector]:
        def move(p: Vector) -> Vector:
            x, y, z = ((c - b) * s for c, b, s in zip(p, base, scale))
            x, y = x + dx, y + dy
            return to[0] + x * cos - y * sin, to[1] + x * sin + y * cos, to[2] + z

        return move

    columns, rows = (max(1, int(e.number(c, 1))) for c in (70, 71))
    return [at(c * e.number(44), r * e.number(45)) for r in range(rows) for c in range(columns)]


def _triangles(e: Entity, blocks: dict[str, tuple[Vector, list[Entity]]], inside: tuple[str, ...] = ()) -> list[tuple[Vector, Vector, Vector]]:
    if e.kind == "3DFACE":
        return _fan([e.point(n) for n in range(4)])
    if e.kind == "POLYLINE":
        return _polyline(e)
    if e.kind == "MESH":
        return _mesh_entity(e)
    name = e.first(2, "")
    if e.kind != "INSERT" or name not in blocks:
        return []
    if name in inside:
        raise ModelError(f"block {name} holds itself")
    base, held = blocks[name]
    flat = [t for x in held for t in _triangles(x, blocks, (*inside, name))]
    return [tuple(map(move, t)) for move in _placed(e, base) for t in flat]


def dxf_meshes(path: str, by: str = "layer") -> dict[str, Mesh]:
    """The faces of a text DXF file: 3DFACE, polyface and polygon meshes of POLYLINE, MESH, and what INSERT places
    of blocks. By the layer of the drawing's entities, or ``by`` = "block": those placed by INSERT alone, by the
    block's name. Faces of more corners are fans of triangles; equal points are one vertex."""
    if by not in ("layer", "block"):
        raise ModelError("by is layer or block")
    drawing, blocks = _entities(path)
    found: dict[str, list] = {}
    for e in drawing:
        if (by == "layer" or e.kind == "INSERT") and (flat := _triangles(e, blocks)):
            found.setdefault(e.first(8, "0") if by == "layer" else e.first(2, ""), []).extend(flat)
    out = {}
    for name, triangles in found.items():
        places: dict[tuple, int] = {}
        faces = [tuple(places.setdefault(p, len(places)) for p in t) for t in triangles]
        out[name] = Mesh(tuple(places), tuple(faces), name)
    if not out:
        raise ModelError("the file holds no faces")
    return out


# rasters


def read_raster(path: str, name: str | None = None) -> Raster:
    """A raster from a NumPy archive; the axes and values may have any of their usual names."""
    import numpy as np

    with np.load(path) as held:
        def one(*names):
            key = next((n for n in names if n in held), None)
            if key is None:
                raise ModelError(f"none of {names} in the archive")
            return held[key]

        xs, ys, values = one("x", "x_coords", "xs"), one("y", "y_coords", "ys"), one("values", "z", "surface")
    return Raster(tuple(xs.tolist()), tuple(ys.tolist()), tuple(map(tuple, values.tolist())), name)


#: TIFF's field types as struct codes and sizes, the tags that are read, and its sample formats.
TIFF_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
TIFF_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "counts", 339: "format", 33550: "scale", 33922: "tie", 42113: "nodata"}
TIFF_FORMATS = {1: "u", 2: "i", 3: "f"}


def read_geotiff(path: str, name: str | None = None) -> Raster:
    """The first band of a GeoTIFF, heights at the pixels' centres: strips or tiles, plain or deflated, and a frame that
    is not turned. A pixel without data is an error: a surface has a height everywhere."""
    import zlib

    import numpy as np

    with open(path, "rb") as f:
        raw = f.read()
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(f"{order}H", raw, 2)[0] != 42:
        raise ModelError("not a TIFF file")
    at = struct.unpack_from(f"{order}I", raw, 4)[0]
    tags: dict[str, tuple] = {}
    for n in range(struct.unpack_from(f"{order}H", raw, at)[0]):
        tag, kind, count = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * n)
        if tag in TIFF_TAGS and kind in TIFF_TYPES:
            code, size = TIFF_TYPES[kind]
            place = at + 10 + 12 * n if size * count <= 4 else struct.unpack_from(f"{order}I", raw, at + 10 + 12 * n)[0]
            form = f"{order}{count}s" if code == "s" else f"{order}{code * count}"
            tags[TIFF_TAGS[tag]] = struct.unpack_from(form, raw, place)
    one = lambda key, default: tags.get(key, (default,))[0]
    width, height, samples = one("width", 0), one("height", 0), one("samples", 1)
    if one("compression", 1) not in (1, 8, 32946) or one("predictor", 1) != 1:
        raise ModelError("only plain and deflated TIFF files without a predictor are read")
    if "scale" not in tags or "tie" not in tags:
        raise ModelError("the file does not say where its pixels are")
    kind = np.dtype(f"{order}{TIFF_FORMATS.get(one('format', 1), 'u')}{one('bits', 8) // 8}")
    wide, high = (tags["tile_width"][0], tags["tile_height"][0]) if "tile_width" in tags else (width, min(one("rows", height), height))
    across = -(-width // wide)
    whole = np.zeros((-(-height // high) * high, across * wide))
    for n, (start, length) in enumerate(zip(tags["offsets"], tags["counts"])):
        part = raw[start : start + length]
        part = np.frombuffer(zlib.decompress(part) if one("compression", 1) != 1 else part, kind).reshape(-1, wide, samples)[:, :, 0]
        y, x = n // across * high, n % across * wide
        whole[y : y + len(part), x : x + wide] = part
    values = whole[:height, :width]
    if "nodata" in tags and (values == float(tags["nodata"][0].split(b"\0")[0])).any():
        raise ModelError("the raster has pixels without data")
    (dx, dy, *_), (i, j, _, x0, y0, *_) = tags["scale"], tags["tie"]
    xs, ys = x0 + (np.arange(width) + 0.5 - i) * dx, y0 - (np.arange(height) + 0.5 - j) * dy
    return Raster(tuple(xs.tolist()), tuple(ys.tolist()), tuple(map(tuple, values.tolist())), name)


# polygons


def wkb_polygon(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """The parts (rings of x, y) of a WKB polygon or multipolygon; z and m are passed over."""

    def at(offset: int) -> tuple[list, int]:
        order = "<" if data[offset] == 1 else ">"
        kind = struct.unpack_from(f"{order}I", data, offset + 1)[0]
        dims = 2 + bool(kind & 0x80000000 or kind // 1000 % 10 in (1, 3)) + bool(kind & 0x40000000 or kind // 1000 % 10 in (2, 3))
        offset += 5 + (4 if kind & 0x20000000 else 0)
        base = (kind & 0x0FFFFFFF) % 1000
        n = struct.unpack_from(f"{order}I", data, offset)[0]
        offset += 4
        out: list = []
        if base == 6:
            for _ in range(n):
                part, offset = at(offset)
                out += part
            return out, offset
        if base != 3:
            raise ModelError("the geometry is no polygon")
        rings = []
        for _ in range(n):
            m = struct.unpack_from(f"{order}I", data, offset)[0]
            flat = struct.unpack_from(f"{order}{m * dims}d", data, offset + 4)
            offset += 4 + 8 * m * dims
            rings.append([(flat[i * dims], flat[i * dims + 1]) for i in range(m)])
        return [rings], offset

    return at(0)[0]


def to_wkb(rings: Iterable[Iterable[tuple[float, float]]]) -> bytes:
    rings = [list(r) for r in rings]
    body = b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)
    return struct.pack("<BII", 1, 3, len(rings)) + body


def read_polygon(spark: SparkSession, path: str, name: str, name_column: str = "name", geometry_column: str = "geometry") -> Polygon:
    """The polygon of that name in a GeoParquet table; none or several are an error."""
    rows = spark.read.parquet(path).where(F.col(name_column) == name).select(geometry_column).limit(2).collect()
    if len(rows) != 1:
        raise ModelError(f"{'no polygon' if not rows else 'several polygons'} named {name!r}")
    return Polygon(tuple(tuple(map(tuple, part)) for part in wkb_polygon(bytes(rows[0][0]))), name)
