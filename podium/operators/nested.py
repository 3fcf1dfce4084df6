"""Deeply nested, unevenly written records as flat, linked tables.

A record's text is read tolerantly (byte-order mark, JSON or Python literals, JSON text within JSON strings, wrapper
objects, snake or camel case), and a depth-first traversal gives every node its pre-order and post-order number. Nodes
go into one table per type (their path); a node lies within another exactly if its interval does, which is how children
are tied to parents afterwards. The link needs one window per document: intervals nest, so the nearest earlier
node of the parent's type is the only candidate.

Defined results: null, blank, cut-off or otherwise unreadable texts have no nodes, nor have texts that hold what JSON
can't (byte strings, sets); half a surrogate pair reads as U+FFFD; nesting and wrappers may be of any depth, what the
parsers of the standard library give up on is read by a loop with its own stack; an object or scalar where a list is
usual stands at position 0; an empty (null) place keeps its position but is no node; equal texts of one record are
one document, different texts are several. Without `paths` every node carries its whole path, so a text's result grows
with nodes x depth; with `paths` other nodes carry none.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of objects that only wrap a record.
WRAPPERS = ("data", "payload", "result", "value", "body", "content")
#: Records per task, at most and about.
RECORDS = 20_000
NODE = "record_id long, doc long, path string, pre long, post long, pos long, value string"
_ARROW = pa.schema([("record_id", pa.int64()), ("doc", pa.int64()), ("path", pa.string()), ("pre", pa.int64()), ("post", pa.int64()), ("pos", pa.int64()), ("value", pa.string())])
_BLANK = " \t\r\n\u00a0\u200b\ufeff\x00"


class Unreadable(ValueError):
    """The text doesn't end where its value does."""


_TOKEN = re.compile(r"""\s*([\[\]{}(),:]|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s\[\]{}(),:"']+)""", re.DOTALL)
_CLOSES = {"[": "]", "{": "}", "(": ")"}


def _scalar(token: str) -> object:
    try:
        return json.loads(token)
    except ValueError:
        pass
    try:
        v = ast.literal_eval(token)
    except (ValueError, SyntaxError, MemoryError, TypeError) as e:
        raise Unreadable from e
    if v is not None and not isinstance(v, (str, int, float)):
        raise Unreadable
    return v


def read_deep(text: str) -> object:
    """The value of a text nested beyond what the parsers take: one pass over its tokens with a stack of open values."""
    root: list = []
    stack: list[list] = [["", root, None, "value"]]  # opening bracket, container, key, what may come next
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable
        at, t = m.end(), m[1]
        top = stack[-1]
        bracket, inside, _, due = top
        if t == "," and due == "comma":
            top[3] = "key" if bracket == "{" else "value"
        elif t == ":" and due == "colon":
            top[3] = "value"
        elif t in ("]", "}", ")") and _CLOSES.get(bracket) == t and (due in ("comma", "key") or due == "value" and bracket != "{"):
            stack.pop()
        elif due == "key" and t not in _CLOSES:
            top[2], top[3] = str(_scalar(t)), "colon"
        elif due == "value":
            v: object = _scalar(t) if t not in _CLOSES else {} if t == "{" else []
            if bracket == "{":
                inside[top[2]] = v
            else:
                inside.append(v)
            top[3] = "comma" if bracket else "end"
            if t in _CLOSES:
                stack.append([t, v, None, "key" if t == "{" else "value"])
        else:
            raise Unreadable
    if len(stack) != 1 or len(root) != 1:
        raise Unreadable
    return root[0]


def _plain(v: object) -> object:
    """`v` if it holds only what JSON can, else an error; a walk with its own stack."""
    todo = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, (list, tuple)):
            todo += x
        elif x is not None and not isinstance(x, (str, int, float)):
            raise Unreadable
    return v


def read_text(text: str) -> object:
    """The value that a text holds, JSON before Python literals."""
    s = text.strip(_BLANK)
    if not s:
        raise Unreadable
    try:
        return json.loads(s)
    except RecursionError:
        return read_deep(s)
    except ValueError:
        pass
    try:
        return _plain(ast.literal_eval(s))
    except (RecursionError, MemoryError):
        return read_deep(s)
    except (ValueError, SyntaxError, TypeError) as e:
        if "too many nested" in str(e):
            return read_deep(s)
        raise Unreadable from e


def unfold(v: object) -> object:
    """`v`, read as often as it is text that holds an array, an object or quoted text."""
    while isinstance(v, str) and v.strip(_BLANK)[:1] in ("{", "[", '"'):
        v = read_text(v)
    return v


def camel(key: str) -> str:
    """bracket_progression and bracketProgression alike."""
    return re.sub(r"_+([a-zA-Z0-9])", lambda m: m[1].upper(), key.strip("_")) if "_" in key else key


def read_record(text: str, root: str) -> dict:
    """The object that holds `root`, without what it is wrapped in."""
    v = unfold(read_text(text))
    while isinstance(v, dict):
        v = {camel(str(k)): x for k, x in v.items()}
        inner = [k for k in WRAPPERS if k in v]
        if root in v or not inner:
            return v
        v = unfold(v[inner[0]])
    return {}


def _whole(s: str) -> str:
    """`s` with U+FFFD for halves of surrogate pairs, which no column of text can hold."""
    return s if s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def label(v: object, lists: frozenset[str], keep: frozenset[str] | None = None) -> list[tuple[str, int, int, int, str | None]]:
    """(path, pre, post, pos, scalar as text) of every node below and with the root `$`, which is at 0, or of those whose
    path is in `keep`.

    Paths leave list positions out: `$.groups.rounds` is any round. `lists` are keys whose values are lists by right:
    text there is read, and what stands alone is a list of one.
    """
    out: list = []
    pre = post = 0
    # What can lead to a node that is kept; any other path ends as "", so that deep texts don't pile up long ones.
    leads = keep and frozenset(p[:i] for p in keep for i in range(1, len(p) + 1) if p[i : i + 1] in ("", ".", "["))
    stack: list = [("$", 0, v, None)]
    while stack:
        path, pos, x, done = stack.pop()
        if done is not None:
            if done >= 0:
                out[done][2] = post
            post += 1
            continue
        if leads is not None and path not in leads:
            path = ""
        at = -1
        if keep is None or path in keep:
            scalar = None if isinstance(x, (dict, list, tuple)) else _whole(x) if isinstance(x, str) else json.dumps(x)
            at = len(out)
            out.append([_whole(path), pre, -1, pos, scalar])
        pre += 1
        stack.append((path, pos, None, at))
        kids: list = []
        if isinstance(x, dict):
            for k, y in x.items():
                key = camel(str(k))
                if key in lists:
                    y = unfold(y)
                    y = [unfold(z) for z in y] if isinstance(y, (list, tuple)) else [y]
                if isinstance(y, (list, tuple)):
                    kids += [(f"{path}.{key}", i, z, None) for i, z in enumerate(y) if z is not None]
                elif y is not None:
                    kids.append((f"{path}.{key}", 0, y, None))
        elif isinstance(x, (list, tuple)):
            kids = [(f"{path}[]", i, z, None) for i, z in enumerate(x) if z is not None]
        stack += reversed(kids)
    return [tuple(x) for x in out]


def shred(df: DataFrame, record: str, text: str, root: str, lists: tuple[str, ...], paths: tuple[str, ...] | None = None) -> DataFrame:
    """The nodes of all records: record_id, doc, path, pre, post, pos, value.

    `doc` tells a record's texts apart. `paths` keeps only nodes of these types; the numbers stay those of all nodes.
    """
    docs = df.select(F.col(record).cast("long").alias("record_id"), F.col(text).alias("text")).dropna().withColumn("doc", F.xxhash64("text"))
    # One shuffle makes copies meet and spreads the reading: a number of tasks by the number of rows, which is kept as it is.
    n = df.count()
    tasks = max(min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 500)), -(-n // RECORDS), 1)
    docs = docs.repartition(tasks, "record_id", "doc").dropDuplicates(["record_id", "doc", "text"])
    lists, keep = frozenset(lists), paths and frozenset(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list = []
            for rid, s, doc in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                try:
                    nodes = label(read_record(s.as_py(), root), lists, keep)
                except Unreadable:
                    continue
                rows += [(rid, doc, *n) for n in nodes]
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return docs.mapInArrow(run, NODE)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def linked(nodes: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """The nodes of the last path with `pre_i`, `pos_i` of the node of each earlier path whose interval holds theirs.

    `paths` go from the outermost type to the innermost. Nodes outside any such ancestor are left out.
    """
    w = Window.partitionBy("record_id", "doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    d = nodes.where(F.col("path").isin(*paths))
    for i, p in enumerate(paths[:-1], 1):
        d = d.withColumn(f"a{i}", F.last(F.when(F.col("path") == p, F.struct("pre", "post", "pos")), ignorenulls=True).over(w))
    d = d.where(F.col("path") == paths[-1])
    for i in range(1, len(paths)):
        d = d.where((F.col(f"a{i}.pre") < F.col("pre")) & (F.col(f"a{i}.post") > F.col("post")))
        d = d.withColumns({f"pre_{i}": F.col(f"a{i}.pre"), f"pos_{i}": F.col(f"a{i}.pos")})
    return d.drop("path", *[f"a{i}" for i in range(1, len(paths))])


def parented(nodes: DataFrame) -> DataFrame:
    """All nodes with `parent`, the number (pre) of the innermost node whose interval holds theirs; null for a text's root.

    A document's nodes come to one task in the order of pre; the intervals that are open there form a stack, which is all
    that is kept. `nodes` must hold every node of its texts (shred without `paths`).
    """
    d = nodes.repartition("record_id", "doc").sortWithinPartitions("record_id", "doc", "pre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for b in batches:
            parents: list = []
            for rid, doc, pre, post in zip(*(b[c].to_pylist() for c in ("record_id", "doc", "pre", "post")), strict=True):
                if (rid, doc) != at:
                    at, stack = (rid, doc), []
                while stack and stack[-1][1] < post:
                    stack.pop()
                parents.append(stack[-1][0] if stack else None)
                stack.append((pre, post))
            yield b.append_column("parent", pa.array(parents, pa.int64()))

    return d.mapInArrow(run, NODE + ", parent long")
