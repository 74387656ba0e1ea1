"""XML messages to node rows, leaf values and back to text."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fieldlens import fixed

NODE_FIELDS = (
    ("node_id", "int"), ("parent_id", "int"), ("pos", "int"), ("depth", "int"),
    ("path", "string"), ("occ_path", "string"), ("tag", "string"), ("kind", "string"), ("value", "string"),
    ("attrs", "map<string,string>"), ("child_tags", "array<string>"), ("head_tags", "array<string>"),
    ("n_children", "int"), ("tag_occ", "int"), ("tag_total", "int"),
)
# true on the last valued row of each path of a document
LAST_FIELD = ("path_last", "boolean")
PAIR_FIELDS = (("pos_path", "string"), ("key_path", "string"), ("key", "string"), ("shadowed", "boolean"))
_ARROW = {
    "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()),
    "array<string>": pa.list_(pa.string()),
}
BATCH_ROWS = 20_000
LARGE_TEXT = 1 << 20  # characters of a document that is read as events, without its tree, where the wanted columns allow it
READ_CHARS = 1 << 16
# what is known of a node before the nodes after it are read
EVENT_COLUMNS = frozenset(("node_id", "parent_id", "pos", "depth", "path", "occ_path", "tag", "kind", "value", "attrs", "tag_occ", "pos_path"))
# what the leaf tables and the validation rules read
LEAF_COLUMNS = ("node_id", "path", "occ_path", "kind", "value", "path_last")
RULE_COLUMNS = ("path", "tag", "kind", "value", "attrs", "child_tags", "tag_occ", "tag_total")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


_NO_TAGS: list[str] = []
_NO_ATTRS: dict[str, str] = {}


def _malformed(exc: Exception, pairing: bool) -> tuple:
    pad = (None,) * len(PAIR_FIELDS) if pairing else ()
    return (0, None, 0, 0, "", "", "Document", "parse_error", f"XML parsing error: {exc}", {}, [], [], 0, 1, 1, *pad)


def _node_rows(xml: str, pairing: bool, keep_ns: bool) -> list[tuple]:
    """Rows of one document in document order; one parse_error row when it is malformed."""
    pad = (None,) * len(PAIR_FIELDS) if pairing else ()
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, TypeError, ValueError) as exc:
        return [_malformed(exc, pairing)]
    name = (lambda t: t) if keep_ns else _local
    totals: dict[str, int] = {}
    for e in root.iter():
        tag = name(e.tag)
        totals[tag] = totals.get(tag, 0) + 1
    seen: dict[str, int] = {}
    rows: list[tuple] = []
    # element, tag, parent id, position, depth, parent path, parent occurrence path, occurrence, pairing state
    stack = [(root, name(root.tag), None, 0, 0, "", "", 1, ("", "", "", False))]
    node_id = 0
    while stack:
        elem, tag, parent_id, pos, depth, parent, parent_occ, occ, state = stack.pop()
        me = node_id
        node_id += 1
        seen[tag] = seen.get(tag, 0) + 1
        path = f"{parent}{tag}"
        occ_path = f"{parent_occ}{tag}[{occ}]"
        text = elem.text
        text = (text.strip() or None) if text else None
        attrs = elem.attrib
        if attrs:
            attrs = dict(attrs) if keep_ns else {_local(k): v for k, v in attrs.items()}
        else:
            attrs = _NO_ATTRS
        extra = ()
        if pairing:
            ppos, pkey, key, shadowed = state
            pos_path, key_path = f"{ppos}/{pos}", f"{pkey}/{key}"
            extra = (pos_path, key_path, key, shadowed)
        if len(elem):
            tags = [name(c.tag) for c in elem]
            rows.append((me, parent_id, pos, depth, path, occ_path, tag, "element", text, attrs,
                         list(dict.fromkeys(tags)), tags[:3], len(tags), seen[tag], totals[tag], *extra))
        else:
            tags = _NO_TAGS
            rows.append((me, parent_id, pos, depth, path, occ_path, tag, "element", text, attrs, tags, tags, 0, seen[tag], totals[tag], *extra))
        for attr, value in attrs.items():
            rows.append((node_id, me, -1, depth + 1, f"{path}/@{attr}", f"{occ_path}/@{attr}", f"@{attr}", "attribute",
                         value, _NO_ATTRS, _NO_TAGS, _NO_TAGS, 0, 1, 1, *pad))
            node_id += 1
        if not tags:
            continue
        if pairing:
            keys = [_pair_key(c, t, i, name) for i, (c, t) in enumerate(zip(elem, tags))]
            last = {k: i for i, k in enumerate(keys)}
            states = [(pos_path, key_path, k, shadowed or last[k] != i) for i, k in enumerate(keys)]
        per_tag: dict[str, int] = {}
        todo = []
        below, below_occ = path + "/", occ_path + "/"
        for i, child in enumerate(elem):
            child_tag = tags[i]
            n = per_tag[child_tag] = per_tag.get(child_tag, 0) + 1
            todo.append((child, child_tag, me, i, depth + 1, below, below_occ, n, states[i] if pairing else state))
        todo.reverse()
        stack.extend(todo)
    return rows


class _Unread:
    """Events that nobody looks at: what is left of a parse is whether the text is well-formed."""


class _Events:
    """Rows of the elements read so far, in document order; open elements are all that is kept. An element's row follows when its text is known."""

    def __init__(self, pairing: bool, keep_ns: bool, attributes: bool) -> None:
        self.rows: list[tuple] = []
        self._attributes = attributes
        self._name = (lambda t: t) if keep_ns else _local
        self._keep_ns, self._pairing = keep_ns, pairing
        self._seen: dict[str, int] = {}
        self._next = 0
        self._text: list[str] = []
        self._open: list[list] = []  # id, path, occurrence path, position path, children so far, those of each tag
        self._waiting: tuple | None = None  # the element read last, until its text ends

    def start(self, tag: str, attrib: dict[str, str]) -> None:
        self._told()
        tag = self._name(tag)
        attrs = dict(attrib) if self._keep_ns else {_local(k): v for k, v in attrib.items()}
        if self._open:
            above = self._open[-1]
            parent_id, parent, parent_occ, parent_pos, pos = above[0], f"{above[1]}/", f"{above[2]}/", above[3], above[4]
            above[4] += 1
            occ = above[5][tag] = above[5].get(tag, 0) + 1
        else:
            parent_id, parent, parent_occ, parent_pos, pos, occ = None, "", "", "", 0, 1
        me = self._next
        self._next += 1 + len(attrs)
        self._seen[tag] = self._seen.get(tag, 0) + 1
        path, occ_path, pos_path = f"{parent}{tag}", f"{parent_occ}{tag}[{occ}]", f"{parent_pos}/{pos}" if self._pairing else ""
        self._waiting = (me, parent_id, pos, len(self._open), path, occ_path, tag, attrs, self._seen[tag], pos_path)
        self._open.append([me, path, occ_path, pos_path, 0, {}])

    def data(self, text: str) -> None:
        if self._waiting is not None:
            self._text.append(text)

    def end(self, tag: str) -> None:
        self._told()
        self._open.pop()

    def _told(self) -> None:
        if self._waiting is None:
            return
        me, parent_id, pos, depth, path, occ_path, tag, attrs, occ, pos_path = self._waiting
        text = "".join(self._text).strip() or None
        none = (None,) * len(PAIR_FIELDS) if self._pairing else ()
        self.rows.append((me, parent_id, pos, depth, path, occ_path, tag, "element", text, attrs or _NO_ATTRS, None, None, None, occ, None,
                          *((pos_path, *none[1:]) if self._pairing else ())))
        for i, (attr, value) in enumerate(attrs.items() if self._attributes else (), me + 1):
            self.rows.append((i, me, -1, depth + 1, f"{path}/@{attr}", f"{occ_path}/@{attr}", f"@{attr}", "attribute", value, _NO_ATTRS, None, None, None, 1, None, *none))
        self._waiting, self._text = None, []


def _event_rows(xml: str, pairing: bool, keep_ns: bool, attributes: bool = True) -> Iterator[list[tuple]]:
    """The ``EVENT_COLUMNS`` of ``_node_rows`` a piece of the document at a time, the others null."""
    try:
        parser = ET.XMLParser(target=_Unread())
        for at in range(0, len(xml), READ_CHARS):
            parser.feed(xml[at:at + READ_CHARS])
        parser.close()
    except ET.ParseError as exc:
        yield [_malformed(exc, pairing)]
        return
    except ValueError:  # a text that is none, found before anything is parsed
        yield _node_rows(xml, pairing, keep_ns)
        return
    events = _Events(pairing, keep_ns, attributes)
    parser = ET.XMLParser(target=events)
    for at in range(0, len(xml), READ_CHARS):
        parser.feed(xml[at:at + READ_CHARS])
        found, events.rows = events.rows, []
        yield found
    parser.close()
    yield events.rows


def _mark_last(rows: list[tuple]) -> list[tuple]:
    """Appends whether a row is the last one of its path with a value."""
    last = {row[4]: i for i, row in enumerate(rows) if row[8] is not None}
    return [(*row, last.get(row[4]) == i) for i, row in enumerate(rows)]


def _pair_key(elem: ET.Element, tag: str, index: int, name) -> str:
    """tag[Id=value] from the first identifying child, else tag[index]."""
    first: dict[str, str | None] = {}
    for child in elem:
        first.setdefault(name(child.tag), child.text)
    for ident in fixed.IDENTIFIERS:
        if first.get(ident):
            return f"{tag}[{ident}={first[ident]}]"
    return f"{tag}[{index}]"


def flatten_xml(df: DataFrame, doc_id: str = "msg_id", xml: str = "xml", pairing: bool = False, keep_ns: bool = False,
                columns: Sequence[str] | None = None, attributes: bool = True, tags: Collection[str] | None = None) -> DataFrame:
    """One row per element and, unless ``attributes`` is false, per attribute of every document, in document order.

    Each element carries its attributes, child tags and tag counts, so that rules about a
    node and its surroundings need neither a join nor a shuffle. A malformed document gives
    one row of kind ``parse_error``. ``pairing`` adds the keys used to compare documents.
    ``columns`` names the ones wanted; the others are not handed over to Spark. With none but ``EVENT_COLUMNS`` a large document is
    read as events: memory does not grow with it. With ``tags`` only elements of these tags are handed over, beside parse errors.
    """
    with_last = columns is not None and LAST_FIELD[0] in columns
    every = NODE_FIELDS + (PAIR_FIELDS if pairing else ()) + ((LAST_FIELD,) if with_last else ())
    fields = tuple(f for f in every if columns is None or f[0] in columns)
    index = [every.index(f) for f in fields]
    id_type = df.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {id_type}, " + ", ".join(f"{n} {t}" for n, t in fields)
    by_events = tags is None and all(n in EVENT_COLUMNS for n, _ in fields)
    wanted = None if tags is None else frozenset(tags)

    def pieces(text):
        if by_events and text is not None and len(text) > LARGE_TEXT:
            yield from _event_rows(text, pairing, keep_ns, attributes)
            return
        found = _node_rows(text, pairing, keep_ns)
        found = _mark_last(found) if with_last else found
        if wanted is not None:
            found = [r for r in found if r[6] in wanted or r[7] == "parse_error"]
        yield found if attributes else [r for r in found if r[7] != "attribute"]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            owner: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(texts):
                for found in pieces(text.as_py()):
                    owner.extend([i] * len(found))
                    rows += found
                    if len(rows) >= BATCH_ROWS:
                        yield _to_batch(ids, owner, rows, fields, index)
                        owner, rows = [], []
            if rows:
                yield _to_batch(ids, owner, rows, fields, index)

    return df.select(doc_id, xml).mapInArrow(run, schema)


def _to_batch(ids, owner, rows, fields, index) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [ids.take(pa.array(owner, pa.int64()))]
    for (_, kind), values in zip(fields, (columns[i] for i in index)):
        if kind.startswith("map"):
            values = [list(v.items()) if v is not None else None for v in values]
        arrays.append(pa.array(values, _ARROW[kind]))
    return pa.RecordBatch.from_arrays(arrays, ["id", *[n for n, _ in fields]])


# ---- two versions of a message, and messages against a list of paths ------------------

PAIR_SIDE = (("tag", "string"), ("value", "string"), ("attrs", "map<string,string>"), ("head_tags", "array<string>"), ("n_children", "int"),
             ("pos", "int"), ("key", "string"))


def _text(elem: ET.Element) -> str | None:
    return (elem.text.strip() or None) if elem.text else None


def _attributes(elem: ET.Element, keep_ns: bool) -> dict[str, str]:
    return dict(elem.attrib) if keep_ns else {_local(k): v for k, v in elem.attrib.items()}


def _children(elem: ET.Element, ordered: bool, name) -> dict:
    """Children by what they are paired by: their position, or their key, of which the last one counts."""
    if ordered:
        return {i: (i, c) for i, c in enumerate(elem)}
    return {_pair_key(c, name(c.tag), i, name): (i, c) for i, c in enumerate(elem)}


def _digests(root: ET.Element, ordered: bool, keep_ns: bool, name) -> dict[ET.Element, bytes]:
    """Bottom-up digest of every subtree: tag, text, attributes and the digests of the children as they are paired.

    Positions pair children in their order, keys in any order; equal digests mean that a comparison of the subtrees finds nothing.
    """
    out: dict[ET.Element, bytes] = {}
    for elem in reversed(list(root.iter())):  # children come before their parent
        seen = hashlib.blake2b(repr((name(elem.tag), _text(elem), sorted(_attributes(elem, keep_ns).items()))).encode("utf-8", "surrogatepass"), digest_size=16)
        for key, (_, child) in sorted(_children(elem, ordered, name).items()):
            if not ordered:
                seen.update(key.encode("utf-8", "surrogatepass") + b"\0")
            seen.update(out[child])
        out[elem] = seen.digest()
    return out


def _pair_rows(left: str, right: str, ordered: bool, keep_ns: bool) -> list[tuple]:
    """Places where two documents differ: (parent path, left side, right side); nothing when one of them is malformed.

    Equal subtrees are not opened. Below a changed tag and below an element without a partner nothing is compared.
    """
    try:
        roots = [ET.fromstring(x) for x in (left, right)]
    except (ET.ParseError, TypeError, ValueError):
        return []
    name = (lambda t: t) if keep_ns else _local
    digests = [_digests(r, ordered, keep_ns, name) for r in roots]

    def side(elem, pos, key):
        tags = [name(c.tag) for c in elem]
        return (name(elem.tag), _text(elem), _attributes(elem, keep_ns), tags[:3], len(tags), pos, key)

    none = (None,) * len(PAIR_SIDE)
    rows, todo = [], [("", roots[0], roots[1], 0, 0, "")]
    while todo:
        parent, a, b, i, j, key = todo.pop()
        if digests[0][a] == digests[1][b]:
            continue
        one, two = side(a, i, key), side(b, j, key)
        if one[:3] != two[:3]:
            rows.append((parent, *one, *two))
        if one[0] != two[0]:
            continue
        path = f"{parent}/{one[0]}" if parent else one[0]
        mine, other = _children(a, ordered, name), _children(b, ordered, name)
        for k, (i, child) in mine.items():
            if k in other:
                todo.append((path, child, other[k][1], i, other[k][0], str(k)))
            else:
                rows.append((path, *side(child, i, str(k)), *none))
        rows += [(path, *none, *side(child, j, str(k))) for k, (j, child) in other.items() if k not in mine]
    return rows


def differing_nodes(pairs: DataFrame, doc_id: str = "msg_id", left: str = "left", right: str = "right", ordered: bool = True, keep_ns: bool = False) -> DataFrame:
    """(doc_id, parent_path, a_*, b_*) of the node pairs in which two texts of one row differ.

    Both trees get digests from the leaves up, so an unchanged message gives no row and a changed one its changed places.
    """
    fields = (("parent_path", "string"), *((f"a_{n}", t) for n, t in PAIR_SIDE), *((f"b_{n}", t) for n, t in PAIR_SIDE))
    schema = f"{doc_id} {pairs.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields)

    def run(batches):
        for batch in batches:
            owner: list[int] = []
            rows: list[tuple] = []
            for i, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = _pair_rows(a, b, ordered, keep_ns)
                owner.extend([i] * len(found))
                rows += found
                if len(rows) >= BATCH_ROWS:
                    yield _to_batch(batch.column(0), owner, rows, fields, range(len(fields)))
                    owner, rows = [], []
            if rows:
                yield _to_batch(batch.column(0), owner, rows, fields, range(len(fields)))

    return pairs.select(doc_id, left, right).mapInArrow(run, schema)


def leaf_values(xml: str | None) -> dict[str, str]:
    """Last value of every path of a document; empty when it is malformed."""
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, TypeError, ValueError):
        return {}
    out: dict[str, str] = {}
    todo = [(root, _local(root.tag))]
    while todo:
        elem, path = todo.pop()
        text = _text(elem)
        if text is not None:
            out[path] = text
        for attr, value in elem.attrib.items():
            out[f"{path}/@{_local(attr)}"] = value
        todo.extend((c, f"{path}/{_local(c.tag)}") for c in reversed(elem))
    return out


def parse_guard(nodes: DataFrame, doc_id: str = "msg_id") -> tuple[DataFrame, DataFrame]:
    """Nodes of well-formed documents, and one issue per malformed document."""
    bad = F.col("kind") == "parse_error"
    issues = nodes.filter(bad).select(
        doc_id, F.lit("ERROR").alias("severity"), F.lit("XML Parsing").alias("category"), F.lit("").alias("path"),
        F.lit("Document").alias("element"), F.col("value").alias("message"), F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("suggestion"))
    return nodes.filter(~bad), issues


def leaves(nodes: DataFrame) -> DataFrame:
    """Attributes and elements with text."""
    return nodes.filter(F.col("kind").isin("element", "attribute") & F.col("value").isNotNull())


def leaf_map(nodes: DataFrame, doc_id: str = "msg_id", keep: str = "last") -> DataFrame:
    """One value per document and path (the last one), or all of them with their position.

    With the ``path_last`` column of ``flatten_xml`` the last value is a filter, without a shuffle.
    """
    rows = leaves(nodes)
    if keep == "last" and "path_last" in nodes.columns:
        return rows.filter("path_last").select(doc_id, "path", "value")
    if keep == "all":
        return rows.select(doc_id, "path", "value", "node_id", "occ_path")
    return rows.groupBy(doc_id, "path").agg(F.max_by("value", "node_id").alias("value"))


def parent_of(nodes: DataFrame, doc_id: str = "msg_id") -> DataFrame:
    """Each node with tag and path of its parent (null at the root)."""
    parent = nodes.select(doc_id, F.col("node_id").alias("parent_id"), F.col("tag").alias("parent_tag"), F.col("path").alias("parent_path"))
    return nodes.join(parent, [doc_id, "parent_id"], "left")


def first_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.filter((F.col("tag") == tag) & (F.col("tag_occ") == 1))


def node_summary(prefix: str = "") -> Column:
    """Short text of an element: its text (50), else its first child tags, else an empty tag; cut at 100."""
    tag, text = F.col(f"{prefix}tag"), F.regexp_replace(F.coalesce(f"{prefix}value", F.lit("")), r"\s+", " ")
    with_text = F.concat(F.lit("<"), tag, F.lit(">"), F.left(text, F.lit(50)), F.when(F.length(text) > 50, "...").otherwise(""), F.lit("</"), tag, F.lit(">"))
    with_children = F.concat(F.lit("<"), tag, F.lit(">["), F.array_join(f"{prefix}head_tags", ", "),
                             F.when(F.col(f"{prefix}n_children") > 3, "...").otherwise(""), F.lit("]</"), tag, F.lit(">"))
    full = F.when(text != "", with_text).when(F.col(f"{prefix}n_children") > 0, with_children).otherwise(F.concat(F.lit("<"), tag, F.lit("/>")))
    return F.left(full, F.lit(100))


# ---- back to text ------------------------------------------------------------------

def rebuild_xml(rows: DataFrame, doc_id: str = "msg_id", order: str = "ord", path: str = "path", value: str = "value") -> DataFrame:
    """Leaf rows to one XML text per document: (doc_id, xml).

    Rows are taken in ``order``; consecutive rows share their open parents. A path part may
    carry an occurrence ``[n]``, which keeps repeated parents apart. Attribute rows
    (``path/@name``) belong to the element row before them or open it.
    """
    # a document is one row of text to begin with, so grouping by document is bounded; one shuffle, no sort of the input
    rows_of = rows.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(path).alias("path"), F.col(value).alias("value")))).alias("l"))
    return render_leaves(rows_of, F.col("l"), doc_id)


def render_leaves(df: DataFrame, rows: Column, doc_id: str = "msg_id") -> DataFrame:
    """The same for documents whose leaf rows are one array of structs with ``path`` and ``value``, in order: (doc_id, xml), without a shuffle."""
    # a document's rows travel as two flat arrays; what lies between two paths is worked out once and looked up after that
    filled = df.filter(F.size(rows) > 0).select(doc_id, rows.alias("l")).select(
        doc_id, F.col("l")["path"].cast("array<string>").alias("p"), F.col("l")["value"].cast("array<string>").alias("v"))
    schema = f"{doc_id} {df.schema[doc_id].dataType.simpleString()}, xml string"

    def run(batches):
        render = _Renderer()
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            paths, values = lists.values.to_pylist(), batch.column(2).values.to_pylist()
            # the two have the same lengths, not always the same offsets
            ends, others = lists.offsets.to_pylist(), batch.column(2).offsets.to_pylist()
            texts = [render(paths[a:b], values[c:d]) for a, b, c, d in zip(ends, ends[1:], others, others[1:])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["id", "xml"])

    return filled.mapInArrow(run, schema)


class _Renderer:
    """XML text of leaf rows. Steps between paths are kept, as many as a schema has and no more than ``MOST``."""

    MOST = 100_000

    def __init__(self) -> None:
        self._paths: dict[str, tuple[str, str]] = {}
        self._steps: dict[tuple[str | None, str], str] = {}
        self._ends: dict[str, str] = {}

    def __call__(self, paths: list[str | None], values: list[str | None]) -> str | None:
        out: list[str] = []
        before = text = None  # element of the row before, text of the element that is open
        for path, value in zip(paths, values):
            if path is None:
                continue
            known = self._paths.get(path) or self._path(path)
            elem, name = known
            value = _escaped(value) if value else ""
            if before is None or not name or elem != before:
                if text is not None:
                    out += (">", text)
                step = self._steps.get((before, elem))
                out.append(self._step(before, elem) if step is None else step)
                text = "" if name else value
            if name:
                out.append(f' {name}="{value.replace(chr(34), "&quot;")}"')
            before = elem
        if before is None:
            return None
        return "".join((*out, ">", text, self._end(before)))

    def _path(self, path: str) -> tuple[str, str]:
        """The path's element, and the name of its attribute."""
        at = path.rfind("/@")
        name = path[at + 2:] if at >= 0 else ""
        found = (path[:at], name) if name and "/" not in name else (path, "")
        self._kept(self._paths)[path] = found
        return found

    def _step(self, before: str | None, elem: str) -> str:
        """From an element to the next one, up to the name in its start tag."""
        old, new = [] if before is None else before.split("/"), elem.split("/")
        same, most = 0, min(len(old), len(new) - 1)  # the last part is always opened anew
        while same < most and old[same] == new[same]:
            same += 1
        close = "".join(f"</{_bare(q)}>" for q in reversed(old[same:]))
        text = f"{close}{''.join(f'<{_bare(q)}>' for q in new[same:-1])}<{_bare(new[-1])}"
        self._kept(self._steps)[before, elem] = text
        return text

    def _end(self, elem: str) -> str:
        if elem not in self._ends:
            self._kept(self._ends)[elem] = "".join(f"</{_bare(q)}>" for q in reversed(elem.split("/")))
        return self._ends[elem]

    def _kept(self, of: dict) -> dict:
        if len(of) >= self.MOST:
            of.clear()
        return of


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _bare(part: str) -> str:
    """A path part without its occurrence."""
    return re.sub(r"\[[0-9]+\]$", "", part)
